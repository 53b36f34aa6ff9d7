"""Text quality as perplexity under a Kneser-Ney model of trusted text.

The model is interpolated modified Kneser-Ney over character n-grams, which need no list of
words. Counts live in tables keyed by the n-gram. Equi-joins give the probabilities of the
shorter n-grams that occur. To score, documents are dealt into blocks, and each block asks
for its distinct full n-grams. Requests travel as packed lists, dealt by the characters
before the last one, and meet there the counts and shorter probabilities with the same
characters; the answers go back to the blocks. No table is held whole anywhere.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.totals import attach_totals
from statloom.llm.arrow import in_batches, map_rows
from statloom.session import cut_lineage

PAD = "\x02"
PIECE = 1 << 18  # characters worked on at once
HELD = 1 << 24  # characters whose n-grams are summed up in a task before they become rows
MERGE = 1 << 20  # n-grams of several pieces held before equal ones are put together


class Pieces:
    """Parts of documents laid end to end, each behind its context."""

    def __init__(self, parts: list[tuple[int, str, str]], order: int):
        self.text = "".join(context + text for _, context, text in parts)
        self.order = order
        lengths = np.array([len(text) for _, _, text in parts], dtype=np.int64)
        self.docs = np.repeat([n for n, _, _ in parts], lengths)
        # behind each context of order - 1 characters come the characters of the part
        self._begins = np.arange(lengths.sum()) + np.repeat(np.arange(len(parts)) * (order - 1), lengths)
        self._points = np.frombuffer(self.text.encode("utf-32-le"), dtype="<u4")

    def codes(self, letters: Letters) -> np.ndarray:
        """The n-gram that ends at every character of the parts, as a number in the base of the alphabet."""
        at, n = letters.place[self._points], len(self._points) - self.order + 1
        codes = at[:n].copy()
        for k in range(1, self.order):
            codes *= letters.size
            codes += at[k : n + k]
        return codes[self._begins]

    def grams(self) -> list[str]:
        """The n-gram that ends at every character of the parts."""
        return [self.text[i : i + self.order] for i in self._begins.tolist()]


class Letters:
    """The characters of some texts in order, and their places in it."""

    def __init__(self, present: np.ndarray):
        self.points = np.flatnonzero(present)
        self.size = len(self.points)
        self.place = np.zeros(len(present), dtype=np.int64)
        self.place[self.points] = np.arange(self.size)

    @staticmethod
    def of(texts: list[str]) -> Letters:
        present = np.zeros(0x110000, dtype=bool)
        present[ord(PAD)] = True
        for text in texts:
            for i in range(0, len(text), PIECE):
                present[np.frombuffer(text[i : i + PIECE].encode("utf-32-le"), dtype="<u4")] = True
        return Letters(present)

    def numbers(self, order: int) -> bool:
        """Whether n-grams fit into numbers."""
        return max(self.size, 2) ** order < 1 << 63

    def spelled(self, codes: np.ndarray, order: int) -> np.ndarray:
        """The characters of n-grams, a row each."""
        out = np.empty((len(codes), order), dtype="<u4")
        for k in range(order - 1, -1, -1):
            codes, at = np.divmod(codes, self.size)
            out[:, k] = self.points[at]
        return out


def tally(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of whole texts in order, the characters of each in a row, and how often each occurs."""
    letters = Letters.of(texts)
    if not letters.numbers(order):
        total: Counter[str] = Counter()
        for part in pieces(texts, order):
            total.update(part.grams())
        listed = sorted(total)
        return _points(listed, order), np.array([total[g] for g in listed], dtype=np.int64)
    found, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held = 0
    for part in pieces(texts, order):
        codes = np.sort(part.codes(letters))
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        found.append(codes[first])
        counts.append(np.diff(first, append=len(codes)))
        held += len(first)
        if held > MERGE:
            merged, added = _merged(np.concatenate(found), np.concatenate(counts))
            found, counts, held = [merged], [added], 0
    merged, added = _merged(np.concatenate(found), np.concatenate(counts))
    return letters.spelled(merged, order), added


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _points(grams: list[str], order: int) -> np.ndarray:
    """N-grams with the characters of each in a row."""
    return np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4").reshape(len(grams), order)


def _strings(points: np.ndarray) -> list[str]:
    text, n = points.astype("<u4").tobytes().decode("utf-32-le"), points.shape[1]
    return [text[i : i + n] for i in range(0, n * len(points), n)]


def pieces(texts: list[str], order: int):
    """Documents in groups of about ``PIECE`` characters.

    A longer document is cut, and each part keeps the characters before it as its context;
    the beginning of a document stands behind padding.
    """
    held, size, back = [], 0, order - 1
    for n, text in enumerate(texts):
        for i in range(0, len(text), PIECE):
            if size and size + len(text) - i > PIECE:
                yield Pieces(held, order)
                held, size = [], 0
            held.append((n, text[i - back : i] if i else PAD * back, text[i : i + PIECE]))
            size += len(held[-1][2])
    if held:
        yield Pieces(held, order)


def plain(value: str | bytes | None) -> str:
    """A text, packed or not."""
    if isinstance(value, bytes):
        import zstandard

        return zstandard.ZstdDecompressor().decompress(value).decode()
    return value or ""


def frames(df: DataFrame, text: str, columns: list[str], block: str) -> DataFrame:
    """Rows of one block behind each other: lists of ``columns`` and of the texts' sizes, and ``z``, the texts as one zstandard frame."""
    kinds = dict(df.dtypes)

    def run(found):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        together: dict[int, list[int]] = {}
        for i, b in enumerate(found[block]):
            together.setdefault(b, []).append(i)
        for b, rows in together.items():
            texts = [found[text][i] or "" for i in rows]
            yield b, *([found[c][i] for i in rows] for c in columns), [len(t) for t in texts], packer.compress("".join(texts).encode())

    kept = "".join(f"`{c}` array<{kinds[c]}>, " for c in columns)
    return map_rows(df.select(block, *columns, text), run, f"`{block}` int, {kept}size array<int>, z binary", 64)


def _unframed(table: pa.Table) -> list[str]:
    texts = []
    for sizes, z in zip(table.column("size").to_pylist(), table.column("z")):
        whole, at = plain(z.as_py()), 0
        for n in sizes:
            texts.append(whole[at : at + n])
            at += n
    return texts


def _packed_grams(points: np.ndarray) -> bytes:
    import zstandard

    # one column behind the other: those of n-grams in order hardly change at the front
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(points.T, dtype="<u4").tobytes())


def _unpacked_grams(z: bytes, order: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), "<u4").reshape(order, -1).T


def _buckets(points: np.ndarray, back: int, buckets: int) -> np.ndarray:
    """Where n-grams meet: by a hash of the ``back`` characters before the last one."""
    h = np.zeros(len(points), dtype=np.uint64)
    n = points.shape[1]
    for k in range(n - 1 - back, n - 1):
        h = (h + points[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def _dealt(points: np.ndarray, back: int, buckets: int):
    """(bucket, which rows) for every bucket that is met; rows keep their order."""
    to = _buckets(points, back, buckets)
    order = np.argsort(to, kind="stable")
    ends = np.cumsum(np.bincount(to, minlength=0))
    for b in np.unique(to).tolist():
        yield b, order[ends[b - 1] if b else 0 : ends[b]]


def count_grams(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(gram, c) over whole texts, packed or not; each task sums its own n-grams before they become rows."""

    schema = pa.schema([("gram", pa.string()), ("c", pa.int64())])

    def rows(texts):
        points, counts = tally(texts, order)
        for at in range(0, len(counts), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(_strings(points[at : at + 20_000]), pa.string()), pa.array(counts[at : at + 20_000])], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(plain(value.as_py()))
                size += len(held[-1])
                if size >= HELD:
                    yield from rows(held)
                    held, size = [], 0
        if size:
            yield from rows(held)

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


class Model:
    """Count tables per order: ``grams[n]`` (gram, c), the discounts, and the alphabet's size; ``contexts[n]`` (context, total, n1, n2, n3) up to ``base``, the longest n-grams whose probabilities are joined."""

    def __init__(self, counts: DataFrame, order: int):
        self.order = order
        self.base = order - (2 if order > 4 else 1)
        self.grams: dict[int, DataFrame] = {order: cut_lineage(counts)}
        self.contexts: dict[int, DataFrame] = {}
        self.discounts: dict[int, tuple[float, float, float]] = {}
        for n in range(order, 0, -1):
            table = self.grams[n]
            if n > 1:
                # how many different characters stand before the shorter n-gram
                self.grams[n - 1] = cut_lineage(table.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.count("*").alias("c")))
            if n <= self.base:
                first = F.substr("gram", F.lit(1), F.lit(n - 1)) if n > 1 else F.lit("")
                many = [F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3")]
                self.contexts[n] = cut_lineage(table.groupBy(first.alias("context")).agg(F.sum("c").alias("total"), *many))
            seen = table.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).head()
            self.discounts[n] = _discounts(*seen)
        self.alphabet = self.grams[1].count() + 1 if order > 0 else 1

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, p) of distinct n-grams of ``base`` characters, by joins with the tables of every order up to it."""
        needs = {self.base: cut_lineage(wanted)}
        for n in range(self.base - 1, 0, -1):
            needs[n] = needs[n + 1].select(F.substr("gram", F.lit(2)).alias("gram")).distinct()
        lower = None
        for n in range(1, self.base + 1):
            d1, d2, d3 = self.discounts[n]
            rows = needs[n].join(self.grams[n], "gram", "left").withColumn("c", F.coalesce("c", F.lit(0)))
            if n == 1:
                rows = attach_totals(rows, self.contexts[1].agg(F.sum("total").alias("total"), *(F.sum(k).alias(k) for k in ("n1", "n2", "n3")))).withColumn("below", F.lit(1.0 / self.alphabet))
            else:
                rows = rows.withColumn("context", F.substr("gram", F.lit(1), F.lit(n - 1))).join(self.contexts[n], "context", "left")
                rows = rows.withColumn("shorter", F.substr("gram", F.lit(2))).join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter")
            discount = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            left = (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")
            p = F.when(F.col("total") > 0, (F.col("c") - discount) / F.col("total") + left * F.col("below")).otherwise(F.col("below"))
            lower = cut_lineage(rows.select("gram", p.alias("p")))
        return lower

    def dealt(self, docs: DataFrame, text: str, buckets: int) -> DataFrame:
        """(bucket, grams, counts, ps): packed counts of the full order, or packed probabilities of ``base`` for all that occurs in ``docs``."""
        back = max(self.base - 1, 0)

        def deal(order: int, value: str):
            schema = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("ps", pa.binary())])

            def run(batches):
                for batch in batches:
                    points, values = _points(batch.column(0).to_pylist(), order), batch.column(1).to_numpy()
                    listed = ((b, _packed_grams(points[at]), *(values[at].tobytes() if value == v else None for v in ("c", "p"))) for b, at in _dealt(points, back, buckets))
                    yield from in_batches(listed, schema)

            return run

        kinds = "bucket int, grams binary, counts binary, ps binary"
        out = self.grams[self.order].select("gram", "c").mapInArrow(deal(self.order, "c"), kinds)
        if self.base < 1:
            return out
        known = self.probabilities(count_grams(docs, text, self.base).select("gram"))
        return out.unionByName(known.select("gram", "p").mapInArrow(deal(self.base, "p"), kinds))


class _Rules:
    """The numbers of a model, without its tables, as the tasks take them."""

    def __init__(self, model: Model):
        self.order, self.base, self.discounts, self.alphabet = model.order, model.base, model.discounts, model.alphabet

    def replies(self, wanted: list[np.ndarray], counted: np.ndarray, counts: np.ndarray, shorter: np.ndarray, ps: np.ndarray) -> np.ndarray:
        """Probabilities of full n-grams, from all counts and all shorter probabilities with the characters before their last one."""
        n, asked = self.order, np.concatenate(wanted)
        numbered = _Numbers(counted, asked, shorter)
        if self.base:
            p = _found(numbered.codes(shorter, 0, self.base), ps, numbered.codes(asked, n - self.base, n))
        else:
            p = np.full(len(asked), 1.0 / self.alphabet)
        tables = {n: (counted, counts)}
        for m in range(n - 1, self.base, -1):
            longer = tables[m + 1][0]
            _, first, c = np.unique(numbered.codes(longer, 1, m + 1), return_index=True, return_counts=True)
            tables[m] = (longer[first, 1:], c)
        for m in range(self.base + 1, n + 1):
            known, c = tables[m]
            d1, d2, d3 = self.discounts[m]
            have = _found(numbered.codes(known, 0, m), c, numbered.codes(asked, n - m, n))
            contexts, at = np.unique(numbered.codes(known, 0, m - 1), return_inverse=True)
            context = numbered.codes(asked, n - m, n - 1)
            total, n1, n2, n3 = (_found(contexts, np.bincount(at, w, len(contexts)), context) for w in (c, c == 1, c == 2, c > 2))
            discount = np.select([have == 0, have == 1, have == 2], [0.0, d1, d2], d3)
            some = np.where(total > 0, total, 1.0)
            p = np.where(total > 0, (have - discount) / some + (d1 * n1 + d2 * n2 + d3 * n3) / some * p, p)
        return p


class _Numbers:
    """Parts of n-grams as numbers that are equal where the parts are."""

    def __init__(self, *points: np.ndarray):
        present = np.zeros(0x110000, dtype=bool)
        for p in points:
            present[p] = True
        self._letters = Letters(present)

    def codes(self, points: np.ndarray, begin: int, end: int) -> np.ndarray:
        size, place = max(self._letters.size, 1), self._letters.place
        codes = np.zeros(len(points), dtype=np.int64)
        if self._letters.numbers(end - begin):
            for k in range(begin, end):
                codes = codes * size + place[points[:, k]]
            return codes
        # too many characters for that: the rows themselves, compared as bytes
        return np.ascontiguousarray(points[:, begin:end], dtype=">u4").view(f"V{4 * (end - begin)}").ravel().astype(object)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of every wanted key, 0 for others."""
    at = pd.Index(keys).get_indexer(wanted)
    return np.append(values, 0).astype(np.float64)[at]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more, from how many n-grams occur so often."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    # small tables can leave the range in which the rest goes to shorter n-grams
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def train(docs: DataFrame, text: str = "text", order: int = 5) -> Model:
    """Counts over all of ``docs``; NULL and empty texts add nothing, repeated rows count again."""
    return Model(count_grams(docs, text, order), order)


def perplexities(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_chars: int = 1 << 24) -> DataFrame:
    """The columns ``keep`` with n_chars and perplexity per character of every row's whole text.

    A block holds about ``block_chars`` characters. NULL and empty texts have no perplexity.
    """
    total = docs.agg(F.sum(F.length(text))).head()[0] or 0
    blocks, buckets = total // block_chars + 1, total // (1 << 25) + 32
    kinds = dict(docs.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    order, back = model.order, max(model.base - 1, 0)
    dealt = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.pmod(F.xxhash64(*keep, text), F.lit(blocks)).cast("int").alias("block"), F.col(text).alias("t"))
    kept = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, keep))
    tables = model.dealt(docs, text, buckets)
    rules = _Rules(model)

    def ask(table: pa.Table) -> pa.Table:
        points, _ = tally(_unframed(table), order)
        block = table.column("block")[0].as_py()
        rows = [(block, b, _packed_grams(points[at])) for b, at in _dealt(points, back, buckets)]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate((("block", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary())))})

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        sides = []
        for column, size, kind in (("counts", order, "<i8"), ("ps", rules.base, "<f8")):
            part = known.filter(known.column(column).is_valid())
            points = [_unpacked_grams(z, size) for z in part.column("grams").to_pylist()] if size else []
            values = [np.frombuffer(v, kind) for v in part.column(column).to_pylist()]
            sides += [np.concatenate([np.empty((0, size), "<u4"), *points]), np.concatenate([np.empty(0, kind), *values])]
        out, held, size = [], [], 0
        grams = asked.column("grams").to_pylist()
        for i, z in enumerate(grams):
            held.append(_unpacked_grams(z, order))
            size += len(held[-1])
            if size > MERGE or i == len(grams) - 1:
                p = rules.replies(held, *sides)
                ends = np.cumsum([len(h) for h in held])
                out.extend(part.astype("<f8").tobytes() for part in np.split(p, ends[:-1]))
                held, size = [], 0
        return pa.table({"block": asked.column("block"), "grams": asked.column("grams"), "p": pa.array(out, pa.binary())})

    def answer(docs_of: pa.Table, known: pa.Table) -> pa.Table:
        points = np.concatenate([np.empty((0, order), "<u4"), *(_unpacked_grams(z, order) for z in known.column("grams").to_pylist())])
        log = np.log(np.concatenate([np.empty(0), *(np.frombuffer(p, "<f8") for p in known.column("p").to_pylist())]))
        texts = _unframed(docs_of)
        letters = Letters.of(texts)
        if letters.numbers(order):
            codes = np.zeros(len(points), dtype=np.int64)
            for k in range(order):
                codes = codes * letters.size + letters.place[points[:, k]]
            index = pd.Index(codes)
        else:
            index = pd.Index(_strings(points), dtype=object)
        sums = np.zeros(len(texts))
        for part in pieces(texts, order):
            at = index.get_indexer(part.codes(letters) if letters.numbers(order) else pd.Index(part.grams(), dtype=object))
            if (at < 0).any():
                raise RuntimeError("a block got no answer to one of its n-grams")
            sums += np.bincount(part.docs, log[at], len(texts))
        out = {c: docs_of.column(c).combine_chunks().flatten() for c in names}
        size = [len(t) for t in texts]
        out["n_chars"] = pa.array(size, pa.int64())
        out["perplexity"] = pa.array([float(np.exp(-s / n)) if n else None for s, n in zip(sums, size)], pa.float64())
        return pa.table(out)

    grouped = frames(dealt, "t", names, "block").groupBy("block")
    requests = grouped.applyInArrow(ask, "block int, bucket int, grams binary")
    # requests and scoring share one exchange of the packed texts
    answers = requests.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(reply, "block int, grams binary, p binary")
    found = grouped.cogroup(answers.groupBy("block")).applyInArrow(answer, f"{kept}, n_chars long, perplexity double")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "n_chars", "perplexity")


def thresholds(scored: DataFrame, lang: str, spread: float) -> DataFrame:
    """(lang, limit): per language the upper quartile of trusted log-perplexity plus ``spread`` × the distance of its quartiles."""
    log = F.log("perplexity")
    quartiles = scored.filter("perplexity IS NOT NULL").groupBy(F.col(lang).alias("_lang")).agg(F.percentile_approx(log, [0.25, 0.75], 10_000).alias("q"))
    return quartiles.select("_lang", F.exp(F.get("q", F.lit(1)) + spread * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("limit"))


class _Bitmap:
    """Which hash slots a set of keys takes: of bounded size, and never wrong about a key that is in it."""

    def __init__(self, keys: DataFrame, key: str, most_bits: int = 27):
        bits = max(10, min(most_bits, (8 * (keys.count() + 1)).bit_length()))
        self.slots = 1 << bits
        words = keys.select(self.slot(F.col(key)).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w"))
        rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(s, 64) AS int))")).alias("b")).collect()
        self.words = np.zeros(self.slots // 64, dtype=np.int64)
        for w, b in rows:
            self.words[w] = b

    def slot(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.slots))

    def packed(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """(key, z) of the rows whose key may be in the set, before they are shuffled to a join."""
        held = df.sparkSession.sparkContext.broadcast(self.words)

        def run(columns):
            import zstandard

            packer = zstandard.ZstdCompressor(level=3)
            for k, value, slot in zip(columns["k"], columns["t"], columns["slot"]):
                if held.value[slot >> 6] >> (slot & 63) & 1:
                    yield k, packer.compress(value.encode()) if value else None

        narrow = df.select(F.col(key).alias("k"), F.col(text).alias("t"), self.slot(F.col(key)).alias("slot"))
        return map_rows(narrow, run, f"`{key}` {dict(df.dtypes)[key]}, z binary", 256, 256)


def trusted_texts(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, z): packed texts whose key is among ``trusted``; a bitmap of the keys keeps the others out of the shuffle."""
    keys = trusted.select(key).filter(F.col(key).isNotNull()).distinct()
    return _Bitmap(keys, key).packed(docs, text, key).join(keys, key, "left_semi")


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", order: int = 5, spread: float = 3.0, allowance: float = 3.0, apart: int = 5) -> DataFrame:
    """(key, lang, n_chars, perplexity, limit, kept) for every row of ``docs``.

    ``trusted`` has the keys of documents of known quality. One in ``apart`` of them, by the
    CRC-32 of the key, is not trained on and sets the limits: per language the quartiles of
    its log-perplexity (see ``thresholds``). A language without such documents, and a NULL
    language, takes the limit over all languages. Kept is what does not exceed its limit,
    on the logarithm by more than ``allowance`` / √n_chars, as short texts vary by chance;
    NULL and empty texts have no perplexity and are not kept. Without any trusted document
    there is no limit, and every text is kept.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    known = trusted.select(F.col(key).alias("doc")).filter("doc IS NOT NULL").distinct()
    held_out = F.crc32(F.col("doc").cast("string").cast("binary")) % apart == 0
    model = train(trusted_texts(rows, known.filter(~held_out), "t", "doc"), "z", order)
    scored = cut_lineage(perplexities(rows, model, "t", ("doc", "lang")))
    sure = scored.join(known.filter(held_out), "doc", "left_semi")
    limits = cut_lineage(thresholds(sure, "lang", spread))
    overall = thresholds(sure.withColumn("lang", F.lit("")), "lang", spread).agg(F.max("limit").alias("_all"))
    limited = attach_totals(scored.join(limits, F.col("lang") == F.col("_lang"), "left"), overall)
    limit = F.coalesce("limit", "_all")
    kept = F.col("perplexity").isNotNull() & (limit.isNull() | (F.log("perplexity") <= F.log(limit) + allowance / F.sqrt("n_chars")))
    return limited.select(F.col("doc").alias(key), F.col("lang").alias(lang), "n_chars", "perplexity", limit.alias("limit"), kept.alias("kept"))
