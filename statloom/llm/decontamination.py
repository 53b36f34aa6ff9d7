"""Benchmark passages in documents, found within a budget of edits.

An item that may differ in ``k`` characters is cut into ``k + 1`` pieces: one of them must
stand in the document unchanged. All pieces are searched at once; a hit is verified upward
through a tree over the pieces (a node of ``n`` pieces may hold ``n - 1`` edits) with
Myers' bit-parallel edit distance, so most chance hits end after some twenty characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows
from statloom.session import cut_lineage

_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(text: str) -> str:
    """ASCII letters in lower case, every run of white space one blank."""
    return b" ".join(text.encode().lower().split()).decode()


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


class Pattern:
    """A string with its character masks, forward and backward."""

    def __init__(self, text: str):
        self.size = len(text)
        self.masks, self.back = {}, {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
            self.back[c] = self.back.get(c, 0) | 1 << (self.size - 1 - i)

    def best(self, window: str, limit: int, backward: bool = False, anchored: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the best match of the whole pattern ending in the window, the first of equals.

        ``anchored`` makes the match begin where the window begins. None beyond ``limit``.
        """
        masks, top = (self.back if backward else self.masks), 1 << (self.size - 1)
        all_bits = (top << 1) - 1
        up, down, score, found = all_bits, 0, self.size, None
        for end, c in enumerate(window, 1):
            eq = masks.get(c, 0)
            zero = ((((eq & up) + up) ^ up) | eq | down) & all_bits
            right = down | (all_bits & ~(zero | up))
            left = up & zero
            if right & top:
                score += 1
            elif left & top:
                score -= 1
            right = (right << 1 | anchored) & all_bits
            left = left << 1 & all_bits
            up = left | (all_bits & ~(zero | right))
            down = right & zero
            if score <= limit and (found is None or score < found[0]):
                found = (score, end)
                if not score:
                    break
        return found


class Item:
    """One test item: its pieces and the nodes above each of them."""

    def __init__(self, text: str, error_rate: float):
        self.size, self.limit = len(text), budget(len(text), error_rate)
        n = self.limit + 1
        cuts = [len(text) * i // n for i in range(n + 1)]
        self.pieces = [(cuts[i], text[cuts[i] : cuts[i + 1]]) for i in range(n)]
        self.above: list[list[tuple[int, int, Pattern]]] = [[] for _ in range(n)]
        self.near: list[list[str]] = [[] for _ in range(n)]

        def grow(lo: int, hi: int) -> None:
            if hi - lo == 1 < n:
                return
            node = (cuts[lo], hi - lo - 1, Pattern(text[cuts[lo] : cuts[hi]]))
            middle = (lo + hi) // 2
            for leaf in range(lo, hi):
                self.above[leaf].insert(0, node)
                # beside an exact piece the errors fall on the rest of its lowest node: of one
                # part more than errors, cut from the rest, one must stand unchanged
                rest = [text[cuts[lo] : cuts[leaf]], text[cuts[leaf + 1] : cuts[hi]]]
                longer = max(rest, key=len)
                self.near[leaf] = [longer[len(longer) * i // (hi - lo) : len(longer) * (i + 1) // (hi - lo)] for i in range(hi - lo)]
            if hi - lo > 1:
                grow(lo, middle)
                grow(middle, hi)

        grow(0, n)

    def at(self, text: str, leaf: int, start: int) -> tuple[int, int, int] | None:
        """(start, end, distance) of the best match around an exact hit of a piece, or None."""
        shift = start - self.pieces[leaf][0]
        offset, limit, pattern = self.above[leaf][0]
        close = text[max(0, shift + offset - limit) : max(0, shift + offset + pattern.size + limit)]
        if not any(part in close for part in self.near[leaf]):
            return None
        for offset, limit, pattern in self.above[leaf]:
            lo = max(0, shift + offset - limit)
            window = text[lo : max(0, shift + offset + pattern.size + limit)]
            found = pattern.best(window, limit)
            if not found:
                return None
        distance, end = found
        head = window[:end][::-1]
        begin = pattern.best(head, distance, backward=True, anchored=True)
        return lo + end - begin[1], lo + end, distance


def matches(text: str, items: list[Item], automaton) -> Iterator[tuple[int, int, int, int]]:
    """(item number, start, end, distance) in a plain text, each occurrence once."""
    # hits come in the order of their ends: only spans that reach beyond one can hold it
    reaching: dict[int, list[tuple[int, int]]] = {}
    taken: set[tuple[int, int, int]] = set()
    for last, owners in automaton.iter(text):
        for number, leaf in owners:
            item = items[number]
            start = last + 1 - len(item.pieces[leaf][1])
            spans = reaching[number] = [s for s in reaching.get(number, ()) if last < s[1]]
            if any(a <= start for a, _ in spans):
                continue
            found = item.at(text, leaf, start)
            if found and (number, *found[:2]) not in taken:
                taken.add((number, *found[:2]))
                spans.append(found[:2])
                yield number, *found


def search(items: list[str], error_rate: float):
    """The items prepared, and an automaton over all their pieces."""
    import ahocorasick

    prepared, owners = [Item(t, error_rate) for t in items], {}
    for number, item in enumerate(prepared):
        for leaf, (_, piece) in enumerate(item.pieces):
            owners.setdefault(piece, []).append((number, leaf))
    automaton = ahocorasick.Automaton()
    for piece, held in owners.items():
        automaton.add_word(piece, held)
    automaton.make_automaton()
    return prepared, automaton


def to_original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the plain text as code points of the text itself."""
    words = [m.span() for m in _WORD.finditer(text)]
    place, at = [], 0
    for begin, end in words:
        place.append(at)
        at += end - begin + 1

    def back(i: int) -> int:
        import bisect

        n = bisect.bisect_right(place, i) - 1
        return min(words[n][0] + i - place[n], words[n][1])

    return [(back(a), back(b - 1) + 1) for a, b in spans]


def blocks_of(items: DataFrame, text: str, key: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters, each collected on its own."""
    known = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    size = known.agg(F.sum(F.length("t") + 16)).head()[0] or 0
    n = -(-size // block_chars)
    for i in range(n):
        rows = known.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == i).collect()
        yield sorted(((r["k"], plain(r["t"])) for r in rows), key=lambda r: (r[1], str(r[0])))


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", error_rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """(key, item, start, end, distance): test items found in whole documents.

    An item matches where it stands with at most ``error_rate`` × its length edits, letter
    case and white space aside; start and end are code points of the document. Items go to
    the tasks in blocks of ``block_chars`` characters, each block one pass over all
    documents, so that no task holds more than a block. NULL or blank items match nothing,
    NULL or empty documents hold nothing; equal items are all reported, repeated documents
    each give their rows.
    """
    spark = docs.sparkSession
    doc_type, item_type = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {doc_type}, item {item_type}, start long, end long, distance long"
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    found = spark.createDataFrame([], schema)
    for block in blocks_of(items, item_text, item_key, block_chars):
        block = [(k, t) for k, t in block if t]
        if block:
            found = found.unionByName(map_rows(narrow, _finder(spark.sparkContext.broadcast(block), error_rate), schema))
    return found


def _finder(held, error_rate: float):
    kept: list = []

    def run(columns):
        if not kept:
            kept.extend(search([t for _, t in held.value], error_rate))
        prepared, automaton = kept
        for doc, value in zip(columns["k"], columns["t"]):
            hits = list(matches(plain(value), prepared, automaton))
            if hits:
                for (number, _, _, distance), (start, end) in zip(hits, to_original(value, [h[1:3] for h in hits])):
                    yield doc, held.value[number][0], start, end, distance

    return run


def _blocks(items: DataFrame, item_text: str, item_key: str, block_chars: int) -> list[list[tuple]]:
    found = ([(k, t) for k, t in block if t] for block in blocks_of(items, item_text, item_key, block_chars))
    return [block for block in found if block]


def _items_of(held, error_rate: float):
    """text -> the keys of the items in it, each once."""
    kept: list = []

    def run(value: str | None) -> set:
        if not value or not held.value:
            return set()
        if not kept:
            kept.extend(search([t for _, t in held.value], error_rate))
        return {held.value[hit[0]][0] for hit in matches(plain(value), *kept)}

    return run


def _digest(docs: DataFrame, text: str):
    return F.sha2(docs[text].cast("binary"), 256)


def _by_text(docs: DataFrame, items: DataFrame, text: str, **options) -> DataFrame:
    """(_text, item), distinct: the items found, by the digest of the text that holds them."""
    rows = docs.select(_digest(docs, text).alias("_text"), docs[text].alias("t"))
    return cut_lineage(find_passages(rows, items, text="t", key="_text", **options)).select("_text", "item").distinct()


def mark_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text", item_key: str = "item_id", error_rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """``docs`` with contaminated, n_items and items (ascending, comma-joined).

    Every row is judged by its own text: rows that share a key, or have none, get separate
    answers, and ``key`` plays no part. One block of items is searched in one pass that
    marks the rows; what several blocks find is written once, then joined by the digest of
    the text. Columns of ``docs`` with these names are replaced.
    """
    plain_docs = docs.drop("contaminated", "n_items", "items")
    blocks = _blocks(items, item_text, item_key, block_chars)
    if len(blocks) > 1:
        found = _by_text(plain_docs, items, text, item_text=item_text, item_key=item_key, error_rate=error_rate, block_chars=block_chars)
        per_text = found.groupBy("_text").agg(F.count("*").alias("_n"), F.collect_set("item").alias("_items"))
        joined = plain_docs.join(per_text, _digest(plain_docs, text) == per_text["_text"], "left")
        columns, n, held = [plain_docs[c] for c in plain_docs.columns], F.coalesce(per_text["_n"], F.lit(0)).cast("long"), per_text["_items"]
    else:
        joined = _marked(plain_docs, text, docs.sparkSession.sparkContext.broadcast(blocks[0] if blocks else []), items.schema[item_key].dataType, error_rate)
        columns, n, held = [joined[c] for c in plain_docs.columns], F.size("items").cast("long"), joined["items"]
    listed = F.coalesce(F.array_join(F.transform(F.array_sort(held), lambda i: i.cast("string")), ","), F.lit(""))
    return joined.select(*columns, (n > 0).alias("contaminated"), n.alias("n_items"), listed.alias("items"))


def _marked(docs: DataFrame, text: str, held, kind, error_rate: float) -> DataFrame:
    """``docs`` and ``items``, the keys of the items in every text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType

    added = StructType([StructField("items", ArrayType(kind))])
    target = to_arrow_schema(added).field(0).type
    find = _items_of(held, error_rate)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [list(find(t)) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, target)], names=[*batch.schema.names, "items"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text", item_key: str = "item_id", error_rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose own text holds a test item; all columns stay.

    Rows that share a key, or have none, are judged one by one; ``key`` plays no part.
    """
    blocks = _blocks(items, item_text, item_key, block_chars)
    if len(blocks) > 1:
        found = _by_text(docs, items, text, item_text=item_text, item_key=item_key, error_rate=error_rate, block_chars=block_chars).select("_text").distinct()
        return docs.join(found, _digest(docs, text) == found["_text"], "left_anti")
    find = _items_of(docs.sparkSession.sparkContext.broadcast(blocks[0] if blocks else []), error_rate)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([not find(t) for t in values], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
