"""Near-duplicate documents: hash minima in bands, checked signatures, exact sets, components.

Documents with equal shingle sets form one class, named by a digest of 128 bits of every
shingle, and only classes are compared. A class is
first checked against the smallest class of each band bucket. Where a bucket still holds
several components, its other members are compared with each other by signature, block by
block inside tasks. Whatever passes is confirmed on the full sets of the texts; pairs of a
group never become rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows
from statloom.session import cut_lineage

WORDS = 5
HASHES, ROWS = 128, 4  # 32 bands: a pair at similarity 0.75 shares none with probability 5e-6
# A signature's estimate is off by 0.038 at 0.75 (one standard deviation); five are allowed.
SLACK = 0.19
BLOCK = 1024

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20260101)
_MULTIPLY = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 64, 2, dtype=np.uint64) | np.uint64(1)
CACHED_WORDS, CACHED_BYTES = 1 << 18, 64  # words kept with their digests, and how long they may be


class _Digests(dict):
    """128-bit digests of words; emptied when full, and long words are not kept."""

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = digest
        return digest


_DIGESTS = _Digests()


def shingle_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of a text's shingles, ascending, and a second hash of each.

    Words have 128-bit digests, and shingles mix those of their words: each half on its own
    gives one of the hashes. Fewer than ``WORDS`` words give the whole sequence as one
    shingle, no word gives none.
    """
    listed = (text or "").encode().lower().split()  # white space of ASCII, like the lowered letters
    if not listed:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    words = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, listed)), dtype="<u8").reshape(-1, 2)
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros((n, 2), dtype=np.uint64)
    for i in range(min(WORDS, len(words))):
        out = (out ^ (out >> np.uint64(29))) * _MIX[1] + words[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX[0]
    first, at = np.unique(out[:, 0], return_index=True)
    return first, out[at, 1]


def signature(shingles: np.ndarray) -> bytes:
    """``HASHES`` minima of multiply-add hashes, 32 bits each."""
    least = np.full(HASHES, _MASK, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = _MULTIPLY[:, None] * shingles[None, i : i + 2048] + _ADD[:, None]
        least = np.minimum(least, part.min(axis=1))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def shingle_set(text: str | None) -> set:
    """The shingles themselves, for the last check."""
    words = (text or "").encode().lower().split()
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS))))


def _sketches(columns):
    for h1, h2, doc, text in zip(columns["h1"], columns["h2"], columns["doc"], columns["t"]):
        shingles, second = shingle_hashes(text)
        some = len(shingles) > 0
        yield h1, h2, doc, len(shingles), hashlib.blake2b(shingles.tobytes() + second.tobytes(), digest_size=16).digest() if some else None, signature(shingles) if some else None


def similar(a: set, b: set, similarity: int) -> bool:
    common = len(a & b)
    return 100 * common >= similarity * (len(a) + len(b) - common)


def _row_hashes(text: str, key: str):
    return F.xxhash64(F.col(key), F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias("h2")


def _estimates(columns):
    """Pairs whose signatures agree often enough."""
    for u, v, a, b in zip(columns["u"], columns["v"], columns["sig_u"], columns["sig_v"]):
        if _agree(a, b) >= columns["floor"][0]:
            yield u, v


def _agree(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")))


def _likely(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Signature verification of (u, v)."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.withColumnRenamed("node", "u").withColumnRenamed("sig", "sig_u"), "u").join(sig.withColumnRenamed("node", "v").withColumnRenamed("sig", "sig_v"), "v")
    return map_rows(both.withColumn("floor", F.lit(floor)), _estimates, "u long, v long")


def _texts_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, text: str, key: str) -> DataFrame:
    """(node, t): one text of each of the classes."""
    wanted = classes.select("node", F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2")).join(nodes.distinct(), "node")
    rows = docs.select(*_row_hashes(text, key), F.col(text).alias("t")).join(wanted, ["h1", "h2"])
    return cut_lineage(rows.groupBy("h1", "h2", "node").agg(F.min("t").alias("t")).select("node", "t"))


def _confirm(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity, in percent."""

    def run(columns):
        held: dict = {}
        for u, v, a, b in zip(columns["u"], columns["v"], columns["a"], columns["b"]):
            if v not in held:
                held = {v: shingle_set(b)}
            if similar(shingle_set(a), held[v], similarity):
                yield u, v

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("t").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("t").alias("b")), "v")
    return map_rows(both, run, "u long, v long")


def _across(similarity: int, floor: float):
    """Links between components inside a block, or between two blocks, of a bucket.

    Pairs are looked at in the order of their estimates, only in the first bucket that they
    share, and only while no link found here has joined their components.
    """

    def run(columns):
        for members, lo, hi, band in zip(columns["members"], columns["lo"], columns["hi"], columns["band"]):
            left = [m for m in members if m["part"] == lo]
            right = left if lo == hi else [m for m in members if m["part"] == hi]
            if not left or not right:
                continue
            matrix = np.frombuffer(b"".join(m["sig"] for m in right), "<u4").reshape(len(right), HASHES)
            nodes, roots = np.array([m["node"] for m in right]), np.array([m["root"] for m in right])
            likely = []
            for i, m in enumerate(left):
                near = np.flatnonzero((roots != m["root"]) & ((nodes > m["node"]) | (lo != hi)))
                equal = matrix[near] == np.frombuffer(m["sig"], "<u4")
                agree = equal.mean(axis=1)
                first = equal.reshape(len(near), HASHES // ROWS, ROWS).all(axis=2).argmax(axis=1)
                hit = (agree >= floor) & (first == band)
                likely += zip((-agree[hit]).tolist(), [i] * int(hit.sum()), near[hit].tolist())
            parent, sets = {}, {}

            def head(x):
                while x in parent:
                    x = parent[x]
                return x

            def shingles(m):
                if m["node"] not in sets:
                    sets[m["node"]] = shingle_set(m["t"])
                return sets[m["node"]]

            for _, i, j in sorted(likely):
                a, b = head(left[i]["root"]), head(right[j]["root"])
                if a != b and similar(shingles(left[i]), shingles(right[j]), similarity):
                    parent[a] = b
                    yield left[i]["node"], right[j]["node"]

    return run


def _remaining(members: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, similarity: int) -> DataFrame:
    """Links that the bucket leaders did not find.

    Only buckets whose members other than the leader lie in several components are left. A
    large one is dealt into blocks, every two of which meet in one row with signatures and
    texts, so pairs never become rows before they are confirmed.
    """
    placed = members.filter("node <> leader").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).filter("a <> b")
    mixed = cut_lineage(mixed.select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")))
    rows = cut_lineage(placed.select("bucket", "band", "node", "root").join(mixed, "bucket"))
    known = classes.select("node", "sig").join(_texts_of(rows.select("node"), docs, classes, text, key), "node")
    dealt = rows.join(known, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = F.struct("node", "root", "part", "sig", "t")
    blocks = dealt.groupBy("bucket", "band", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi")).agg(F.collect_list(member).alias("members"))
    return map_rows(blocks.filter(F.size("members") > 1), _across(similarity, similarity / 100 - SLACK), "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes in edges (u, v): the smallest node that can be reached.

    Large-star hangs every larger neighbour of a node on the smallest of its neighbourhood,
    small-star every smaller one, until the edges form stars. Minima are grouped (with
    partial sums) and written before they are joined, so a hub can be split by the join.
    """
    star = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        ends = star.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out")))).alias("e"))
        roles = ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.count("*").alias("all"))
        if roles.filter("out > 1 OR (out > 0 AND out < all)").isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        star = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = cut_lineage(star.groupBy("u").agg(F.min("v").alias("m")))
        moved = star.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut_lineage(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept, h1, h2) for every row of ``docs``.

    Rows are linked where their sets of five-word shingles (ASCII letters in lower case)
    reach ``similarity`` percent. ``component_id`` is the smallest key of all rows reached,
    ``kept`` marks one row of each component: the one with the smallest key, of rows that
    share it the one with the smallest hash. A NULL key sorts last; NULL texts and texts
    without a word are linked with nothing and kept. Rows that repeat key and text are one
    document, so they share ``kept`` and the hashes h1 and h2 that identify the row.
    """
    rows = docs.select(*_row_hashes(text, key), F.col(key).alias("doc"), F.col(text).alias("t"))
    kind = dict(docs.dtypes)[key]
    sketch = cut_lineage(map_rows(rows, _sketches, f"h1 long, h2 long, doc {kind}, n_shingles long, set_id binary, sig binary"))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "h1", "h2")
    classes = sketch.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(order).alias("first"), F.first("sig").alias("sig"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))

    step = 4 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, F.substr("sig", b * step + 1, F.lit(step))))
    bands = classes.select("node", F.posexplode(band).alias("band", "bucket"))
    heads = cut_lineage(bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("bucket", "leader"))
    members = cut_lineage(bands.join(heads, "bucket"))
    floor = similarity / 100 - SLACK
    pairs = members.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = cut_lineage(_likely(pairs, classes, floor))
    texts = _texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), docs, classes, text, key)
    roots = cut_lineage(components(_confirm(pairs, texts, similarity)))
    more = cut_lineage(_remaining(members, roots, classes, docs, text, key, similarity))
    if not more.isEmpty():
        roots = cut_lineage(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)))

    smallest = cut_lineage(roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("head")))
    linked = cut_lineage(roots.join(smallest, "root").select("node", "head"))
    named = cut_lineage(classes.select("node", "set_id", "first").join(linked, "node", "left").select("set_id", F.coalesce("head", "first").alias("head")))
    placed = sketch.drop("sig").join(named, "set_id", "left").withColumn("head", F.coalesce("head", order))
    return placed.select(F.col("doc").alias(key), "n_shingles", F.col("head.doc").alias("component_id"), ((F.col("head.h1") == F.col("h1")) & (F.col("head.h2") == F.col("h2"))).alias("kept"), "h1", "h2")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: int = 75) -> DataFrame:
    """``docs`` with one row of each component, and of rows that repeat key and text."""
    kept = near_duplicates(docs, text, key, similarity).filter("kept").select("h1", "h2").distinct()
    h1, h2 = _row_hashes(text, key)
    taken = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), h1, h2).join(kept, ["h1", "h2"])
    return taken.groupBy("h1", "h2").agg(F.first("_row").alias("_row")).select("_row.*")
