"""Tokens of two tokenizers aligned by the byte offsets where both end one.

A text is encoded with a byte-level BPE vocabulary (A) and a sentencepiece model (B). The
cumulative ends of the tokens of one side are looked up among those of the other; the ends
that both have cut the two id lists into groups that cover the same bytes. Inside a group
every A token is linked to the B tokens whose bytes it shares.

Corpus counts: every task packs its documents into blocks and lists the different id pairs
of a block once, with their number of documents. Pairs are counted over the blocks, the
counts go back to the blocks that hold the pair, and only there meet the documents. So the
rows that travel grow with blocks times different pairs, not with tokens.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import in_batches, map_rows
from statloom.llm.vocabulary import vocabulary
from statloom.session import cut_lineage

SPACE = "▁"  # fixed value: how sentencepiece writes a blank
WINDOW = 1 << 13  # tokens sliced at a time, whatever the length of the text
BLOCK_PAIRS, BLOCK_DOCS = 1 << 20, 1 << 15


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def aligner(tokenizer: str, pieces: str) -> Aligner:
    """The aligner of two tokenizer files, loaded once per process."""
    return Aligner(tokenizer, pieces)


class Aligner:
    """Encodes with both tokenizers and slices the two id lists at their common ends."""

    def __init__(self, tokenizer: str, pieces: str):
        import sentencepiece

        self.a = vocabulary(tokenizer)
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        size = self._b.get_piece_size()
        self.b_pieces = [self._bytes(i) for i in range(size)]
        self.b_lengths = np.array([len(p) for p in self.b_pieces], dtype=np.int64)
        # decimal ids with what follows them: inside a list and, in the second half, at its end
        width = len(str(max(size, len(self.a.pieces)))) + 1
        self._written_a, self._written_b = (np.array([f"{i}{after}" for after in ("," + last) for i in range(n)], dtype=f"S{width}") for n, last in ((len(self.a.pieces), "|"), (size, ";")))

    def _bytes(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self._b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of blank + text; None for texts that are null, empty or not kept byte for byte."""
        if not text:
            return None
        spaced = " " + text
        a, b = self.a.encode_plain(spaced), self._b.encode(text)
        raw = spaced.encode()
        # the bytes of A are those of the text: its ids stand for single bytes and joins of them
        if b"".join(map(self.b_pieces.__getitem__, b)) != raw:
            return None
        return a, np.array(b, dtype=np.int64)

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """Groups as ``a1,a2|b1;a3|b2``, from the ids of a window and the last position of every group in both lists."""
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out = np.empty(len(a) + len(b), dtype=self._written_a.dtype)
        # before a token stand those of its own list, and of the other list those of earlier groups or, for B, of its own too
        half = np.zeros(len(a), dtype=np.int64)
        half[last_a] = len(self._written_a) // 2
        out[np.arange(len(a)) + np.repeat(last_b + 1 - sizes_b, sizes_a)] = self._written_a[a + half]
        half = np.zeros(len(b), dtype=np.int64)
        half[last_b] = len(self._written_b) // 2
        out[np.arange(len(b)) + np.repeat(last_a + 1, sizes_b)] = self._written_b[b + half]
        raw = out.view(np.uint8)
        return raw[raw != 0].tobytes()[:-1]

    def slices(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
        """Windows of whole groups: the ends of the tokens of both lists, the A token at or behind every end of B, which ends of B are common, and where the window begins.

        A window ends at a common end; one without any is widened.
        """
        ends_a, ends_b = self.a.lengths[a].cumsum(), self.b_lengths[b].cumsum()
        i = j = 0
        width = WINDOW
        while i < len(a):
            window_a = ends_a[i : i + width]
            window_b = ends_b[j : int(np.searchsorted(ends_b, window_a[-1], side="right"))]
            at = np.searchsorted(window_a, window_b)
            common = window_a[at] == window_b
            found = np.flatnonzero(common)
            if not len(found):
                width *= 2
                continue
            size_b = int(found[-1]) + 1
            size_a = int(at[size_b - 1]) + 1
            yield window_a[:size_a], window_b[:size_b], at[:size_b], common[:size_b], i, j
            i, j, width = i + size_a, j + size_b, WINDOW

    @staticmethod
    def linked(ends_a: np.ndarray, ends_b: np.ndarray, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the A and B tokens of a window that share bytes.

        Two tokens share bytes exactly if the one that ends first, or both, is the last to
        end before any other does: every different end of either side is one link.
        """
        own = np.flatnonzero(~common)
        return np.concatenate([np.arange(len(ends_a)), at[own]]), np.concatenate([np.searchsorted(ends_b, ends_a), own])


def align(docs: DataFrame, tokenizer: str, pieces: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, aligned, groups, links): the groups and links of every whole text.

    ``groups`` holds byte offsets into blank + text and the ids of both sides, ``links`` the
    positions of linked tokens. ``aligned`` is false, and both lists are empty, for texts
    that are null, empty or not kept byte for byte by both tokenizers. Every row is
    answered for itself: keys may be null or repeated; further columns are not looked at.
    """

    def run(columns):
        both = aligner(tokenizer, pieces)
        for k, value in zip(columns["k"], columns["t"]):
            ids = both.encode(value)
            groups, links, start = [], [], 0
            if ids is not None:
                a, b = ids
                for ends_a, ends_b, at, common, i, j in both.slices(a, b):
                    p = r = 0
                    for q, s, end in zip((at[common] + 1).tolist(), (np.flatnonzero(common) + 1).tolist(), ends_b[common].tolist()):
                        groups.append({"start": start, "end": end, "a": a[i + p : i + q].tolist(), "b": b[j + r : j + s].tolist()})
                        p, r, start = q, s, end
                    x, y = both.linked(ends_a, ends_b, at, common)
                    order = np.argsort(x + y)  # from one link to the next, either side goes on or both
                    links.extend({"a": i + p, "b": j + r} for p, r in zip(x[order].tolist(), y[order].tolist()))
            yield k, ids is not None, groups, links

    kind = docs.schema[key].dataType.simpleString()
    listed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = f"k {kind}, aligned boolean, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>"
    return map_rows(listed, run, out, 64, slice_rows=64).withColumnRenamed("k", key)


def link_statistics(docs: DataFrame, tokenizer: str, pieces: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    The count of an id pair is the number of rows whose text links it somewhere. ``n_best``
    are the links whose count is the highest of their A id, ties included; ``count_sum``
    adds the counts of all links. ``groups_sha256`` hashes the groups as ``a1,a2|b1;a3|b2``.
    Texts without tokens (see ``align``) give zeros and an empty hash; keys may be null or
    repeated, repeated rows count each, an empty table gives no row.
    """
    kind = docs.schema[key].dataType.simpleString()
    size_b = 1 << 24  # an id pair in one number
    packed = cut_lineage(_blocks(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), tokenizer, pieces, size_b, kind))
    pairs = packed.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "at")).select("block", "pos", F.col("at.pairs").alias("pair"), F.col("at.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = cut_lineage(counts.withColumn("a", F.expr(f"pair div {size_b}")))
    # one row per id of the first vocabulary at most
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    known = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = pairs.select(F.col("block").alias("asking"), "pos", "pair").join(known, "pair").select("asking", "pos", "n", "best")
    texts = packed.filter("pairs IS NULL").drop("pairs", "docs")
    out = f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(_sum_links, out).withColumnRenamed("k", key)


def _blocks(docs: DataFrame, tokenizer: str, pieces: str, size_b: int, kind: str) -> DataFrame:
    """Rows of two kinds: a document with its links as places in the pair list of its block, and the pair list of a block."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"block long, pairs array<long>, docs array<int>, k {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, uses binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = aligner(tokenizer, pieces)
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []
        pairs: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for k, value in zip(batch.column(0), batch.column(1)):
                numbers, found, uses = _digest(both, value.as_py(), size_b)
                held.append((k.as_py(), *numbers, uses))
                pairs.append(found)
                size += len(found)
                if size >= BLOCK_PAIRS or len(held) >= BLOCK_DOCS:
                    yield from in_batches(_packed(block, held, pairs), schema)
                    held, pairs, size, block = [], [], 0, block + 1
        if held:
            yield from in_batches(_packed(block, held, pairs), schema)

    return docs.mapInArrow(run, ddl)


def _packed(block: int, held: list[tuple], pairs: list[np.ndarray]) -> Iterator[tuple]:
    listed, places, docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    at = 0
    for (k, n_a, n_b, n_groups, n_links, digest, uses), own in zip(held, pairs):
        yield block, None, None, k, n_a, n_b, n_groups, n_links, digest, places[at : at + len(own)].astype("<u4").tobytes(), uses.astype("<u4").tobytes()
        at += len(own)
    yield block, listed.tolist(), docs.tolist(), None, None, None, None, None, None, None, None


def _digest(both: Aligner, text: str | None, size_b: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Sizes and hash of the groups of a text, its different linked id pairs and how often each is linked."""
    ids = both.encode(text)
    if ids is None:
        return (0, 0, 0, 0, ""), np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = ids
    digest, groups, separator, links = hashlib.sha256(), 0, b"", []
    for ends_a, ends_b, at, common, i, j in both.slices(a, b):
        own_a, own_b = a[i : i + len(ends_a)].astype(np.int64), b[j : j + len(ends_b)]
        x, y = both.linked(ends_a, ends_b, at, common)
        links.append(own_a[x] * size_b + own_b[y])
        digest.update(separator + both.written(own_a, own_b, at[common], np.flatnonzero(common)))
        groups, separator = groups + int(common.sum()), b";"
    found, uses = np.unique(np.concatenate(links), return_counts=True)
    return (len(a), len(b), groups, int(uses.sum()), digest.hexdigest()), found, uses


def _sum_links(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one block with the counts of its pairs."""
    place = answers.column("pos").to_numpy()
    counts, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    counts[place] = answers.column("n").to_numpy()
    best[place] = answers.column("best").to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for places, uses in zip(texts.column("places"), texts.column("uses")):
        at, times = np.frombuffer(places.as_py(), "<u4"), np.frombuffer(uses.as_py(), "<u4").astype(np.int64)
        n_best.append(int(best[at] @ times))
        total.append(int(counts[at] @ times))
    kept = texts.select(["k", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", texts.column("groups_sha256"))
