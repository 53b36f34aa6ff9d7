"""Byte-level BPE where chunks that texts share are encoded once.

Texts are cut where a rolling hash of the last bytes says so, hence equal passages give
equal chunks. The first text that holds a shared chunk encodes it, the others take its ids.
Ids at a join of two chunks may be wrong; there the text between the nearest places where
any encoding of the surroundings must begin a new token is encoded again.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows
from statloom.llm.vocabulary import Vocabulary, vocabulary
from statloom.session import cut_lineage

WINDOW, SHORTEST, LONGEST = 48, 256, 8192
CUT_BITS = 10  # a cut about every 2^10 bytes after the shortest length

_rng = np.random.default_rng(20260102)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1


def rolling(raw: np.ndarray) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at every byte; doubling steps add up the window."""
    total, base, size, out, done = _BYTE[raw], _BASE, 1, None, 0
    length = WINDOW
    # the window is the sum of its powers of two, the most recent part first
    while length:
        if length & 1:
            part = np.zeros_like(total)
            if done < len(raw):
                part[done:] = total[: len(raw) - done] if done else total
            out = part if out is None else out + part * np.uint64(pow(_BASE, done, 1 << 64))
            done += size
        grown = total.copy()
        grown[size:] += total[:-size] * np.uint64(base) if size < len(raw) else 0
        total, base, size, length = grown, base * base % (1 << 64), size * 2, length >> 1
    return out


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text, each ``SHORTEST`` to ``LONGEST`` bytes but for the last."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    raw = np.frombuffer(text, dtype=np.uint8)
    ends = np.flatnonzero(rolling(raw) >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, last = [], 0
    while n - last > SHORTEST:
        i = np.searchsorted(ends, last + SHORTEST)
        end = int(ends[i]) if i < len(ends) and ends[i] - last <= LONGEST else min(last + LONGEST, n)
        while end < n and raw[end] & 0xC0 == 0x80:  # whole code points only
            end += 1
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


class Joiner:
    """Joins the ids of neighbouring chunks into the ids of the whole text."""

    def __init__(self, vocab: Vocabulary):
        self._vocab = vocab
        self._opens = np.array([p[:1] in (b" ", b"\n") for p in vocab.pieces])
        self._solid = np.array([len(p) > 0 and 0x21 <= p[-1] <= 0x7E for p in vocab.pieces])

    def _safe(self, ids: np.ndarray) -> np.ndarray:
        """Places where a blank follows a visible ASCII character.

        No token of the word pattern, and no special token, holds a visible character before
        a blank, and the pattern looks back at nothing: what stands on either side of such a
        place is encoded independently of the other.
        """
        return np.flatnonzero(self._opens[ids[1:]] & self._solid[ids[:-1]]) + 1

    def join(self, chunks: list[np.ndarray]) -> np.ndarray:
        """Ids of the whole text from the ids of all its chunks in order."""
        vocab, out, pending = self._vocab, [], None
        for ids in chunks:
            if not len(ids):
                continue
            if pending is None:
                head, rest = None, ids
            else:
                near = self._safe(ids[:64])
                places = near if len(near) else self._safe(ids)
                if not len(places):
                    # nothing in this chunk is independent yet: it joins what is encoded again
                    pending = np.concatenate([pending, ids])
                    continue
                head, rest = np.concatenate([pending, ids[: places[0]]]), ids[places[0] :]
            if head is not None:
                out.append(self._again(head))
            near = self._safe(rest[-64:])
            if len(near):
                at = max(len(rest) - 64, 0) + int(near[-1])
            else:
                places = self._safe(rest)
                at = int(places[-1]) if len(places) else 0
            out.append(rest[:at])
            pending = rest[at:]
        if pending is not None:
            out.append(self._again(pending))
        return np.concatenate(out).astype(np.uint32) if out else np.empty(0, np.uint32)

    def _again(self, ids: np.ndarray) -> np.ndarray:
        return self._vocab.encode(self._vocab.decode(ids.tolist()).decode())


def digests(vocab: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, hash of the ids and hash of the text decoded from them."""
    numbers = ids.tolist()
    listed = ",".join(map(vocab.decimals.__getitem__, numbers)).encode()
    decoded = vocab.decode(numbers).decode("utf-8", "replace").encode()
    return len(numbers), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _name(chunk) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunk_names(columns):
    for t1, t2, text in zip(columns["t1"], columns["t2"], columns["t"]):
        raw, begin = text.encode(), 0
        for n, end in enumerate(cuts(raw)):
            yield t1, t2, n, _name(raw[begin:end])
            begin = end


def _packed(columns):
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for t1, t2, text in zip(columns["t1"], columns["t2"], columns["t"]):
        yield t1, t2, packer.compress(text.encode())


DONE, SHARED, WAITING = 0, 1, 2
_WORK = "kind int, t1 long, t2 long, seq int, name binary, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoder(tokenizer: str):
    """Encodes what a text does not borrow; a text that borrows nothing is finished here."""
    joiner: list[Joiner] = []

    def run(columns):
        import zstandard

        vocab = vocabulary(tokenizer)
        if not joiner:
            joiner.append(Joiner(vocab))
        unpacker = zstandard.ZstdDecompressor()
        for t1, t2, packed, plan in zip(columns["t1"], columns["t2"], columns["z"], columns["plan"]):
            raw = unpacker.decompress(packed)
            mine = {p["seq"]: p["name"] for p in plan or () if p["own"]}
            borrowed = {p["seq"] for p in plan or () if not p["own"]}
            runs, begin, first = [], 0, True
            for n, end in enumerate(cuts(raw)):
                if n in borrowed:
                    first = True
                else:
                    ids = vocab.encode(raw[begin:end].decode())
                    if n in mine:
                        yield SHARED, None, None, None, mine[n], ids.astype(vocab.width).tobytes(), None, None, None
                    if first:
                        runs.append((n, []))
                        first = False
                    runs[-1][1].append(ids)
                begin = end
            if borrowed:
                for n, parts in runs:
                    yield WAITING, t1, t2, n, None, joiner[0].join(parts).astype(vocab.width).tobytes(), None, None, None
            else:
                yield DONE, t1, t2, None, None, None, *digests(vocab, joiner[0].join(runs[0][1] if runs else []))

    return run


def _finisher(tokenizer: str):
    joiner: list[Joiner] = []

    def run(columns):
        vocab = vocabulary(tokenizer)
        if not joiner:
            joiner.append(Joiner(vocab))
        for t1, t2, parts in zip(columns["t1"], columns["t2"], columns["parts"]):
            ordered = [np.frombuffer(p["ids"], vocab.width) for p in sorted(parts, key=lambda p: p["seq"])]
            yield t1, t2, *digests(vocab, joiner[0].join(ordered))

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    The ids are those of the tokenizers library for the whole text without added special
    tokens; special tokens that stand in a text are recognised. The hashes are of the
    decimal ids joined by commas and of the text decoded from the ids. A NULL text counts
    as empty. Equal texts are encoded once, and each row gets the answer of its text.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    t1, t2 = F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(1), value).alias("t2")
    texts = docs.select(t1, t2, value.alias("t"))
    # where chunks occur; a chunk at one place only is nobody else's
    places = cut_lineage(map_rows(texts, _chunk_names, "t1 long, t2 long, seq int, name binary", 20_000))
    place = F.struct("t1", "t2", "seq")
    shared = places.groupBy("name").agg(F.min(place).alias("owner"), F.max(place).alias("other")).filter("owner <> other").select("name", "owner")
    plan = cut_lineage(places.join(cut_lineage(shared), "name").select("t1", "t2", "seq", "name", (place == F.col("owner")).alias("own")).distinct())
    plans = plan.groupBy("t1", "t2").agg(F.collect_list(F.struct("seq", "name", "own")).alias("plan"))
    packed = map_rows(texts, _packed, "t1 long, t2 long, z binary").groupBy("t1", "t2").agg(F.first("z").alias("z"))
    work = cut_lineage(map_rows(packed.join(plans, ["t1", "t2"], "left"), _encoder(tokenizer), _WORK, 256))

    known = work.filter(F.col("kind") == SHARED).select("name", "ids")
    taken = plan.filter("NOT own").join(known, "name").select("t1", "t2", "seq", "ids")
    parts = work.filter(F.col("kind") == WAITING).select("t1", "t2", "seq", "ids").unionByName(taken)
    whole = parts.groupBy("t1", "t2").agg(F.collect_list(F.struct("seq", "ids")).alias("parts"))
    answer = "t1 long, t2 long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    finished = map_rows(whole, _finisher(tokenizer), answer, 256)
    done = work.filter(F.col("kind") == DONE).select("t1", "t2", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(finished)
    return docs.select(F.col(key), t1, t2).join(cut_lineage(done), ["t1", "t2"]).drop("t1", "t2")
