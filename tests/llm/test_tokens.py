"""BPE by shared chunks and token files, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from statloom.llm import bpe_chunks, token_files
from statloom.llm.vocabulary import default_path, vocabulary
from statloom.session import work_path
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def strange(rng, n):
    parts = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "<|", "'s", "é", "日本", "1", "!", " ", "　", "\t", "😀", "‍", "word"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_vocabulary_agrees_with_the_library(library):
    rng, vocab = random.Random(1), vocabulary(default_path())
    for text in [strange(rng, 300) for _ in range(100)] + [prose(rng, 200), "a" * 5000, " " * 5000 + "x", ""]:
        ids = vocab.encode(text).tolist()
        assert ids == ids_of(library, text)
        assert vocab.decode(ids).decode() == text


def test_joins_are_repaired_wherever_a_text_is_cut(library):
    rng, vocab = random.Random(2), vocabulary(default_path())
    joiner = bpe_chunks.Joiner(vocab)
    for text in [strange(rng, 200) for _ in range(150)] + [prose(rng, 60) for _ in range(50)] + ["q" * 400, "日本" * 200]:
        places = sorted(rng.sample(range(1, len(text)), 6))
        parts = [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]
        assert joiner.join([vocab.encode(p) for p in parts]).tolist() == ids_of(library, text)


def test_cuts_follow_the_content():
    rng = random.Random(3)
    middle = prose(rng, 4000).encode()
    a, b = prose(rng, 300).encode() + middle, prose(rng, 77).encode() + middle
    chunks = [{t[i:j] for i, j in zip([0, *c], c)} for t, c in ((a, bpe_chunks.cuts(a)), (b, bpe_chunks.cuts(b)))]
    shared = sum(map(len, chunks[0] & chunks[1]))
    assert shared > 0.7 * len(middle)
    for text in (b"", b"a", b"a" * 100_000, "é".encode() * 30_000, middle):
        ends = bpe_chunks.cuts(text)
        assert (ends[-1] if ends else 0) == len(text) and ends == sorted(set(ends))
        for i, j in zip([0, *ends], ends):
            text[i:j].decode()


def test_rolling_hash_is_that_of_the_window():
    raw = np.random.default_rng(0).integers(0, 256, 200).astype(np.uint8)
    for n in (1, 30, 48, 49, 200):
        whole = bpe_chunks.rolling(raw[:n])
        for i in range(n):
            window = raw[max(0, i + 1 - bpe_chunks.WINDOW) : i + 1]
            assert whole[i] == bpe_chunks.rolling(window)[-1]


def test_encode_every_row(spark, odd, library):
    rng = random.Random(4)
    shared = prose(rng, 900)
    more = [(100 + i, prose(rng, 50 * i) + shared + prose(rng, 30)) for i in range(6)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = bpe_chunks.encode(docs, default_path()).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(library, r["text"])
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_encode_empty(empty):
    assert bpe_chunks.encode(empty, default_path()).count() == 0


def test_token_files_round_trip(spark, odd, library):
    path = work_path(spark)
    token_files.write_token_files(odd, path, default_path(), frame_tokens=500)
    read = token_files.with_starts(token_files.read_token_files(spark, path)).collect()
    texts = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(read) == len(texts)
    read = sorted(read, key=lambda r: r["start"] + (0.5 if r["n_tokens"] else 0))
    start = 0
    for r in read:
        assert r["start"] == start
        start += r["n_tokens"]
        assert r["ids"][-1] == 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert [r["doc_id"] for r in read] == [r[0] for r in texts]
    assert sorted(map(str, ((r["doc_id"], r["ids"]) for r in read))) == sorted(map(str, ((k, [*ids_of(library, t), 0]) for k, t in texts)))


def test_token_files_are_zstandard_and_read_by_document(spark, odd):
    path = work_path(spark)
    token_files.write_token_files(odd.coalesce(1), path, default_path(), frame_tokens=200)
    for row in spark.read.format("binaryFile").load(path).filter("length > 0").collect():
        content = bytes(row["content"])
        file = token_files.TokenFile(content)
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert whole == b"".join(file.ids(i).tobytes() for i in range(len(file)))
        if file.seek:
            # a damaged frame is noticed by those who read it, and by nobody else
            broken = bytearray(content)
            broken[file.offsets[len(file.seek) - 1] + file.seek[-1][0] // 2] ^= 0xFF
            damaged = token_files.TokenFile(bytes(broken))
            if len(file.seek) > 1:
                assert damaged.ids(0).tolist() == file.ids(0).tolist()
            with pytest.raises((ValueError, zstandard.ZstdError)):
                damaged.ids(len(file) - 1)
    some = token_files.read_token_files(spark, path, wanted=[6, 7])
    assert sorted(r["doc_id"] for r in some.collect()) == [6, 6, 7]


def test_token_files_of_an_empty_table(spark, empty):
    path = work_path(spark)
    token_files.write_token_files(empty, path, default_path())
    assert token_files.read_token_files(spark, path).count() == 0
