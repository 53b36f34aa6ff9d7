"""Tokens of two tokenizers, against all pairs of byte ranges."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from statloom.llm import alignment
from statloom.llm.vocabulary import PRINTABLE, default_path, vocabulary
from tests.llm.conftest import prose

BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(default_path())
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def ranges(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, rows):
    """Rows of the query from all pairs of tokens of every text."""
    first, second = libraries
    parts, pair_docs = [], Counter()
    for key, text in rows:
        value = None
        if text:
            raw = (" " + text).encode()
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            bytes_a = [bytes(BYTE_OF[c] for c in first.id_to_token(i)) for i in a]
            pieces = [second.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ra, rb = ranges(bytes_a), ranges(bytes_b)
                links = [(a[i], b[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
                ends = sorted({x[1] for x in ra} & {y[1] for y in rb})
                groups = []
                for lo, hi in zip([0, *ends], ends):
                    groups.append(",".join(str(i) for i, r in zip(a, ra) if lo < r[1] <= hi) + "|" + ",".join(str(i) for i, r in zip(b, rb) if lo < r[1] <= hi))
                value = (a, b, links, groups)
                pair_docs.update(set(links))
        parts.append((key, value))
    top = defaultdict(int)
    for (a, _), n in pair_docs.items():
        top[a] = max(top[a], n)
    for key, value in parts:
        if value is None:
            yield (key, 0, 0, 0, 0, 0, 0, "")
        else:
            a, b, links, groups = value
            best = sum(pair_docs[x] == top[x[0]] for x in links)
            yield (key, len(a), len(b), len(groups), len(links), best, sum(pair_docs[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


def strange(rng, n):
    parts = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "é", "日本", "1", "!", "　", "\t", "😀", "‍", "word", "ﬁ", "\x00", "the "]
    return "".join(rng.choice(parts) for _ in range(n))


def compared(spark, libraries, docs):
    got = sorted(map(str, map(tuple, alignment.link_statistics(docs, default_path(), alignment.default_pieces()).collect())))
    assert got == sorted(map(str, brute(libraries, [tuple(r) for r in docs.select("doc_id", "text").collect()])))


def test_statistics_equal_all_pairs_of_ranges(spark, libraries):
    rng = random.Random(1)
    rows = [(i, strange(rng, rng.randint(0, 60)) if i % 2 else prose(rng, rng.randint(0, 40))) for i in range(150)]
    rows += [(200, "a ▁ b"), (201, "ends in blank "), (202, " "), (203, "\n\n"), (204, None), (205, rows[1][1]), (205, rows[1][1])]
    compared(spark, libraries, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_nulls_repeats_clashing_columns_and_long_texts(spark, libraries, odd):
    compared(spark, libraries, odd.withColumn("text", odd["text"].substr(1, 1500)).withColumns({c: odd["k"] for c in ("pair", "pos", "n", "best", "places", "docs", "pairs", "a")}))
    long_text = prose(random.Random(2), 30_000)
    (row,) = alignment.link_statistics(spark.createDataFrame([("long", long_text)], "doc_id string, text string"), default_path(), alignment.default_pieces()).collect()
    assert row["doc_id"] == "long" and row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] and row["count_sum"] == row["n_links"]


def test_empty_table(empty):
    assert alignment.link_statistics(empty, default_path(), alignment.default_pieces()).count() == 0
    assert alignment.align(empty, default_path(), alignment.default_pieces()).count() == 0


def test_windows_do_not_change_the_groups(monkeypatch):
    both, rng = alignment.aligner(default_path(), alignment.default_pieces()), random.Random(3)
    for text in [prose(rng, 300), strange(rng, 400), "日本" * 200, "x" * 3000, "😀" * 50]:
        whole = alignment._digest(both, text, 1 << 24)
        for width in (1, 2, 7):
            monkeypatch.setattr(alignment, "WINDOW", width)
            other = alignment._digest(both, text, 1 << 24)
            assert other[0] == whole[0] and sorted(zip(other[1], other[2])) == sorted(zip(whole[1], whole[2]))
        monkeypatch.setattr(alignment, "WINDOW", 1 << 13)


def test_small_blocks_do_not_change_the_counts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 30)
    rng = random.Random(4)
    compared(spark, libraries, spark.createDataFrame([(i, prose(rng, 20)) for i in range(60)], "doc_id long, text string").repartition(2))


def test_groups_and_links_with_places(spark, libraries):
    rows = alignment.align(spark.createDataFrame([(1, "Straße überall 日本 tokenization"), (2, None)], "doc_id long, text string"), default_path(), alignment.default_pieces()).orderBy("doc_id").collect()
    raw, both = b" " + "Straße überall 日本 tokenization".encode(), alignment.aligner(default_path(), alignment.default_pieces())
    assert rows[0]["aligned"] and not rows[1]["aligned"] and rows[1]["groups"] == [] == rows[1]["links"]
    assert [g["start"] for g in rows[0]["groups"]] == [0, *[g["end"] for g in rows[0]["groups"]][:-1]] and rows[0]["groups"][-1]["end"] == len(raw)
    for g in rows[0]["groups"]:
        assert both.a.decode(g["a"]) == raw[g["start"] : g["end"]] == b"".join(both.b_pieces[i] for i in g["b"])
    a = [i for g in rows[0]["groups"] for i in g["a"]]
    b = [i for g in rows[0]["groups"] for i in g["b"]]
    ra, rb = ranges([both.a.pieces[i] for i in a]), ranges([both.b_pieces[i] for i in b])
    assert [(x["a"], x["b"]) for x in rows[0]["links"]] == [(i, j) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]


def test_millions_of_blanks_equal_the_library(libraries):
    library = Tokenizer.from_file(default_path())
    for text in (" " * 2_000_000, "\n" * 1_200_000 + "end", "a" + " " * 1_100_000 + "b<|endoftext|>"):
        assert vocabulary(default_path()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    spaced = "<|endoftext|>" + " " * 1_100_000
    assert vocabulary(default_path()).encode_plain(spaced).tolist() == libraries[0].encode(spaced, add_special_tokens=False).ids


def test_links_and_hash_cost_less_than_the_two_encoders():
    both, rng = alignment.aligner(default_path(), alignment.default_pieces()), random.Random(6)
    texts = [prose(rng, 400) for _ in range(150)]

    def seconds(work):
        took = []
        for _ in range(5):
            begin = time.process_time()
            for text in texts:
                work(text)
            took.append(time.process_time() - begin)
        return min(took)

    assert seconds(lambda text: alignment._digest(both, text, 1 << 24)) < 2 * seconds(both.encode)
