"""Spelling variants against all pairs of words and a plain edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest

from statloom.llm import spelling
from tests.llm.conftest import prose

LOWER = str.maketrans({c: c.lower() for c in spelling.CAPITALS})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    cut = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[cut + (len(a) == len(b)) :] == b[cut + 1 :]


def brute(rows, shortest=5, least=3, misspell=97):
    uses = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            uses[run] += 1
    return {w: n for w, n in uses.items() if len(w) >= shortest and n >= least}


def grouped(listed):
    forms, near_of = {}, {}
    for w, n in listed.items():
        near = [v for v in listed if one_edit(w, v)]
        near_of[w] = len(near)
        best = min(near, key=lambda v: (-listed[v], v), default=None)
        forms[w] = best if best is not None and listed[best] >= 2 * n else None
    for w, n in listed.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        yield (w, forms[w], root, n, near_of[w], listed[forms[w]] if forms[w] else None)


def same(got, want):
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_words_and_groups_of_texts(spark, odd):
    rng = random.Random(1)
    vocabulary = ["harbour", "harbor", "Garden", "gardén", "garde", "gardens", "ÄRGER", "ärger", "letter", "etter", "aaaaa", "aaaaaa", "aaaaaaa", "×÷÷÷÷×"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "1", " ", "-x"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs = odd.select("doc_id", "text", "lang", odd["k"].alias("n"), odd["k"].alias("word")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for misspell in (97, 3, None):
        listed = brute(pairs, misspell=misspell)
        found = spelling.words(docs, misspell=misspell)
        same(found, listed.items())
    same(spelling.group_variants(spelling.words(docs, misspell=3)), grouped(brute(pairs, misspell=3)))


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("aé", 7), ("abcdß", 6)])
def test_near_pairs_of_dense_words(spark, letters, longest):
    rng = random.Random(2)
    listed = {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))): rng.randint(3, 1000) for _ in range(300)}
    words = spark.createDataFrame(list(listed.items()), "word string, n long")
    want = [(a, listed[a], b, listed[b]) for a in listed for b in listed if one_edit(a, b)]
    same(spelling.near_pairs(words), want)
    same(spelling.group_variants(words), grouped(listed))


def test_long_chains_end_at_the_root(spark):
    chain = [("a" * i + "b" * (30 - i), 3 << i) for i in range(31)]
    rows = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert all(rows[w]["root"] == "a" * 30 for w, _ in chain) and rows["a" * 30]["form"] is None


def test_long_texts_and_empty_tables(spark, empty):
    text = prose(random.Random(3), 40_000)
    docs = spark.createDataFrame([("x", text), ("y", "w" * 60_000)], "doc_id string, text string")
    same(spelling.words(docs, misspell=97), brute([("x", text), ("y", "w" * 60_000)]).items())
    assert spelling.group_variants(spelling.words(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spelling.words(empty), ratio=1)


def test_no_table_of_words_is_broadcast(spark):
    listed = spark.createDataFrame([("harbour", 9), ("harbor", 3), ("garden", 5)], "word string, n long")
    for found in (spelling.near_pairs(listed), spelling.group_variants(listed)):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
