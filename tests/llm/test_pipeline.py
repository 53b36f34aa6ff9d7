"""Benchmark passages against brute force, and the pipeline stage by stage."""

import random

import numpy as np

import corpus_pipeline
from statloom.llm import decontamination, minhash, pii_crf
from tests.llm.conftest import prose
from tests.llm.test_learned import brute_spans
from tests.llm.test_text_rules import brute_components, brute_counts

TINY = "/root/testdata/sf0.001"


def distance_in(pattern, text):
    """The smallest edit distance of a pattern to any part of a text."""
    chars = np.array([ord(c) for c in text])
    row = np.zeros(len(chars) + 1, dtype=int)
    for i, c in enumerate(pattern, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (chars != ord(c)))
        new = np.concatenate([[i], new])
        # insertions run along the row
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_bit_parallel_distance_matches_the_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 120)))
        assert decontamination.Pattern(pattern).best(text, len(pattern))[0] == distance_in(pattern, text)


def damaged(rng, text, n):
    out = list(text)
    for _ in range(n):
        i, what = rng.randrange(1, len(out) - 1), rng.randrange(3)
        out[i : i + 1] = [] if what == 0 else ["q"] if what == 1 else [out[i], "z"]
    return "".join(out)


def test_passages_match_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([6, 15, 40]))) for i in range(12)] + [(12, None), (13, " "), (14, "abc def")]
    docs, rate = [], 0.1
    for i in range(120):
        text = prose(rng, rng.randint(0, 60))
        if i % 2:
            item = items[rng.randrange(12)][1]
            text += " " + damaged(rng, item, rng.randint(0, len(item) // 7)).upper().replace(" ", rng.choice([" ", "\n", "  "])) + " " + prose(rng, 10)
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(df, bench, error_rate=rate).collect()
    want = set()
    for i, text in docs:
        plain = decontamination.plain(text)
        for k, item in items:
            pattern = decontamination.plain(item or "")
            if pattern and plain and distance_in(pattern, plain) <= decontamination.budget(len(pattern), rate):
                want.add((i, k))
    assert {(r["doc_id"], r["item"]) for r in found} == want and len(want) > 30
    texts, patterns = dict(docs), {k: decontamination.plain(t or "") for k, t in items}
    for r in found:
        part = decontamination.plain(texts[r["doc_id"]][r["start"] : r["end"]])
        assert distance_in(patterns[r["item"]], part) == r["distance"]
    # the size of the blocks changes nothing
    again = decontamination.find_passages(df, bench, error_rate=rate, block_chars=200).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_passages_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "short text"), (2, None), (3, ""), (1, "short text")], "item_id long, text string")
    marked = decontamination.mark_documents(odd, bench)
    rows = marked.collect()
    assert len(rows) == odd.count() and [r["doc_id"] for r in rows if r["contaminated"]] == [7]
    assert [r["items"] for r in rows if r["contaminated"]] == ["1"]
    left = decontamination.remove_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert decontamination.mark_documents(empty, bench).count() == 0
    assert decontamination.mark_documents(odd, bench.filter("false")).filter("contaminated").count() == 0


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, TINY).collect(), stage(spark, docs, TINY).schema) if before else docs
        kept[name] = (before, docs.collect())
        if name != "bpe":
            assert docs.columns == columns

    before, after = kept["quality_rules"]
    left = {r["doc_id"] for r in after}
    for r in before:
        n = brute_counts(r["text"])
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert r["doc_id"] not in left
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    passed = {r["doc_id"] for r in before if brute_counts(r["text"])[0] >= 50 and 100 * brute_counts(r["text"])[4] <= 50 * brute_counts(r["text"])[0]}
    assert all(i in left for i in passed if labels.get(i) == 1)

    before, after = kept["near_duplicates"]
    heads = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(r["doc_id"] for r in after) == sorted(heads)

    before, after = kept["decontamination"]
    bench = [decontamination.plain(r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before if not any(distance_in(p, decontamination.plain(r["text"])) <= len(p) // 10 for p in bench)}
    assert {r["doc_id"] for r in after} == clean

    before, after = kept["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert set(texts) == {r["doc_id"] for r in after}
    for r in after:
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_spans(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]] or "[" in r["text"]

    before, after = kept["bpe"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert minhash.WORDS == 5 and pii_crf.KINDS == ("email", "ip", "card", "phone")
