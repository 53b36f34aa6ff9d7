"""Places where an operator once did less than its whole job."""

import random

from statloom.llm import decontamination, ngram_quality, pii_crf
from tests.llm.conftest import prose
from tests.llm.test_learned import brute_perplexity


def test_models_take_characters_with_four_before_them(spark):
    rng = random.Random(41)
    trusted = [prose(rng, 30) for _ in range(12)]
    rows = [(0, prose(rng, 20)), (1, "stone lamp garden")]
    model = ngram_quality.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    found = {r["doc_id"]: r["perplexity"] for r in ngram_quality.perplexities(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(abs(found[i] / brute_perplexity(trusted, t, 5) - 1) < 1e-9 for i, t in rows)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(trusted)], "doc_id long, text string, lang string")
    default, five = (ngram_quality.classify(docs, docs.select("doc_id"), **o).orderBy("doc_id").collect() for o in ({}, {"order": 5}))
    assert default == five


def test_only_rows_whose_own_text_holds_an_item_are_contaminated(spark):
    passage = "the copper window of the harbour market opens at seven"
    clean, dirty = "stone lamp garden river", f"before it {passage} and after"
    rows = [(1, clean), (1, dirty), (1, None), (None, clean), (None, dirty), (None, None), (2, dirty), (3, clean), (3, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(5, passage), (6, "no document has this sentence about winter engines")], "item_id long, text string")
    order = lambda found: sorted(found, key=str)
    # the items in one block, and in several
    for size in (1_000_000, 40):
        left = [tuple(r) for r in decontamination.remove_contaminated(docs, bench, block_chars=size).collect()]
        assert order(left) == order([r for r in rows if r[1] != dirty])
        marked = [tuple(r) for r in decontamination.mark_documents(docs, bench, block_chars=size).collect()]
        assert order(marked) == order([(*r, r[1] == dirty, int(r[1] == dirty), "5" if r[1] == dirty else "") for r in rows])


def test_the_field_learns_from_spans_anywhere_in_a_text(spark):
    rng = random.Random(43)
    years = lambda: " ".join(f"{prose(rng, 30)} page {rng.randint(1, 400)} of {rng.randint(1900, 2030)}." for _ in range(3))
    texts = [f"{years()} Host 10.{i % 200}.{i % 90}.7 or joe{i}@mail.example.com here. {prose(rng, 30)}" for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *(years() for _ in range(300)), None, ""]], "text string").repartition(5)
    found = pii_crf.sample(docs, excerpts=64)
    assert found == pii_crf.sample(docs.repartition(2), excerpts=64)
    held = [k for _, spans in found for k in {s[2] for s in spans}]
    assert held.count("ip") >= 20 and held.count("email") >= 20 and sum(not spans for _, spans in found) >= 30
    assert all(spans == [s for s in pii_crf.base_spans(x) if s[0] > 0 and s[1] < len(x)] for x, spans in found)
    field = pii_crf.learn(docs, excerpts=64)
    assert field is not None and {k for _, _, k in pii_crf.find_spans("Mail joe.doe [at] mail.example.com or see host 10[.]2[.]3[.]4 there.", field)[1]} == {"email", "ip"}
