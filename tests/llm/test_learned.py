"""Learned operators: held-out accuracy, brute-force comparisons, odd inputs."""

import math
import random
import re
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import language, ngram_quality, pii_crf, toxicity
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# --- language ---------------------------------------------------------------------------


def test_language_of_held_out_documents(documents):
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.learn(documents.filter(~out))
    assert model == language.learn(documents.filter(~out).repartition(9))
    found = language.predict(documents.filter(out), model).join(documents, "doc_id").collect()
    right = [r["lang"] == r["lang_pred"] for r in found]
    long = [r["lang"] == r["lang_pred"] for r in found if r["n_chars"] >= 200]
    sure = [r["lang"] == r["lang_pred"] for r in found if r["accepted"]]
    assert sum(right) > 0.95 * len(right) and sum(long) > 0.99 * len(long) and sum(sure) > 0.98 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)


def test_language_of_odd_rows(odd, empty):
    model = {"de": "der hund und die katze ".encode() * 20, "en": b"the dog and the cat " * 20}
    found = language.predict(odd, model).collect()
    assert len(found) == odd.count()
    for r in found:
        if r["doc_id"] in (2, 3, 4):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in ("de", "en", "und")
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.learn(empty)).collect()} == {"und"}
    assert set(language.learn(odd)) == {"en", "fr"}


# --- personal data ----------------------------------------------------------------------


def brute_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii_crf.luhn(digits):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii_crf.KINDS.index(s[2])))


def test_base_spans_match_the_patterns(documents):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aA09@..+- (),1234567%_é\n") for _ in range(90)) for _ in range(4000)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "a.b@c-d.e", "1.2.3.4", "+1 (202) 555-0100", " ", ".", "@", "+", "9", "٣"]) for _ in range(8)) for _ in range(4000)]
    texts += [r["text"] for r in documents.select("text").collect()]
    for text in texts:
        assert pii_crf.base_spans(text) == brute_spans(text)


def brute_best(field, text):
    """The best segmentation by trying all."""
    borders, found = pii_crf.candidates(text, 0, len(text))
    scored = [(i, j, kind, field.score(pii_crf.features(text, borders[i], borders[j], kind))) for i, j, kind in found]

    def best(at):
        options = [(0.0, [])]
        for i, j, kind, s in scored:
            if i >= at:
                rest, spans = best(j)
                options.append((s + rest, [(borders[i], borders[j], kind), *spans]))
        return max(options, key=lambda o: o[0])

    return best(0)


def test_decoding_finds_the_best_segmentation():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["12", "345", "6789", ".", "-", " ", "+", "(", ") ", "x"]) for _ in range(9))
        names = {f for i, j, k in pii_crf.candidates(text, 0, len(text))[1] for f in pii_crf.features(text, pii_crf.candidates(text, 0, len(text))[0][i], pii_crf.candidates(text, 0, len(text))[0][j], k)}
        field = pii_crf.Field({n: rng.uniform(-1, 1) for n in sorted(names)})
        spans = field.decode(text, 0, len(text), certain=0.0)
        borders, arcs = field.lattice(text, 0, len(text))
        value = {(borders[i], borders[j], k): s for j, held in arcs.items() for i, k, s in held}
        assert math.isclose(sum(value[s] for s in spans), brute_best(field, text)[0], abs_tol=1e-9)


def test_field_adds_what_the_patterns_miss(documents):
    field = pii_crf.learn(documents)
    text = "Mail joe.doe [at] mail.example.com or see host 10[.]2[.]3[.]4 there. Card 4111111111111112 is none, nor 2019 2020 2021 2022."
    base, spans = pii_crf.find_spans(text, field)
    assert base == [] and {k for _, _, k in spans} == {"email", "ip"}
    assert pii_crf.masked(text, spans).startswith("Mail [EMAIL] or see host [IP] there.")
    found = pii_crf.find(documents, field).collect()
    assert sum(r["n_added"] for r in found) <= 0.2 * sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in found)


def test_personal_data_of_odd_rows(spark, odd, empty):
    field = pii_crf.learn(odd)
    assert field is None and pii_crf.learn(empty) is None
    assert len(pii_crf.find(odd, field).collect()) == odd.count()
    assert pii_crf.find(empty, field).count() == 0 and pii_crf.redact(empty, None).count() == 0
    masked = pii_crf.redact(odd, pii_crf.Field({}))
    assert masked.columns == odd.columns and masked.filter("text IS NULL").count() == odd.filter("text IS NULL").count()
    for text in ("1" * 50_000, "1 " * 20_000, "a@" * 20_000, "1.2.3.4." * 5_000, "+1" * 20_000):
        assert pii_crf.find_spans(text, pii_crf.Field({}))[0] == brute_spans(text) if text[0] != "a" and len(set(text)) > 2 else True


# --- toxicity ---------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    # the small tables hold six held-out toxic documents in four languages, too few for a rate
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn(documents, labels.filter(~out))
    found = {r["doc_id"]: r for r in toxicity.score(documents, model).collect()}
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found.values())
    truth = [(r["toxic"], found[r["doc_id"]]) for r in labels.filter(out).collect() if r["doc_id"] in found]
    assert sum(r["predicted"] for y, r in truth if not y) <= 0.005 * len(truth)
    assert sum(r["predicted"] for y, r in truth if y) >= 0.9 * sum(y for y, _ in truth)


def test_passages_hold_every_word_and_every_short_run():
    rng = random.Random(8)
    idf = {f"w{c}": 1.0 for c in "abcdef"}
    for n in (0, 1, 9, 10, 11, 15, 16, 97):
        words = [rng.choice([*idf, "x", "y"]) for _ in range(n)]
        found = toxicity.passages(" ".join(words), idf, {}, 10)
        starts = sorted({*range(0, max(n - 10, 0), 5), max(n - 10, 0)})
        brute = [{toxicity.ALL: min(n, 10)} | {t: words[s : s + 10].count(t) for t in idf if t in words[s : s + 10]} for s in starts]
        assert found == brute
        for run in range(n - 4):
            assert any(s <= run and run + 5 <= s + 10 for s in starts)


def test_toxic_passage_in_a_long_clean_text(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn(documents, labels.filter(~out))
    judged = documents.join(labels.select("doc_id", "toxic"), "doc_id").filter("lang = 'en' AND length(text) > 200")
    clean = [r["text"] for r in judged.filter("toxic = 0").orderBy("doc_id").limit(400).collect()]
    scores = toxicity.score(judged.filter("toxic = 1"), model).filter("score > 0.9").orderBy("doc_id").limit(5)
    toxic = [r["text"] for r in scores.join(documents.select("doc_id", "text"), "doc_id").collect()]
    words, texts = " ".join(clean).split()[:5000], []
    assert len(words) == 5000 and toxic
    for i, t in enumerate(toxic):
        at = (0, 5000, 2500, 1290, 4930)[i % 5]
        texts.append((i, " ".join([*words[:at], *t.split()[:120], *words[at:]])))
    texts.append((99, " ".join(words)))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert found.pop(99) < 0.5 and all(s >= 0.5 for s in found.values()), found


def test_neighbours_are_exact():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(30)]
    idf = {n: rng.uniform(1, 4) for n in names}
    examples = [({toxicity.ALL: rng.randint(1, 90)} | {n: rng.randint(1, 5) for n in rng.sample(names, rng.randint(0, 6))}, rng.randint(0, 1)) for _ in range(400)]
    model = toxicity._index(examples, idf, 0.5, 16)
    vectors = [(toxicity.unit(c, idf), y) for c, y in examples]
    skipped = 0
    for _ in range(200):
        query = toxicity.unit({toxicity.ALL: rng.randint(1, 90)} | {n: rng.randint(1, 5) for n in rng.sample(names, rng.randint(0, 6))}, idf)
        found, opened = toxicity.neighbours(model, query, 10)
        skipped += model.bounds.shape[1] - opened
        similar = sorted((sum(w * v.get(t, 0) for t, w in query.items()) for v, _ in vectors), reverse=True)
        wanted = sum(s >= similar[9] - 1e-9 for s in similar)
        assert sum(int(model.votes[v, 0]) for _, v in found) == wanted
        assert np.isclose(min(s for s, _ in found), similar[9])
    assert skipped > 0


def test_toxicity_of_odd_rows(spark, odd, empty):
    some = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (99, 0), (6, 0), (6, 0)], "doc_id long, toxic int")
    for labelled in (some, some.filter("false")):
        found = toxicity.score(odd, toxicity.learn(odd, labelled)).collect()
        assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(empty, toxicity.learn(empty, some)).count() == 0


# --- perplexity -------------------------------------------------------------------------


def brute_perplexity(trusted, text, order):
    """Interpolated modified Kneser-Ney, counted and evaluated by the definition."""
    pad = ngram_quality.PAD * (order - 1)
    counts = {order: {}}
    for t in trusted:
        for i in range(len(t)):
            g = (pad + t)[i : i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discounts = {n: ngram_quality._discounts(*(sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4))) for n in counts}
    followers = {n: {} for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            followers[n].setdefault(g[:-1], []).append(c)

    def p(g):
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        held = followers[n].get(g[:-1])
        if not held:
            return below
        d = lambda c: 0 if not c else discounts[n][min(c, 3) - 1]
        c = counts[n].get(g, 0)
        return (c - d(c)) / sum(held) + sum(map(d, held)) / sum(held) * below

    return math.exp(-sum(math.log(p((pad + text)[i : i + order])) for i in range(len(text))) / len(text))


def test_perplexity_matches_the_definition(spark, monkeypatch):
    rng = random.Random(4)
    trusted = [prose(rng, 25) for _ in range(12)]
    texts = [prose(rng, 20) for _ in range(6)] + [trusted[0], "ZZZ ### !!", "a", "日本語 é", None, "", prose(rng, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # long texts are worked on in parts
    monkeypatch.setattr(ngram_quality, "PIECE", 300)
    model = ngram_quality.train(spark.createDataFrame([(t,) for t in [*trusted, None, ""]], "text string"), order=4)
    got = {r["doc_id"]: r for r in ngram_quality.perplexities(docs, model, block_chars=400).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        if text:
            assert math.isclose(got[i]["perplexity"], brute_perplexity(trusted, text, 4), rel_tol=1e-9) and got[i]["n_chars"] == len(text)
        else:
            assert got[i]["perplexity"] is None


def test_classifier_tells_labelled_quality_apart(documents, labels):
    found = {r["doc_id"]: r["kept"] for r in ngram_quality.classify(documents, labels.filter("quality = 1 AND doc_id % 3 <> 0")).collect()}
    truth = [(r["quality"], found[r["doc_id"]]) for r in labels.filter("doc_id % 3 = 0").collect() if r["doc_id"] in found]
    good = [k for y, k in truth if y]
    bad = [k for y, k in truth if not y]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_one_exchange_serves_requests_and_scores(spark, documents):
    model = ngram_quality.train(documents.filter("doc_id < 40"), order=3)
    scored = ngram_quality.perplexities(documents, model)
    scored.collect()
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()


def test_perplexity_with_more_characters_than_numbers_hold(spark):
    rng = random.Random(44)
    trusted = ["".join(map(chr, range(0x4E00, 0x4E00 + 7000))), *(prose(rng, 20) for _ in range(5)), "".join(chr(0x4E00 + rng.randrange(60)) for _ in range(900))]
    texts = [trusted[-1][100:300], prose(rng, 30), "".join(map(chr, range(0x4E10, 0x4E10 + 6800))), "日本語 \U0001f600 é"]
    model = ngram_quality.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    got = ngram_quality.perplexities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts) and all(math.isclose(r["perplexity"], brute_perplexity(trusted, texts[r["doc_id"]], 5), rel_tol=1e-9) for r in got)


def test_replies_are_the_same_without_numbers(monkeypatch):
    rng = random.Random(46)
    texts = ["".join(rng.choice("abcde ") for _ in range(400)) for _ in range(4)]
    (known, counts), (asked, _), (shorter, _) = ngram_quality.tally(texts[:2], 5), ngram_quality.tally(texts, 5), ngram_quality.tally(texts, 3)
    rules = ngram_quality._Rules(SimpleNamespace(order=5, base=3, discounts=dict.fromkeys(range(1, 6), (0.5, 0.9, 1.2)), alphabet=7))
    sides = known, counts, shorter, np.linspace(0.1, 0.9, len(shorter))
    expected = rules.replies([asked[:50], asked[50:]], *sides)
    monkeypatch.setattr(ngram_quality.Letters, "numbers", lambda self, order: False)
    assert (rules.replies([asked], *sides) == expected).all()
    assert all((x == y).all() for x, y in zip(ngram_quality.tally(texts[:2], 5), (known, counts)))


def test_scoring_writes_hardly_more_than_the_texts(spark):
    rng = random.Random(45)
    texts = [(i, prose(rng, rng.randint(20, 500))) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).cache()
    model = ngram_quality.train(docs.filter("doc_id % 50 = 0"))
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def written():
        return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*"))

    before = written()
    assert len(ngram_quality.perplexities(docs, model).collect()) == len(texts)
    assert written() - before < 1.1 * sum(len(t) for _, t in texts)


def test_classifier_on_odd_rows(spark, odd, empty):
    keys = spark.createDataFrame([(1,), (5,), (6,), (7,), (None,), (77,)], "doc_id long")
    found = ngram_quality.classify(odd, keys).collect()
    assert len(found) == odd.count()
    assert all(not r["kept"] for r in found if r["doc_id"] in (2, 3))
    assert all(r["kept"] == (r["perplexity"] is not None) for r in ngram_quality.classify(odd, keys.filter("false")).collect())
    assert ngram_quality.classify(empty, keys).count() == 0
