"""Quality rules and preference pairs, the DataFrame-only operators, and near copies against brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from statloom.llm import minhash, preference, quality_rules
from statloom.llm.queries import QUERIES
from tests.llm.conftest import prose
from tests.test_plans import plan

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark, odd):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", " ", "é", "#", "|", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["a b c a b c", "x x x x", "a b a b a b", " lead", "trail ", "l\nl\n \nl", None, "日 本 日 本 日 本"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in quality_rules.judge(docs, []).collect():
        counts = brute_counts(r["text"])
        s = r["_stats"]
        assert tuple(s[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r["kept"] == (not r["base_failed"])


def junk(rng, n):
    return " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in prose(rng, n).split())


def test_rules_are_learned_from_labels(spark):
    rng = random.Random(2)
    rows = [(i, junk(rng, 70) if i % 3 == 0 else prose(rng, 70)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(160)] + [(None, 0), (3, None), (999, 1)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and all(0.97 <= r.precision <= 1 for r in rules)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, rules).collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(240))
    assert quality_rules.learn_rules(docs.repartition(7), labels) == rules


def test_no_rules_without_both_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int")
    assert quality_rules.learn_rules(odd, labels) == []
    assert quality_rules.learn_rules(empty, labels.filter("false")) == []
    assert quality_rules.judge(empty, []).count() == 0


def test_native_operators_run_no_python(spark):
    for name in ("op1_quality_rules", "op7_preference_pairs"):
        text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert not re.search("Python|Pandas|Arrow", text), name


def brute_pairs(turns, other):
    """Prompt, completions and masks of two lists of (role, text)."""
    n = 0
    while n < min(len(turns), len(other)) and tuple(x or "" for x in turns[n]) == tuple(x or "" for x in other[n]):
        n += 1

    def draw(part):
        text, spans = "", []
        for role, said in part:
            text += f"<|{role or 'unknown'}|>\n"
            start = len(text)
            text += (said or "").replace("<|", "< |") + "<|end|>\n"
            if role == "assistant":
                spans.append((start, len(text)))
        return text, spans

    return draw(turns[:n])[0], *draw(turns[n:]), *draw(other[n:])


def test_preference_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for p in range(60):
        common = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "é<|end|>", None, ""])) for _ in range(rng.randint(0, 4))]
        sides = [common + [(rng.choice(["user", "assistant"]), prose(rng, 3)) for _ in range(rng.randint(0, 3))] for _ in range(2)]
        if p % 10 == 0:
            sides[1] = list(sides[0])
        for side, turns in zip(("chosen", "rejected"), sides):
            rows += [(p, side, i + 1, role, text) for i, (role, text) in enumerate(turns)]
        if any(sides):
            want[p] = brute_pairs(*sides)
    pairs = spark.createDataFrame(rows, "pair_id long, side string, pos int, role string, text string").withColumn("prompt", F.lit(1))
    got = {r["pair_id"]: r for r in preference.format_pairs(pairs).collect()}
    assert set(got) == set(want)
    for p, (prompt, chosen, chosen_mask, rejected, rejected_mask) in want.items():
        r = got[p]
        assert (r["prompt"], r["chosen"], r["rejected"]) == (prompt, chosen, rejected)
        assert [tuple(x) for x in r["chosen_mask"]] == chosen_mask and [tuple(x) for x in r["rejected_mask"]] == rejected_mask


def test_turns_of_pairs_and_odd_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (2, 1, "assistant", "c"), (3, None, None, None), (None, 0, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    ids = spark.createDataFrame([(10, 1, 2), (11, 3, 99)], "pair_id long, chosen long, rejected long")
    got = {r["pair_id"]: r for r in preference.format_pairs(preference.pair_turns(turns, ids)).collect()}
    assert got[10]["prompt"] == "<|user|>\na<|end|>\n" and got[10]["rejected"].count("assistant") == 2
    assert got[11]["chosen"] == "<|unknown|>\n<|end|>\n" and got[11]["rejected"] == ""
    swapped = {r["pair_id"]: r for r in preference.format_pairs(preference.swapped_replies(turns)).collect()}
    assert "c" in swapped[1]["rejected"] and "b" in swapped[1]["chosen"] and set(swapped) == {1, 2, 3}
    assert preference.format_pairs(preference.swapped_replies(turns.filter("false"))).count() == 0


def brute_components(rows, percent=75):
    """Smallest key per row, by comparing every two shingle sets."""
    sets = [minhash.shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(find(i), []).append(key)
    return [(key, len(sets[i]), min((k for k in least[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def test_near_copies_match_brute_force(spark, odd):
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for g in range(12):
        base = prose(rng, rng.choice([4, 5, 30, 120, 300]))
        chain = base
        for i in range(8):
            # copies around the threshold, and chains whose ends are far apart
            chain = edited(rng, chain, max(1, len(chain.split()) // 60))
            rows.append((1000 + g * 20 + i, rng.choice([base, chain, chain.upper(), edited(rng, base, len(base.split()) // 40)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows)))
    left = minhash.deduplicate(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [1, 1, 2, 3, 4, 5, None, None, 7, 8, 9]))


def test_a_bucket_that_its_leader_does_not_connect(spark, monkeypatch):
    """Texts that share much with a leader but reach the threshold only among themselves, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    common = prose(rng, 150)
    rows = [(0, common)]
    for g in range(6):
        own = prose(rng, 90)
        rows += [(1 + 5 * g + i, common + " " + edited(rng, own, i)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_near_copies_of_an_empty_table(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.deduplicate(empty).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 901 + i) for i in range(50)]
    adjacent = {}
    for u, v in edges:
        if u != v:
            adjacent.setdefault(u, set()).add(v)
            adjacent.setdefault(v, set()).add(u)
    want = {}
    for start in sorted(adjacent):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += adjacent[x]
    got = minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert minhash.components(spark.createDataFrame([], "u long, v long")).count() == 0
