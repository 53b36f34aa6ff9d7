"""Toxicity from the nearest labelled examples under exact TF-IDF cosine.

Examples, and the terms that tell the two labels apart, are learned from labelled rows.
Their vectors stand in an inverted index whose postings are cut into blocks of similar
examples, each with the largest weight per term; a query opens blocks in order of their
bounds and stops when no block left can hold a neighbour.
"""

from __future__ import annotations

import dataclasses
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows
from statloom.llm.samples import labelled_sample

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
# The term that every text has: all its words. It lets the cosine see how much of a text the
# other terms are; texts under SHORTEST words count as that long.
ALL = ""
BACKGROUND = 2.0
SHORTEST = 20


def terms(text: str | None) -> Counter:
    """Words of a text, their beginnings (marked with ``*``) and all words (``ALL``) with their counts."""
    out: Counter = Counter({ALL: 0})
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        out[ALL] += n
        out[word] += n
        for size in PREFIXES:
            if len(word) >= size:
                out[word[:size] + "*"] += n
    return out


def _known(word: str, idf: dict[str, float], seen: dict[str, tuple]) -> tuple:
    """The terms of a word that the model knows; ``seen`` keeps the answers."""
    found = seen.get(word)
    if found is None:
        if len(seen) >= 200_000:
            seen.clear()
        found = seen[word] = tuple(t for t in (word, *(word[:size] + "*" for size in PREFIXES if len(word) >= size)) if t in idf)
    return found


def passages(text: str | None, idf: dict[str, float], seen: dict[str, tuple], size: int) -> list[dict[str, int]]:
    """The known terms and the number of words (``ALL``) of every passage of a text.

    Passages have ``size`` words and start half a passage after the one before, the last one
    ends with the text; so every run of up to half a passage stands whole in one of them. A
    text that is no longer is one passage.
    """
    words = _WORD.findall((text or "").lower())
    known = {w: found for w in set(words) if (found := _known(w, idf, seen))}
    at = [i for i, w in enumerate(words) if w in known]
    last = max(len(words) - size, 0)
    out = []
    for start in [*range(0, last, max(size // 2, 1)), last]:
        counts = {ALL: min(size, len(words))}
        for i in at[bisect_left(at, start) : bisect_left(at, start + size)]:
            for term in known[words[i]]:
                counts[term] = counts.get(term, 0) + 1
        out.append(counts)
    return out


@dataclasses.dataclass
class Model:
    """Examples as unit vectors in blocks, equal vectors held once with their votes."""

    idf: dict[str, float]
    number: dict[str, int]
    bounds: np.ndarray  # term × block: the largest weight
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per term: vector numbers ascending, weights, blocks
    votes: np.ndarray  # vector × (examples, toxic examples)
    prior: float
    block: int


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_label: int = 4096, max_terms: int = 4096, min_chi2: float = 30.0, min_odds: float = 4.0, block: int = 32) -> Model:
    """Fit on a sample of at most ``per_label`` examples of each label.

    Kept are the ``max_terms`` terms whose presence depends most on the label by the
    chi-square statistic, at least ``min_chi2``, and changes the odds at least by the factor
    ``min_odds`` (in large samples the faintest dependence is certain); so the model has at most ``2 × per_label``
    vectors over ``max_terms`` terms. Labels other than 0 and 1, NULL keys, and keys with
    contradicting labels are left out. With examples of one label only, the model knows
    their share and no vector.
    """
    chosen = F.broadcast(labelled_sample(labels, label, key, per_label))
    # a key that stands on several rows gives one example: its smallest text
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(chosen, "k").groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(columns):
        for k, y, t in zip(columns["k"], columns["y"], columns["t"]):
            for term, n in terms(t).items():
                yield k, y, term, n

    counted = map_rows(rows, run, f"k {dict(rows.dtypes)['k']}, y int, term string, n int").persist()
    try:
        sizes = {r["y"]: r["n"] for r in counted.filter(F.col("term") == ALL).groupBy("y").agg(F.count("*").alias("n")).collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        prior = n1 / (n0 + n1) if n0 + n1 else 0.0
        if not n0 or not n1:
            return _index([], {}, prior, block)
        in1, in0 = F.col("a").cast("double"), F.col("b").cast("double")
        chi2 = (n0 + n1) * F.pow(in1 * n0 - in0 * n1, 2) / ((in1 + in0) * (n0 + n1 - in1 - in0) * float(n0) * float(n1))
        df = counted.filter(F.col("term") != ALL).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(f"a + b < {n0 + n1}")
        odds = F.abs(F.log((in1 + 0.5) * (n0 - in0 + 0.5) / ((n1 - in1 + 0.5) * (in0 + 0.5))))
        best = df.withColumn("chi2", chi2).filter((F.col("chi2") >= min_chi2) & (odds >= math.log(min_odds))).orderBy(F.col("chi2").desc(), "term").limit(max_terms)
        idf = {r["term"]: math.log((1 + n0 + n1) / (1 + r["a"] + r["b"])) + 1 for r in best.collect()}
        picked = counted.join(F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in [ALL, *sorted(idf)]], "term string")), "term")
        vectors: dict = {}
        for r in picked.select("k", "y", "term", "n").collect():
            vectors.setdefault((str(r["k"]), r["y"]), {})[r["term"]] = r["n"]
        return _index([(vectors[e], e[1]) for e in sorted(vectors)], idf, prior, block)
    finally:
        counted.unpersist()


def unit(counts: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
    """Uses per hundred words × idf of the known terms, beside the background, at length one."""
    words = max(counts[ALL], SHORTEST)
    raw = {ALL: BACKGROUND} | {t: 100 * n / words * idf[t] for t, n in sorted(counts.items()) if t in idf}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


def _index(examples: list[tuple[dict[str, int], int]], idf: dict[str, float], prior: float, block: int) -> Model:
    merged: dict[tuple, list] = {}
    for counts, y in examples:
        vector = unit(counts, idf)
        held = merged.setdefault(tuple(vector.items()), [0, 0])
        held[0] += 1
        held[1] += y
    # vectors that share their heaviest terms come to stand in one block, which makes its bounds tight
    order = sorted(merged, key=lambda v: [(t, -w) for t, w in sorted(v, key=lambda x: (-x[1], x[0]))])
    number = {t: i for i, t in enumerate([ALL, *sorted(idf)])}
    blocks = -(-len(order) // block)
    bounds = np.zeros((len(number), blocks))
    lists: list[tuple[list, list]] = [([], []) for _ in number]
    for v, vector in enumerate(order):
        for t, w in vector:
            i = number[t]
            lists[i][0].append(v)
            lists[i][1].append(w)
            bounds[i, v // block] = max(bounds[i, v // block], w)
    postings = [(np.array(a, dtype=np.int64), np.array(b, dtype=float), np.array(a, dtype=np.int64) // block) for a, b in lists]
    return Model(idf, number, bounds, postings, np.array([merged[v] for v in order]).reshape(len(order), 2), prior, block)


def neighbours(model: Model, vector: dict[str, float], k: int) -> tuple[list[tuple[float, int]], int]:
    """(similarity, vector number) of all examples at least as near as the k-th, and the blocks opened."""
    if not vector or not len(model.votes):
        return [], 0
    at = [(model.number[t], w) for t, w in vector.items()]
    bound = sum(w * model.bounds[i] for i, w in at)
    found: list[tuple[float, int]] = []
    floor, opened, wave = 0.0, 0, 1
    order = np.argsort(-bound, kind="stable")
    while opened < len(order):
        # blocks are opened in waves, each twice as large as the one before
        batch = order[opened : opened + wave]
        batch = batch[(bound[batch] > 0) & (bound[batch] >= floor - 1e-9)]
        if not len(batch):
            break
        opened, wave = opened + len(batch), wave * 2
        chosen = np.zeros(len(bound), dtype=bool)
        chosen[batch] = True
        sums = np.zeros(len(model.votes))
        for i, w in at:
            numbers, weights, of_block = model.postings[i]
            inside = chosen[of_block]
            sums[numbers[inside]] += w * weights[inside]
        found += [(float(sums[v]), int(v)) for v in np.flatnonzero(sums >= max(floor - 1e-9, 1e-12))]
        found.sort(reverse=True)
        seen = 0
        for similarity, v in found:
            seen += int(model.votes[v, 0])
            if seen >= k:
                floor = similarity
                found = [f for f in found if f[0] >= floor - 1e-9]
                break
    return found, opened


def vote(model: Model, found: list[tuple[float, int]], prior_weight: float) -> float:
    """Share of toxic votes, each weighted by similarity over distance, pulled to the prior."""
    total, toxic = prior_weight, prior_weight * model.prior
    for similarity, v in found:
        weight = similarity / (1.05 - min(similarity, 1.0))
        total += weight * int(model.votes[v, 0])
        toxic += weight * int(model.votes[v, 1])
    return toxic / total if total else model.prior


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", k: int = 25, prior_weight: float = 0.25, passage: int = 256) -> DataFrame:
    """(key, score, predicted, evidence, similarity) for every row, from its whole text.

    A text is scored by its passages of ``passage`` words, each half a passage after the one
    before, and has the score of the most toxic one (the first in order of terms, if several
    are), so that the clean rest of a long text takes nothing away. The neighbours are all
    examples at least as similar as the ``k``-th; ties at that place all vote. ``evidence`` has
    the known terms of that passage, the heaviest first (at most eight), ``similarity`` that of
    its nearest example. A NULL or empty text, and one without
    a known term, is nearest to the examples without such terms; without any example the
    score is the toxic share, 0. Repeated keys give one row each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        m = held.value
        answers: dict = {}
        seen_words: dict[str, tuple] = {}
        for doc, value in zip(columns["k"], columns["t"]):
            best = None
            for vector in sorted({tuple(unit(counts, m.idf).items()) for counts in passages(value, m.idf, seen_words, passage)}):
                if vector not in answers:
                    found, _ = neighbours(m, dict(vector), k)
                    answers[vector] = (vote(m, found, prior_weight), max((f[0] for f in found), default=0.0))
                if best is None or answers[vector][0] > best[0]:
                    best = (*answers[vector], vector)
            share, nearest, vector = best
            why = ",".join([t for t, _ in sorted(vector, key=lambda x: (-x[1], x[0])) if t != ALL][:8])
            yield doc, share, int(share >= 0.5), why, nearest

    kind = dict(docs.dtypes)[key]
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"`{key}` {kind}, score double, predicted int, evidence string, similarity double")
