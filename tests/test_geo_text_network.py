"""Geography, text and networks against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.words import words
from statloom.operators import geo, network, text, topics
from tests.helpers import close, rows


def polygons(spark, shapes):
    schema = "polygon_id int, polygon_label string, rings array<array<struct<x:double,y:double>>>"
    return spark.createDataFrame([(i, n, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, n, rings in shapes], schema)


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


@pytest.mark.parametrize("limit", [geo.BROADCAST_VERTICES, 0])
def test_points_in_polygons(spark, limit):
    shapes = polygons(spark, [(0, "holed", [SQUARE, HOLE]), (1, "later", [[(x + 1, y + 1) for x, y in SQUARE]]), (2, "open", [[(10, 10), (11, 10), (10, 11)]])])
    data = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 0.0, 2.0), (4, 4.5, 4.5), (5, 3.0, 3.0), (6, 50.0, 50.0), (7, None, 1.0), (8, 10.2, 10.2), (9, 0.5, 0.5)]
    df = spark.createDataFrame(data, "id int, lon double, lat double")
    got = dict(rows(geo.assign_polygons(df, "lat", "lon", shapes, limit), "id", "polygon_id"))
    # 2 is in the hole of the first and inside the second; 3 is on an edge; 5 is in both
    assert got == {1: 0, 2: 1, 3: -1, 4: 1, 5: 0, 6: -1, 7: -1, 8: 2, 9: 0}


def test_random_polygons_against_brute_force(spark):
    rnd = random.Random(4)
    shapes = []
    for i in range(12):
        cx, cy, r = rnd.uniform(-20, 20), rnd.uniform(-20, 20), 2 ** rnd.uniform(-1, 4)
        ring = [(cx + r * math.cos(a) * rnd.uniform(0.5, 1), cy + r * math.sin(a) * rnd.uniform(0.5, 1)) for a in [2 * math.pi * k / 9 for k in range(9)]]
        shapes.append((i, f"p{i}", [ring]))
    points = [(i, rnd.uniform(-25, 25), rnd.uniform(-25, 25)) for i in range(300)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {i: next((p for p, _, rings in shapes if inside(x, y, rings[0])), -1) for i, x, y in points}
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    for limit in (geo.BROADCAST_VERTICES, 0):
        assert dict(rows(geo.assign_polygons(df, "lat", "lon", polygons(spark, shapes), limit), "id", "polygon_id")) == want


def test_spatial_summary(spark):
    df = spark.createDataFrame([(1.0, 1.0, v) for v in (1.0, 2.0, 10.0)] + [(9.0, 9.0, 5.0)], "lat double, lon double, m double")
    result = geo.spatial_aggregate(df, "lat", "lon", polygons(spark, [(0, "z", [SQUARE])]), ["m"], ["count", "median", "sum", "max"])
    row = result.tables["polygon_summary"].first()
    assert (row["n"], row["m_median"], row["m_sum"], row["m_max"]) == (3, 2.0, 13.0, 10.0)
    with pytest.raises(ValueError):
        geo.spatial_aggregate(df, "lat", "lon", polygons(spark, [(0, "z", [SQUARE])]), ["m"], ["mode"])


@pytest.mark.parametrize("limit", [geo.BROADCAST_ORIGINS, 0])
def test_nearest_origin(spark, limit):
    rnd = random.Random(8)
    origins = [(rnd.uniform(-80, 80), rnd.uniform(-180, 180), f"o{i:02d}") for i in range(30)] + [(40.0, -75.0, "tie-a"), (40.0, -75.0, "tie-b")]
    points = [(i, rnd.uniform(-85, 85), rnd.uniform(-180, 180)) for i in range(120)] + [(500, 40.0, -75.0), (501, None, 3.0), (502, 89.9, 179.9)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    df = spark.createDataFrame(points, "id int, lat double, lon double")
    table = spark.createDataFrame(origins, "lat double, lon double, label string")
    got = {r["id"]: r for r in geo.isochrone(df, "lat", "lon", table, 500.0, broadcast_origins=limit).rows.collect()}
    for i, lat, lon in points:
        if lat is None:
            assert got[i]["nearest_origin"] is None and not got[i]["within_catchment"]
            continue
        d, name = min((km(lat, lon, a, b), n) for a, b, n in origins)
        assert got[i]["nearest_origin"] == name and abs(got[i]["distance_km"] - d) < 2e-3
        assert got[i]["within_catchment"] == (d <= 500.0)


def test_geo_enrich_zip(spark):
    tracts = spark.createDataFrame([("T1", "06", "037", 5.0, -9.0)], "census_tract string, geo_state_fips string, geo_county_fips string, income double, age double")
    zips = spark.createDataFrame([("00501", "T1")], "zip string, census_tract string")
    df = spark.createDataFrame([(1, " 501 "), (2, "0"), (3, ""), (4, None), (5, "005011234")], "id int, z string")
    got = {r["id"]: r for r in geo.geo_enrich(df, tracts, ["income", "age", "other"], "z", zips).rows.collect()}
    assert got[1]["income"] == 5.0 and got[1]["age"] is None and got[1]["other"] is None
    assert [got[i]["census_tract"] for i in range(1, 6)] == ["T1", None, None, None, "T1"]


# --- text -------------------------------------------------------------------------------

LEXICON = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("terrible", -2.1)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, valence double")


def test_sentiment_rules(spark, lexicon):
    texts = ["This is good", "This is not good", "This is very good", "terrible and bad", "just a chair", None, "bad but great", "good!!!", "good good", "This is good"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    result = text.sentiment(df, "text", lexicon, output_scores=True)
    got = {r["id"]: r for r in result.rows.collect()}
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert got[0]["sentiment_score"] == norm(1.9) == got[9]["sentiment_score"]
    assert got[1]["sentiment_score"] == norm(1.9 * -0.74) and got[1]["sentiment"] == "negative"
    assert got[2]["sentiment_score"] == norm(1.9 + 0.293)
    assert got[3]["sentiment"] == "negative" and got[4]["sentiment"] == got[5]["sentiment"] == "neutral"
    assert got[6]["sentiment_score"] == norm(-2.5 * 0.5 + 3.1 * 1.5)
    assert got[7]["sentiment_score"] == norm(1.9 + 3 * 0.292)
    assert result.metrics.first()["n_total"] == len(texts)
    assert close(got[0]["pos_score"] + got[0]["neg_score"] + got[0]["neu_score"], 1.0, 1e-3)


def test_words_in_any_script(spark):
    df = spark.createDataFrame([("Café l'Été 42 ДОМ x",), (None,)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["café", "été", "42", "дом"], []]


def brute_groups(docs, threshold, max_features):
    import re

    n = len(docs)
    lists = {i: re.findall(r"\b\w\w+\b", (t or "").lower()) for i, t in docs}
    terms = {i: Counter(w + [" ".join(p) for p in zip(w, w[1:])]) for i, w in lists.items()}
    total, freq = Counter(), Counter()
    for c in terms.values():
        total.update(c)
        freq.update(c.keys())
    vocab = set(sorted(total, key=lambda t: (-total[t], t))[:max_features])
    vectors = {}
    for i, c in terms.items():
        v = {t: k * (math.log((1 + n) / (1 + freq[t])) + 1) for t, k in c.items() if t in vocab}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / size for t, x in v.items()} if size else {}
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _ in docs:
        for j, _ in docs:
            if i < j and vectors[i] and sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) >= threshold - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in docs}


def near_copies(seed, n):
    """Texts of which a third are small edits of one text, with chains and exact copies."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [rnd.choice(vocab) for _ in range(40)]
    docs = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.35:
            t = list(base)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(40)] = rnd.choice(vocab)
        elif kind < 0.5 and docs:
            t = docs[rnd.randrange(len(docs))][1].split()
            if rnd.random() < 0.5 and t:
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
        else:
            t = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 40))]
        docs.append((i, " ".join(t)))
    return docs


@pytest.mark.parametrize("bucket,threshold,features", [(16, 0.85, 10_000), (3, 0.85, 10_000), (3, 0.6, 150), (2, 0.9, 10_000)])
def test_similarity_groups_match_all_pairs(spark, bucket, threshold, features):
    docs = near_copies(bucket, 90)
    df = spark.createDataFrame(docs, "id long, body string")
    result = text.text_similarity(df, "body", "id", threshold, max_features=features, pair_bucket=bucket)
    got = {r["id"]: int(r["canonical_id"]) for r in result.rows.collect()}
    assert got == brute_groups(docs, threshold, features)
    numbers = {r["canonical_id"]: r["similarity_group_id"] for r in result.rows.collect()}
    assert sorted(numbers.values()) == list(range(len(numbers)))


def test_empty_texts_match_nothing(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "same words here"), (4, "same words here")], "id long, t string")
    got = dict(rows(text.text_similarity(df, "t", "id").rows, "id", "canonical_id"))
    assert got == {1: "1", 2: "2", 3: "3", 4: "3"}


@pytest.mark.parametrize("method", ["lda", "nmf"])
def test_topics_separate_two_vocabularies(spark, method):
    rnd = random.Random(2)
    left, right = [f"apple{c}" for c in "abcdefgh"], [f"motor{c}" for c in "abcdefgh"]
    docs = [(i, " ".join(rnd.choice(left if i % 2 else right) for _ in range(30))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(docs, "id int, t string")
    result = topics.text_topics(df, "t", 2, method, max_iter=15)
    found = defaultdict(set)
    for r in result.rows.filter("id < 60").collect():
        found[r["id"] % 2].add(r["dominant_topic"])
    assert len(found[0]) == len(found[1]) == 1 and found[0] != found[1]
    assert result.rows.count() == 61
    assert result.tables["topic_terms"].filter("position = 1").count() == 2
    with pytest.raises(ValueError):
        topics.text_topics(df, "t", 1)
    with pytest.raises(ValueError):
        topics.text_topics(df, "t", 2, min_doc_frequency=0.001)


@pytest.mark.parametrize("method", ["lda", "nmf"])
def test_topics_do_not_hang_on_the_partitions(spark, method):
    rnd = random.Random(5)
    names = [f"word{c}" for c in "abcdefghijklmnop"]
    docs = [(i, " ".join(rnd.choice(names[: 4 + i % 12]) for _ in range(20))) for i in range(80)] * 2
    df = spark.createDataFrame(docs, "id int, t string")
    first, second = (
        topics.text_topics(df.repartition(n), "t", 3, method, max_iter=4).tables["topic_terms"].orderBy("topic_id", "position").collect() for n in (1, 5)
    )
    assert [r["term"] for r in first] == [r["term"] for r in second]
    assert np.allclose([r["weight"] for r in first], [r["weight"] for r in second], rtol=1e-6)


def test_equal_documents_are_one_vector(spark):
    df = spark.createDataFrame([(["a", "b", "a", "z"],), (["b", "a", "a"],), (["b"],), (["z"],), ([],), (None,)], "_terms array<string>")
    got = {(tuple(np.frombuffer(r["ids"], "<i4")), tuple(np.frombuffer(r["tf"], "<i4"))): r["copies"] for r in topics._vectors(df, ["a", "b"], 6).collect()}
    assert got == {((0, 1), (2, 1)): 2, ((1,), (1,)): 1}


def test_a_row_packs_many_term_lists(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "a", "z"],), (["b", "a", "a"],), (["b"],), (["z"],), ([],), (None,), (["c", "b", "a"],)], "_terms array<string>")
    vectors = topics._vectors(df, ["a", "b", "c"], 7)
    assert topics._packs(vectors.coalesce(1)).count() == 1
    monkeypatch.setattr(topics, "PACK_ENTRIES", 2)
    packs = list(topics._packed(vectors.toArrow().to_batches()))
    assert sum(b.num_rows for b in packs) > 1
    lists = [x for b in packs for x in topics._opened(b, 2)]
    got = {(tuple(x.ids[s : s + n]), tuple(x.tf[s : s + n])): c for x in lists for s, n, c in zip(x.starts, x.sizes, x.copies)}
    assert got == {((0, 1), (2, 1)): 2, ((1,), (1,)): 1, ((0, 1, 2), (1, 1, 1)): 1}


# --- networks ---------------------------------------------------------------------------


def test_author_entries_and_edges(spark, monkeypatch):
    data = [("P1", "Ann; Bob ;Cy"), ("P1", "Ann"), ("P2", "Bob;Ann;;"), ("P3", "Dee"), ("P4", None)]
    df = spark.createDataFrame(data, "pub string, authors string")
    entries = network.author_rows(df, "authors", "pub")
    assert entries.count() == 7
    want = [("Ann", "Bob", 2), ("Ann", "Cy", 1), ("Bob", "Cy", 1)]
    assert rows(network.coauthor_edges(entries)) == want
    monkeypatch.setattr(network, "BLOCK", 1)  # every publication in several blocks
    assert rows(network.coauthor_edges(entries)) == want
    assert rows(network.coauthor_edges(entries, 2)) == [("Ann", "Bob", 2)]


def brute_betweenness(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_brute_force(spark):
    rnd = random.Random(6)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = sorted({tuple(sorted(rnd.sample(nodes[:12], 2))) for _ in range(18)})
    v = spark.createDataFrame([(n,) for n in nodes], "author string")
    e = spark.createDataFrame([(a, b, 1) for a, b in edges], "a string, b string, weight long")
    got = dict(rows(network.betweenness(v, e)))
    for n, want in brute_betweenness(nodes, edges).items():
        assert abs(got[n] - want) < 2e-6
    sampled = network.betweenness(v, e, exact_limit=5, pivots=6)
    assert sampled.count() == 14


def test_two_cliques_separate(spark):
    left, right = list("abcde"), list("vwxyz")
    pubs = [(f"l{i}{j}", f"{left[i]};{left[j]}") for i in range(5) for j in range(i)] + [(f"r{i}{j}", f"{right[i]};{right[j]}") for i in range(5) for j in range(i)]
    df = spark.createDataFrame([*pubs, ("bridge", "a;v"), ("solo", "hermit")], "pub string, authors string")
    result = network.coauthor_network(df, "authors", "pub")
    found = defaultdict(set)
    for r in result.rows.collect():
        found[r["community_id"]].add(r["author"])
    assert sorted(map(sorted, found.values())) == [left, ["hermit"], right]
    m = result.metrics.first()
    assert m["n_authors"] == 11 and m["n_edges"] == 21 and m["n_communities"] == 3 and m["modularity"] > 0.4
    assert result.tables["top_authors_by_degree"].first()["author"] == "a"
    with pytest.raises(ValueError):
        network.coauthor_network(df.filter("pub = 'solo'"), "authors", "pub")
