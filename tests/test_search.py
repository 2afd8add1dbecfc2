import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.operators import vectors


def brute(queries, entities, limit):
    words = {i: Counter(t.lower().split()) for i, t in entities}
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, text in queries:
        asked = set(text.lower().split())
        scores = [(round(sum(c[w] * math.log(1 + len(entities) / df[w]) for w in asked if w in c), 6), i) for i, c in words.items() if asked & set(c)]
        out += [(q, i, s, n) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:limit], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def names():
    """Every third name holds one common word, another is in all of them; some names are equal."""
    rng = random.Random(2)
    rare = [f"r{i}" for i in range(60)]
    entities = [(i, " ".join(["all"] + ["common"] * (i % 3 == 0) + rng.choices(rare, k=rng.randrange(0, 4)))) for i in range(600)]
    queries = [(i, " ".join(["all", "common"] * (i % 2) + rng.sample(rare, rng.randrange(0, 4)))) for i in range(30)] + [(98, "all common"), (99, "unheard of")]
    return queries, entities


@pytest.mark.parametrize("part_rows", [10_000, 50])
def test_name_search_equals_full_sums(spark, names, part_rows):
    queries, entities = names
    index = vectors.name_index(spark.createDataFrame(entities, "entity_id int, text string"))
    got = vectors.search_names(spark.createDataFrame(queries, "query_id int, text string"), index, 5, part_rows)
    assert sorted((r["query_id"], r["entity_id"], r["score"], r["rank"]) for r in got.collect()) == brute(queries, entities, 5)


def test_common_words_do_not_lead(spark, names):
    """A word whose impact stays below a query's bar proposes nothing, so its postings meet no query that has a rarer word."""
    queries, entities = names
    index = vectors.name_index(spark.createDataFrame(entities, "entity_id int, text string"))
    terms = spark.createDataFrame(queries, "query_id int, text string").select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token")).where("token <> ''")
    postings = index.select("token", "entity_id", (F.col("tf") * F.log1p(F.col("n") / F.col("df"))).alias("impact"), "df")
    rows = vectors.term_bounds(terms, postings, 5).collect()
    rare = {r["query_id"] for r in rows if r["token"].startswith("r")}
    assert rare and not [r for r in rows if r["token"] == "all" and r["query_id"] in rare and r["leads"]]
    assert [r["leads"] for r in rows if r["query_id"] == 98 and r["token"] == "common"] == [True]


@pytest.mark.parametrize("bucket_rows", [vectors.BUCKET_ROWS, 20])
def test_approximate_join_equals_all_pairs_that_share_a_key(spark, monkeypatch, bucket_rows):
    """Buckets of any size, whole or in blocks, give each pair once with the score of ``cosine``; no table of candidate pairs is made."""
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(300, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    joined = vectors.ann_join(v, 0.5, bands=3, bits=2, bucket_rows=bucket_rows)
    m = np.array([x for _, x in rows])
    keys = (m @ np.random.default_rng(7).standard_normal((8, 6)) > 0).reshape(-1, 3, 2) @ np.array([1, 2])
    a, b = (v.select(F.col("id").alias(f"{s}_id"), F.col("embedding").alias(s)) for s in ("left", "right"))
    near = a.join(b, F.col("left_id") < F.col("right_id")).select("left_id", "right_id", F.round(vectors.cosine("left", "right"), 9).alias("score")).where("score >= 0.5").collect()
    want = sorted((x.left_id, x.right_id, x.score) for x in near if (keys[x.left_id] == keys[x.right_id]).any())
    assert sorted(map(tuple, joined.collect())) == want and 0 < len(want) < len(near)


def test_approximate_join_reaches_its_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.6 * rng.standard_normal(16)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(50)]
    v = spark.createDataFrame(rows, "id int, embedding array<double>")
    m = np.array([r[1] for r in rows[:600]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(m @ m.T, 9) >= 0.7
    np.fill_diagonal(near, False)
    measured = {r["id"]: r for r in vectors.recall_of(vectors.ann_join(v, 0.7, bits=8), v, 0.7, F.col("id") % 5 == 0).collect()}
    assert {i: r["n_exact"] for i, r in measured.items()} == {i: int(near[i].sum()) for i in range(0, 600, 5)}
    assert sum(r["n_found"] for r in measured.values()) >= 0.9 * sum(r["n_exact"] for r in measured.values())
    assert vectors.bands_for(0.7, 0.95, 8) > vectors.bands_for(0.7, 0.5, 8) >= 1


def test_pairs_of_queries_and_entities_are_no_rows(spark, monkeypatch):
    """Sums are made in cells of entities, which give a query's best ones only; copies tie by id, across cells as well."""
    seen = []
    settle = vectors.settle
    monkeypatch.setattr(vectors, "settle", lambda df: seen.append(df.columns) or settle(df))
    monkeypatch.setattr(vectors, "TERMS_PER_BLOCK", 3, raising=False)
    entities = [(f"e{i:03d}", "all common red" if i % 2 else f"all blue x{i}") for i in range(120)]
    queries = [(f"q{i}", t) for i, t in enumerate(["red common", "all", "blue x8 nowhere", "nowhere", "common x10 x12 all"])]
    index = vectors.name_index(spark.createDataFrame(entities, "entity_id string, text string"))
    got = vectors.search_names(spark.createDataFrame(queries, "query_id string, text string"), index, 4, 25)
    assert sorted((r["query_id"], r["entity_id"], r["score"], r["rank"]) for r in got.collect()) == brute(queries, entities, 4)
    assert not [c for c in seen if {"query_id", "entity_id"} <= set(c)]


@pytest.mark.parametrize("block_rows", [None, 30])
def test_join_without_recall_finds_every_pair(spark, monkeypatch, block_rows):
    """Pairs that no key would bring together and pairs of copies count as well; zero vectors are like none."""
    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(150)]
    rows += [(150 + i, rows[i % 3][1]) for i in range(9)] + [(159, [0.0] * 8), (160, [0.0] * 8), (161, None), (None, rows[0][1])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    a, b = (v.select(F.col("id").alias(f"{s}_id"), F.col("embedding").alias(s)) for s in ("left", "right"))
    want = a.join(b, F.col("left_id") < F.col("right_id")).select("left_id", "right_id", F.round(vectors.cosine("left", "right"), 9).alias("score")).where("score >= 0.4")
    got = vectors.ann_join(v, 0.4, bits=6, bucket_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("left_id in (150, 153) and right_id = 156").count() == 2


@pytest.mark.parametrize("block_rows", [None, 40])
@pytest.mark.parametrize("skip", [False, True])
def test_top_k_equals_all_pairs(spark, monkeypatch, block_rows, skip):
    """Copies tie by id, in any blocks, when bounds of groups tell which pairs are compared exactly."""
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(280)]
    rows += [(280 + i, rows[i % 2][1]) for i in range(40)] + [(320, [0.0] * 6), (321, None)]
    v = spark.createDataFrame(rows, "id int, embedding array<float>")
    q, c = v.where("id % 3 = 0").withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "chunk_id")
    m = np.array(v.where("id < 321").orderBy("id").toPandas()["embedding"].tolist(), dtype=np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(m @ m.T, 9)
    want = []
    for i in range(0, 321, 3):
        best = sorted((j for j in range(321) if not (skip and i == j)), key=lambda j: (-scores[i, j], j))[:4]
        want += [(i, j, n, round(scores[i, j], 6) + 0.0) for n, j in enumerate(best, 1)]
    got = vectors.top_k_similar(q, c, 4, block_rows, skip)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 6) + 0.0) for r in got.collect()) == sorted(want)
