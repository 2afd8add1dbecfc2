import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.llm import topk
from procweave.llm.common import identified


def brute(rows, k, scale=64.0):
    """Whole inner products of every query with every other row."""
    good = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for n, i, q in good:
        if i is None or i % 3:
            continue
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        scored = sorted((-clip(sum(a * b for a, b in zip(q, c))), j is None, j, m) for m, j, c in good if m != n and len(c) == len(q))
        out[n] = [(r + 1, j, -s) for r, (s, _, j, _) in enumerate(scored[:k])]
    return {n: v for n, v in out.items() if v}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [rows[6], rows[6], (None, rows[9][1]), (300, None), (303, []), (306, [1.0, None] * 8), (309, [math.nan] * 16), (312, [math.inf] + [0.0] * 15), (315, [1.0, 2.0]), (318, [3.0, -1.0]), (321, [0.0] * 16)]
    path = str(tmp_path_factory.mktemp("v") / "embeddings.parquet")
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, rid string, score string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("blocks", [(2048, 8192), (7, 20)])
def test_equal_to_brute_force(table, blocks):
    docs, rows = table
    got = {}
    for r in topk.top_k(docs, F.col("vec_id") % 3 == 0, 9, query_block=blocks[0], block=blocks[1]).collect():
        got.setdefault(r["query_rid"], []).append((r["rank"], r["id"], r["score"]))
    want = brute(rows, 9)
    order = [r["__r"] for r in identified(docs, "__r").select("__r").collect()]
    assert {k: sorted(v) for k, v in got.items()} == {order[k]: v for k, v in want.items()}


def test_scores_too_large_for_doubles(spark, tmp_path):
    rows = [(i, [float(2**30 + i), float(3**17 * (i % 5)), 1.0]) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = {}
    for r in topk.top_k(spark.read.parquet(str(tmp_path / "e")), F.col("vec_id") % 3 == 0, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == brute(rows, 4)


def test_bounds_hold_and_get_tighter():
    rng = np.random.default_rng(1)
    a, b = (np.floor(64 * rng.standard_normal((50, 64))) for _ in range(2))
    exact, last = a @ b.T, None
    for s in topk.LEVELS:
        bound = topk.statistics(a, s) @ topk.statistics(b, s).T
        assert (bound >= exact - 1e-6).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound


def test_empty(table):
    assert topk.top_k(table[0].limit(0), F.col("vec_id") % 3 == 0).count() == 0
