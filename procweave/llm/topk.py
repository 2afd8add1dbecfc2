"""Exact top-k by inner product, pruned with segment statistics at several resolutions.

Per segment of a vector its sum and the length of what deviates from its mean are kept. For a pair, sums give the part of the
inner product that the means explain, and deviations bound the rest (Cauchy-Schwarz), so each resolution bounds the score from above (the
distance from below). A pair is computed exactly only if no bound, coarse to fine, is below the query's k-th best score so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.common import blocks_for, numbered, settle, table

LEVELS = (1, 4, 16)
TILE = 1024
LONG = 2**63 - 1


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Features whose inner products bound those of the vectors: scaled sums, then deviations, of each segment."""
    edges = np.unique(np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int))
    lengths = np.diff(edges)
    sums = np.add.reduceat(vectors, edges[:-1], axis=1)
    squares = np.add.reduceat(vectors * vectors, edges[:-1], axis=1)
    return np.concatenate((sums / np.sqrt(lengths), np.sqrt(np.maximum(squares - sums * sums / lengths, 0))), axis=1)


def best_of(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, candidate index and score of the ``k`` best candidates of each query, never the query's own row."""
    if not len(queries) or not len(vectors):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    top = max(np.abs(queries).max(), np.abs(vectors).max())
    exact = queries.shape[1] * top * top < 2.0**53
    if not exact:
        # Too large for doubles to be exact: whole numbers, each pair computed.
        queries, vectors = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (queries, vectors))
    order = np.argsort(-(vectors * vectors).sum(axis=1), kind="stable")
    if exact:
        left, right = ([statistics(m, s) for s in LEVELS] for m in (queries, vectors))
        slack = 1e-9 * (1 + np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((vectors**2).sum(axis=1).max()))
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if not exact else np.float64)]
    floor = np.full(len(queries), -np.inf)
    for at in range(0, len(order), TILE):
        part = order[at : at + TILE]
        live = query_rows[:, None] != rows[part][None, :]
        if exact:
            for a, b in zip(left, right):
                asked = np.flatnonzero(live.any(axis=1))
                if not len(asked):
                    break
                live[asked] &= a[asked] @ b[part].T + slack[asked] >= floor[asked][:, None]
        asked = np.flatnonzero(live.any(axis=1))
        if not len(asked):
            continue
        scores = queries[asked] @ vectors[part].T
        if not exact:
            scores = np.minimum(np.maximum(scores, -LONG - 1), LONG)
        shown = np.where(live[asked], scores, -np.inf)
        if exact and len(part) > k:
            shown[shown < np.partition(shown, len(part) - k, axis=1)[:, len(part) - k][:, None]] = -np.inf
        i, j = np.nonzero(shown > -np.inf)
        found = [np.concatenate(x) for x in zip(found, (asked[i], part[j], scores[i, j]))]
        keep = np.array(sorted(range(len(found[0])), key=lambda r: (found[0][r], -found[2][r], ids[found[1][r]])), np.int64) if not exact else np.lexsort((ids[found[1]], -found[2], found[0]))
        found = [x[keep] for x in found]
        begin = np.flatnonzero(np.concatenate(([True], found[0][1:] != found[0][:-1])))
        rank = np.arange(len(found[0])) - np.repeat(begin, np.diff(np.append(begin, len(found[0]))))
        found = [x[rank < k] for x in found]
        if exact:
            last = rank[rank < k] == k - 1
            floor[found[0][last]] = found[2][last]
    whole = found[2].astype(np.int64)
    return found[0], found[1], whole


def top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = 2048, block: int = 8192,
) -> DataFrame:
    """``query_rid, query_id, rank, id, score`` of the ``k`` best other rows for each row with ``is_query``.

    Components are ``floor(scale * x)`` in doubles; scores are whole inner products (beyond 64 bits cut to the range), ties go
    to the smaller id, then row. Vectors that are null or hold nulls or values that are not finite take no part; vectors of
    different lengths do not meet. Rows with equal ids are separate, and meet. Queries meet candidates in blocks of bounded size.
    """
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) != float("inf")))
    source = numbered(vectors, F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), whole.alias("whole"))
    source = settle(source.filter("whole").drop("whole"))
    counts = source.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    down, across = blocks_for(counts["q"] or 0, query_block), blocks_for(counts["n"], block)
    spread = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    size = F.size("v").alias("size")
    asked = source.filter("q").select("rid", "id", "v", size, F.lit(True).alias("q"), spread(down).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"))
    given = source.select("rid", "id", "v", size, F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), spread(across).alias("x"))

    def cell(rows: pa.Table) -> pa.Table:
        asks = rows.column("q").to_numpy()
        rids, ids = rows.column("rid").to_numpy(), rows.column("id").fill_null(LONG).to_numpy()
        lists = rows.column("v").combine_chunks()
        flat = np.floor(lists.flatten().to_numpy() * scale).reshape(len(rids), -1)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        c = c[np.argsort(rids[c], kind="stable")]
        i, j, score = best_of(flat[q], rids[q], flat[c], rids[c], ids[c], k)
        return pa.table({"query_rid": rids[q[i]], "query_id": rows.column("id").take(pa.array(q[i])), "rid": rids[c[j]], "id": rows.column("id").take(pa.array(c[j])), "score": score})

    best = asked.unionByName(given).groupBy("y", "x", "size").applyInArrow(cell, "query_rid long, query_id long, rid long, id long, score long")
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_rid", "query_id", "rank", "id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
