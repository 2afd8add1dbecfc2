"""Vector and text search queries (C, U1)."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from procweave.operators import vectors
from procweave.plans.base import query
from procweave.plans.readings import spread, table
from procweave.session import settle

_LETTERS = list(string.ascii_lowercase)


def letter_profile(text):
    """Counts of the letters a to z: a small embedding that SQL can compute as well."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS])


def _sql_profile(x: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({x})) - length(replace(lower({x}), '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"


def _vectors(spark, sf_dir, name):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), "embedding")


@query("c1_embed")
def c1(spark, sf_dir):
    docs = vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", dim=256)
    return docs.select(
        "doc_id",
        F.size(F.filter("embedding", lambda x: x != 0)).alias("n_nonzero"),
        F.round(vectors.norm("embedding"), 4).alias("norm"),
    )


def _shape(texts: list[str]) -> list[list[float]]:
    return [[len(t), t.count("\n"), t.count(" ")] for t in texts]


@query(
    "u1_embed_with_function",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS x0,
              CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS x1,
              CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS x2 FROM documents""",
)
def u1(spark, sf_dir):
    docs = vectors.embed_with(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _shape)
    return docs.select("doc_id", *[F.col("embedding")[i].alias(f"x{i}") for i in range(3)])


@query(
    "c2_cosine",
    """WITH c AS (SELECT label, min(vec_id) AS ref_id FROM embeddings GROUP BY label)
       SELECT e.vec_id, c.ref_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings e JOIN c USING (label) JOIN embeddings r ON r.vec_id = c.ref_id""",
)
def c2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ref = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("r"))
    return e.join(ref, "label").select(
        "vec_id", F.col("r.vec_id").alias("ref_id"), F.round(vectors.cosine("embedding", "r.embedding"), 6).alias("score")
    )


_NEAR = """
near AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings q, embeddings c))
"""


@query(
    "c3_top_k_similar",
    f"WITH {_NEAR} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 5",
)
def c3(spark, sf_dir):
    near = vectors.top_k_similar(_vectors(spark, sf_dir, "query_id"), _vectors(spark, sf_dir, "chunk_id"), 5)
    return near.withColumn("score", F.round("score", 6))


@query("c4_ann_join")
def c4(spark, sf_dir):
    return vectors.ann_join(_vectors(spark, sf_dir, "id"), 0.4, bits=6)


@query(
    "c4_ann_recall",
    """WITH v AS (SELECT min(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings GROUP BY embedding),
       l AS (SELECT a.id, count(*) AS n FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0 AND round(list_cosine_similarity(a.e, b.e), 9) >= 0.4 GROUP BY 1)
       SELECT id, coalesce(n, 0) AS n_exact, TRUE AS recall_reached FROM v LEFT JOIN l USING (id) WHERE id % 20 = 0""",
)
def c4_recall(spark, sf_dir):
    v = _vectors(spark, sf_dir, "id")
    measured = settle(vectors.recall_of(vectors.ann_join(v, 0.4, bits=6, recall=0.999), v, 0.4, F.col("id") % 20 == 0))
    whole = measured.agg((F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recall_reached")).withColumn("one", F.lit(1))
    # A global aggregate is one row, so it can always be broadcast.
    return measured.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("id", "n_exact", "recall_reached")


# Word postings of documents and the ranked hits of every benchmark passage.
_HITS = """
w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM documents),
tf AS (SELECT token, doc_id, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
n AS (SELECT count(*) AS n FROM documents),
qt AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM benchmark),
sc AS (SELECT item_id AS query_id, doc_id AS entity_id, round(sum(tf * ln(1 + n / df)), 6) AS score
       FROM qt JOIN tf USING (token) JOIN df USING (token), n GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM sc)
"""


@query(
    "c5_search_names",
    f"WITH {_HITS} SELECT query_id, entity_id, score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 10",
)
def c5(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vectors.search_names(asked, vectors.name_index(docs, asked))


_RESOLVED = f"""
{_HITS},
cand AS (SELECT query_id, entity_id,
           round(list_cosine_similarity({_sql_profile('b.text')}, {_sql_profile('d.text')}), 6) AS score
         FROM hits JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = entity_id WHERE rank <= 10),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rn FROM cand) WHERE rn = 1),
resolved AS (SELECT item_id AS new_id, entity_id AS match_id, score,
           CASE WHEN score >= 0.90 THEN 'merge' WHEN score >= 0.80 THEN 'review' ELSE 'create' END AS action
         FROM benchmark LEFT JOIN best ON query_id = item_id)
"""


def _resolved(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text"))
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity_id"), "text")
    with_profile = lambda d: d.withColumn("embedding", letter_profile(F.col("text")))
    return vectors.resolve(with_profile(new), with_profile(docs))


@query("c6_resolve", f"WITH {_RESOLVED} SELECT * FROM resolved")
def c6(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(
    "c7_resolve_or_create",
    f"""WITH {_RESOLVED} SELECT new_id, CASE WHEN action = 'merge' THEN match_id END AS existing_id,
        action = 'review' AS pending FROM resolved""",
)
def c7(spark, sf_dir):
    return vectors.resolve_or_create(_resolved(spark, sf_dir))


@query(
    "c8_semantic_search",
    f"""WITH {_NEAR},
        b AS (SELECT query_id, label AS entity_id, max(score) AS score FROM near JOIN embeddings ON vec_id = chunk_id
              WHERE rank <= 6 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM b)
        SELECT query_id, 'task' AS entity_type, entity_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def c8(spark, sf_dir):
    links = table(spark, sf_dir, "embeddings").select(
        F.lit("task").alias("entity_type"), F.col("label").alias("entity_id"), F.col("vec_id").alias("chunk_id")
    )
    found = vectors.semantic_search(_vectors(spark, sf_dir, "query_id"), _vectors(spark, sf_dir, "chunk_id"), links, 3)
    return found.withColumn("score", F.round("score", 6))
