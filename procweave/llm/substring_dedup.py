"""Substring deduplication over words, by prefix-partitioned suffix trees.

Candidates come from ``windows``. The suffixes of the segments of a task are split by prefixes of growing length:
a group of one suffix is a leaf and done with, a group of several is an inner node and is split further. Inner
nodes at the wanted depth are the repeats; their first leaf stays, the others are later copies.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.common import numbered, table
from procweave.llm.suffix_dedup import LAST
from procweave.llm.windows import HOT, grow_ranks, remove_repeats, symbols, whole_windows

#: Fixed: what stands between words.
SPACES = r"[\\x20\\x09-\\x0D]+"


def deep_nodes(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes under inner nodes of depth ``width`` or more, by node and place, and which is a node's first leaf."""
    nodes = grow_ranks(values, width)
    leaves = np.flatnonzero((nodes > 0) & whole_windows(bounds, len(nodes), width))
    leaves = leaves[np.lexsort((leaves, nodes[leaves]))]
    first = np.ones(len(leaves), bool)
    first[1:] = nodes[leaves[1:]] != nodes[leaves[:-1]]
    return leaves, first


def judge(texts: list[bytes], width: int) -> list[np.ndarray]:
    values, bounds = symbols(texts, words=True)
    leaves, first = deep_nodes(values, bounds, width)
    later = np.zeros(len(values), bool)
    later[leaves[~first]] = True
    return [later[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def dedup_words(docs: DataFrame, width: int = 20, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: ``rid``, the id, ``n_words, n_removed, kept_sha256`` (and ``kept_text`` if asked for).

    A word is removed if a window of ``width`` words over it also starts earlier (smaller id, then row, then place).
    A null text has no words; rows with a null id come last; rows with equal ids are separate documents. Very long texts are cut in
    overlapping slices, so no window is lost. Other columns are not read, and an empty table gives no rows. ``gram``
    (default a quarter of ``width``) changes no result.
    """
    source = numbered(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    gone = remove_repeats(source, True, width, gram or max(1, width // 4), partial(judge, width=width), True, keep_text, hot)
    base = source.select("rid", F.col("id").alias(id_col), F.expr(f"array_remove(split(text, '{SPACES}'), '')").alias("ws")).select(
        "rid", id_col, F.size("ws").cast("long").alias("n_words"), F.sha2(F.array_join("ws", " "), 256).alias("whole"), *([F.array_join("ws", " ").alias("all")] if keep_text else [])
    )
    text = [F.when(F.col("sha").isNull(), F.col("all")).otherwise(F.col("kept")).alias("kept_text")] if keep_text else []
    return base.join(gone, "rid", "left").select(
        "rid", id_col, "n_words", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"), *text
    )


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents")).drop("rid")


SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS w FROM doc, unnest(range(1, len(ws) - 18)) AS t(s)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(s, s + 20)) AS t(p)),
word AS (SELECT doc_id, p, ws[p] AS w FROM doc, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS txt
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
