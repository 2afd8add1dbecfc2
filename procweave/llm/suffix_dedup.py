"""Suffix-array deduplication of byte strings, by longest-previous-factor arrays.

Candidates come from ``windows``: only texts and segments that can hold a repeated window are sorted. Their
suffixes are put in suffix order (ties by place), where a suffix has an earlier match of full length if the
previous smaller place in suffix order shares it, and a later one if the next larger place does.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.common import fresh, identified, numbered, stable, table
from procweave.llm.windows import HOT, grow_ranks, remove_repeats, whole_windows

LAST = 2**63 - 1


def factor_matches(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where ``width`` bytes match at an earlier and at a later start, and where each text begins.

    The factor arrays are cut at ``width``: the order of the suffixes goes to that depth and equal suffixes stand by
    place. So within a class the previous smaller place is the neighbour before, the next larger the one after.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    earlier, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    pack = min(8, width)
    if len(data) < width:
        return earlier, later, bounds
    packed = np.zeros(len(data) - pack + 1, np.uint64)
    for j in range(pack):
        packed = packed << np.uint64(8) | data[j : j + len(packed)]
    ranks = grow_ranks(packed, width, pack)
    shared = np.flatnonzero((ranks > 0) & whole_windows(bounds, len(ranks), width))
    suffixes = shared[np.lexsort((shared, ranks[shared]))]
    same = ranks[suffixes[1:]] == ranks[suffixes[:-1]]
    earlier[suffixes[1:][same]] = True
    later[suffixes[:-1][same]] = True
    return earlier, later, bounds


def judge(texts: list[bytes], width: int, keep_first: bool) -> list[np.ndarray]:
    earlier, later, bounds = factor_matches(texts, width)
    flags = earlier if keep_first else earlier | later
    return [flags[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return numbered(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))


def dedup_bytes(docs: DataFrame, width: int = 200, gram: int | None = None, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: ``rid``, the id, ``n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte covered by a ``width``-byte string that also starts elsewhere is removed; with ``keep_first`` only where
    an earlier start (smaller id, then row, then place) has it. A null text counts as empty; rows with a null id come
    last; rows with equal ids are separate documents. Very long texts are cut in overlapping slices, so no match is lost. Other columns are not
    read, and an empty table gives no rows. Ids must be integers. ``gram`` (default about a third of ``width``) sets
    the length of the compared grams and changes no result.
    """
    source = _prepared(docs, id_col, text_col)
    gone = remove_repeats(source, False, width, gram or max(1, width * 8 // 25), partial(judge, width=width, keep_first=keep_first), keep_first, hot=hot).drop("kept")
    base = source.select("rid", F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return base.join(gone, "rid", "left").select(
        "rid", id_col, "n_bytes", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("runs", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame, width: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, with repeated byte strings cut out of the text.

    Untouched texts, nulls included, stay as they are. What is left of a character that was cut in two goes as well.
    """
    docs = stable(docs)
    source = _prepared(docs, id_col, text_col)
    gone = remove_repeats(source, False, width, max(1, width * 8 // 25), partial(judge, width=width, keep_first=keep_first), keep_first, keep_text=True)
    row, cut, kept = fresh(docs, "row"), fresh(docs, "cut"), fresh(docs, "kept")
    left = identified(docs, row)
    out = left.join(gone.select(F.col("rid").alias(cut), F.col("kept").alias(kept)), F.col(row) == F.col(cut), "left")
    return out.withColumn(text_col, F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.col(kept))).select(docs.columns)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("rid")
