"""Best-fit packing of texts into bins of equal capacity, under conflicts.

Texts longer than a bin are cut into pieces. Pieces are dealt at random to groups of bounded size that are packed apart, each
in one task: larger pieces first, each into the fullest bin that has room and holds neither its source nor its cluster of
copies. Bins stand in order of their free room and carry bitmaps of both.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.common import blocks_for, numbered, settle, table

WORD = r"[^\\x20\\x09-\\x0D]+"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, pieces in the given order; a null source or cluster conflicts with nothing."""
    source_bits, cluster_bits = ({v: 1 << i for i, v in enumerate(dict.fromkeys(x for x in values if x is not None))} for values in (sources, clusters))
    room: list[tuple[int, int]] = []  # free room and bin, in order
    held: list[list[int]] = []  # bitmaps of sources and of clusters
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = source_bits.get(source, 0), cluster_bits.get(cluster, 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (held[room[at][1]][0] & s or held[room[at][1]][1] & c):
            at += 1
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        bins.append(b)
        offsets.append(capacity - free)
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets


def pack(
    docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
    cluster_col: str | None = None, group_rows: int = 4096,
) -> DataFrame:
    """Per piece: ``rid``, the id, ``piece, first_word, n_words, bin_id, place`` (words count from 0).

    A bin holds at most ``capacity`` words, and of each source and of each cluster (``cluster_col``, or else equal texts) one
    piece at most. Texts that are null or without words give one piece of no words in no bin. Null sources conflict
    with nothing; repeated rows are copies of one another. Ties in size go by row and piece.
    """
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(text_col)
    cluster = F.when(F.col(cluster_col or text_col).isNotNull(), cluster)
    rows = numbered(docs, F.col(id_col).alias("id"), F.xxhash64(source).alias("source"), source.isNull().alias("bare"), cluster.alias("cluster"), F.expr(f"regexp_count(coalesce(`{text_col}`, ''), '{WORD}')").alias("n"))
    rows = settle(rows.withColumn("source", F.when(~F.col("bare"), F.col("source"))).drop("bare"))
    pieces = rows.filter("n > 0").select(
        "rid", "id", "source", "cluster", "n", F.explode(F.expr(f"sequence(0L, CAST((n - 1) DIV {capacity} AS BIGINT))")).alias("piece")
    ).withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))
    total = rows.agg(F.sum(F.expr(f"(n + {capacity - 1}) DIV {capacity}"))).first()[0] or 0
    groups = blocks_for(total, group_rows)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "rid", "piece"], ascending=[False, True, True])
        lists = [[None if pd.isna(v) else int(v) for v in frame[c]] for c in ("source", "cluster")]
        bins, offsets = best_fit(frame["size"].tolist(), *lists, capacity)
        return frame.assign(bin_id=[int(g) << 32 | b for g, b in zip(frame["grp"], bins)], place=offsets)[["rid", "piece", "size", "bin_id", "place"]]

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)))
    # Digests as text: pandas would turn longs beside nulls into doubles.
    packed = dealt.select("grp", "rid", "piece", F.col("size").cast("long").alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster")).groupBy("grp").applyInPandas(
        work, "rid long, piece long, size long, bin_id long, place long"
    )
    return rows.select("rid", F.col("id").alias(id_col)).join(packed, "rid", "left").select(
        "rid", id_col, F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce(F.col("piece") * capacity, F.lit(0)).alias("first_word"),
        F.coalesce("size", F.lit(0)).alias("n_words"), "bin_id", "place",
    )


def bin_texts(docs: DataFrame, packed: DataFrame, text_col: str = "text") -> DataFrame:
    """``bin_id, text``: the words of a bin's pieces in order. A bin's capacity bounds what is gathered."""
    words = numbered(docs, F.expr(f"regexp_extract_all(`{text_col}`, '{WORD}', 0)").alias("ws"))
    parts = packed.filter("bin_id IS NOT NULL").select("rid", "bin_id", "place", "first_word", "n_words").join(words, "rid").select(
        "bin_id", "place", F.array_join(F.expr("slice(ws, CAST(first_word + 1 AS INT), CAST(n_words AS INT))"), " ").alias("part")
    )
    gathered = parts.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return gathered.select("bin_id", F.array_join(F.col("parts.part"), " ").alias("text"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("rid")
