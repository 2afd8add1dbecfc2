"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each block is drawn first, with row sums the partition sizes and column
sums the block sizes. Every task draws its own row of the matrix from shared seeds, so the matrix is never held as a whole.
Rows are permuted within their partition, exchanged, and permuted again within their block. A shard is one or more blocks, so
no task has to order a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procweave.llm.common import blocks_for, fresh, table

#: Populations from which numpy draws; larger ones are drawn by rejection.
NUMPY_LIMIT = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones among ``sample`` drawn without replacement, for populations of any size."""
    if good + bad <= NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    weight = lambda x: -sum(map(math.lgamma, (x + 1, good - x + 1, sample - x + 1, bad - sample + x + 1)))
    top = weight(min(high, max(low, (sample + 1) * (good + 1) // (total + 2))))
    mean = sample * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - sample) / max(1, total - 1)) + 0.5)
    # Ratio of uniforms (Stadlober 1990): the constants bound the table mountain over the discrete density.
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= weight(x) - top:
            return x


def split_columns(rng: np.random.Generator, columns: list[int], sample: int) -> list[int]:
    """How many of ``sample`` rows go to each column, columns filling up to the given sizes."""
    rest, out = sum(columns), []
    for c in columns:
        x = hypergeometric(rng, c, rest - c, sample) if sample else 0
        out.append(x)
        rest, sample = rest - c, sample - x
    return out


def matrix_row(sizes: list[int], columns: list[int], part: int, seed: int) -> list[int]:
    """Row ``part`` of the matrix: halves of the partitions share the columns by seeded draws, down to one partition."""
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        left = split_columns(np.random.default_rng([seed, low, high]), columns, sum(sizes[low:middle]))
        if part < middle:
            columns, high = left, middle
        else:
            columns, low = [c - x for c, x in zip(columns, left)], middle
    return columns


def even_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard(df: DataFrame, shards: int = 40, seed: int = 0, block_rows: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard) in a uniform random order.

    Shard sizes differ by one row at most. Rows are dealt by place, so nulls, long texts and repeated rows need no care; an empty
    table stays empty. Columns of ``df`` called shard or slot are replaced. ``df`` must give the same rows in the same partitions
    when read again (a scan, or a settled table); a partition that does not is an error.
    """
    df = df.drop("shard", "slot")
    block_name, place_name = fresh(df, "block"), fresh(df, "place")
    counted = {r["p"]: r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}
    total = sum(counted.values())
    sizes = [counted.get(p, 0) for p in range(max(counted, default=0) + 1)]
    starts, columns, owners = [], [], []
    for s, rows in enumerate(even_sizes(total, shards)):
        at = 0
        for block in even_sizes(rows, blocks_for(rows, block_rows)):
            owners.append(s)
            starts.append(at)
            columns.append(block)
            at += block

    def deal(batches):
        part = TaskContext.get().partitionId()
        rows = sizes[part] if part < len(sizes) else 0
        target = np.repeat(np.arange(len(columns), dtype=np.int32), matrix_row(sizes, columns, part, seed)) if rows else np.zeros(0, np.int32)
        np.random.default_rng([seed, part]).shuffle(target)
        at = 0
        for batch in batches:
            if at + batch.num_rows > rows:
                raise RuntimeError("the input gave other rows than when it was counted; settle it first")
            place = np.arange(at, at + batch.num_rows, dtype=np.int64) + (part << 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(target[at : at + batch.num_rows]), pa.array(place)], names=[*batch.schema.names, block_name, place_name])
            at += batch.num_rows
        if at != rows:
            raise RuntimeError("the input gave other rows than when it was counted; settle it first")

    dealt = df.mapInArrow(deal, T.StructType([*df.schema.fields, T.StructField(block_name, T.IntegerType()), T.StructField(place_name, T.LongType())]))
    order = Window.partitionBy(block_name).orderBy(F.xxhash64(F.lit(seed), place_name), place_name)
    at = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), F.col(block_name) + 1).cast(kind) if len(values) > 1 else F.lit(values[0]).cast(kind)
    return dealt.withColumn("slot", (F.row_number().over(order) - 1 + at(starts, "long")).cast("long")).withColumn("shard", at(owners, "int")).drop(block_name, place_name)


def op1_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    dealt = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
