"""Rows dealt in blocks that meet two by two."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet_each_other(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows with ``cell`` and ``side``, sorted by cell: a cell holds one block (side 0) or two (sides 1 and 2)."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))
    meets = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")),
        lambda other: F.struct(
            (F.least(block, other) * blocks + F.greatest(block, other)).alias("cell"), F.when(block == other, 0).when(block < other, 1).otherwise(2).alias("side")
        ),
    )
    dealt = df.select(F.explode(meets).alias("m"), *df.columns).select("m.cell", "m.side", *df.columns)
    return dealt.repartition(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell")


def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches that are sorted by it."""
    held, last = [], None
    for batch in batches:
        at = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin == end:
                continue
            if held and at[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = at[begin]
    if held:
        yield pa.Table.from_batches(held)
