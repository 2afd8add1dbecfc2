"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` (zstd) to the shared folder and go on from the written table."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a row number that hold the place in a file; the others hold the file's number.
PLACE_BITS = 40


def _is_scan(df: DataFrame) -> bool:
    """Whether the rows are those of one scan of files, with columns chosen or rows filtered only."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if not node.nodeName().startswith(("LogicalRelation", "Relation")):
        return False
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index"))
    except AnalysisException:
        return False
    return True


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it is a scan of files, else its rows written once. ``identified`` then numbers them alike in every use."""
    return df if _is_scan(df) else settle(df)


def identified(df: DataFrame, rid: str = "rid") -> DataFrame:
    """``df`` with a row number under ``rid`` that stays the same in every scan, so repeated ids stay separate rows.

    It is the file's number (in the order of paths, bounded by the listing that the driver holds anyway) and the row's place in
    the file, whatever splits Spark reads. Rows that are no scan of files are written first (see ``stable``).
    """
    df = stable(df)
    file = df.metadataColumn("_metadata")
    place = file.getField("row_index")
    paths = sorted(r[0] for r in df.select(file.getField("file_path")).distinct().collect())
    if len(paths) < 2:
        return df.select("*", place.alias(rid))
    path, at = fresh(df, "path"), fresh(df, "at")
    files = df.sparkSession.createDataFrame(pd.DataFrame({path: paths, at: np.arange(len(paths))}), f"{path} string, {at} long")
    known = df.select("*", file.getField("file_path").alias(f"{path}_"), place.alias(rid)).join(F.broadcast(files), F.col(f"{path}_") == F.col(path))
    return known.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(rid) + F.shiftleft(at, PLACE_BITS)).alias(rid))


def numbered(df: DataFrame, *columns, rid: str = "rid") -> DataFrame:
    """The named columns and a row number (see ``identified``)."""
    row = fresh(df, "row")
    return identified(df, row).select(F.col(row).alias(rid), *columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a part have about ``size`` bytes at most, or are one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))
