"""Export of generated rows as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.functions.text import safe_name
from procweave.operators.ordered import first_per_key


def export_listing(rows: DataFrame, name: Column, extension: str, limit: int | None = None) -> DataFrame:
    """Rows with a safe ``file_name`` and the first of each name marked as default."""
    named = rows.withColumn("file_name", F.concat(safe_name(name, limit), F.lit(extension)))
    return named


def default_of(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``is_default`` on the first of each group."""
    first = first_per_key(rows, [group], order).select(group, *order).withColumn("is_default", F.lit(True))
    return rows.join(first, [group, *order], "left").withColumn("is_default", F.coalesce("is_default", F.lit(False)))


def write_rows(rows: DataFrame, path: str, fmt: str, partition_by: list[str] | None = None) -> None:
    """Text (one ``value`` column), JSON or Parquet files, in parallel from every task."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
