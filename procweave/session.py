"""Session set-up and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "procweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join handling on.

    ``master`` is left to spark-submit unless given; keyword arguments use ``__`` for dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the executors would not
    see it, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = os.environ.get("PROCWEAVE_LOCAL_DIR") or tempfile.mkdtemp(prefix="procweave-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there; ``by`` gives each of its few values a folder.

    Later steps then have a short plan, read only the columns they need, know the real size, and a
    lost executor costs no recomputation of what came before. Tables stay until the folder is
    cleaned, as checkpoints do.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
