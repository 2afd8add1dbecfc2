"""Run envelopes and graph snapshots.

``graph_runs`` is (run_id, task_id, metadata, created_at, updated_at); ``graph_snapshots`` is
(run_id, snapshot_type, proc_id, created_at, n_elements, payload_ref). Element rows live in their own
table with a folder per type and bucket of runs, so replacing a snapshot rewrites its bucket only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.operators.ordered import first_per_key
from procweave.session import settle

SNAPSHOT_KEY = ["run_id", "snapshot_type", "proc_id"]


def save_runs(runs: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Upsert of envelopes: the first creation time stays, the update time is set."""
    known = runs.select("run_id", F.col("created_at").alias("__created"))
    fresh = incoming.join(known, "run_id", "left").select(
        "run_id", "task_id", "metadata", F.coalesce("__created", now).alias("created_at"), now.alias("updated_at")
    )
    return runs.join(incoming.select("run_id"), "run_id", "left_anti").unionByName(fresh)


def save_snapshots(snapshots: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the snapshots of the same run, type and process."""
    return snapshots.join(incoming.select(*SNAPSHOT_KEY), SNAPSHOT_KEY, "left_anti").unionByName(incoming.select(*snapshots.columns))


def write_elements(elements: DataFrame, path: str, buckets: int = 64) -> None:
    """Element rows of snapshots (run_id, snapshot_type, proc_id and more) in place of earlier rows of the same key.

    The store has a folder per type and bucket of run ids; only the folders that the new rows touch are rewritten.
    """
    spark = elements.sparkSession
    rows = settle(elements.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")))
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is not None:
        place, key = ["snapshot_type", "bucket"], F.to_json(F.struct(*SNAPSHOT_KEY))
        touched = stored.join(rows.select(*place).distinct(), place, "left_semi").withColumn("__key", key)
        kept = touched.join(rows.select(key.alias("__key")).distinct(), "__key", "left_anti").select(rows.columns)
        rows = settle(kept.unionByName(rows))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_type", "bucket").parquet(path)


def read_elements(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Stored element rows, or those of the snapshots in ``keys`` (run_id, snapshot_type, proc_id)."""
    stored = spark.read.parquet(path).drop("bucket")
    if keys is None:
        return stored
    of = lambda df: F.to_json(F.struct(*[df[c] for c in SNAPSHOT_KEY]))
    wanted = keys.select(of(keys).alias("__key")).distinct()
    return stored.withColumn("__key", of(stored)).join(wanted, "__key", "left_semi").drop("__key")


def load_integrated(snapshots: DataFrame) -> DataFrame:
    """Newest integrated snapshot of each run."""
    return first_per_key(snapshots.where("snapshot_type = 'integrated'"), ["run_id"], [F.desc("created_at"), "proc_id"])


def load_process(snapshots: DataFrame) -> DataFrame:
    """Newest process snapshot of each (run, process)."""
    return first_per_key(snapshots.where("snapshot_type = 'process'"), ["run_id", "proc_id"], [F.desc("created_at"), "snapshot_type"])


def _newest(df: DataFrame, *keys: str) -> DataFrame:
    order = [F.desc("created_at"), F.desc("run_id"), *[c for c in ("proc_id",) if c in df.columns]]
    return first_per_key(df, list(keys), order) if keys else df.orderBy(*order).limit(1)


def latest_integrated(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest integrated snapshot over all runs, with its run's task."""
    return _newest(snapshots.where("snapshot_type = 'integrated'")).join(runs.select("run_id", "task_id"), "run_id")


def latest_by_process(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest process snapshot of each process over all runs, with its run's task."""
    return _newest(snapshots.where("snapshot_type = 'process'"), "proc_id").join(runs.select("run_id", "task_id"), "run_id")


def integrated_of_process(snapshots: DataFrame) -> DataFrame:
    """Newest integrated snapshot of a run that holds a snapshot of the process, per process."""
    holders = snapshots.where("snapshot_type = 'process'").select("run_id", F.col("proc_id").alias("source_proc_id")).distinct()
    whole = snapshots.where("snapshot_type = 'integrated'").drop("proc_id")
    return _newest(holders.join(whole, "run_id"), "source_proc_id")


def integrated_of_task(snapshots: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Newest integrated snapshot of each asked (task_id): by the run's task, else by a run id that
    starts with the task and a dash, else by metadata that mention it."""
    from procweave.operators.contain import contained_in

    asked = tasks.select("task_id").where("task_id <> ''").distinct()
    exact = asked.join(runs.select("run_id", "task_id").hint("merge"), "task_id").select("task_id", "run_id", F.lit(1).alias("rank"))
    # Every dash of a run id ends a prefix that may be a task id, so the lookup stays an equi join.
    parts = runs.select("run_id", F.split("run_id", "-").alias("p")).where(F.size("p") > 1)
    prefixes = parts.select(
        "run_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", F.lit(1), n), "-"))).alias("task_id")
    )
    prefix = asked.join(prefixes.hint("merge"), "task_id").select("task_id", "run_id", F.lit(2).alias("rank"))
    told = contained_in(
        runs.where("metadata IS NOT NULL").select(F.col("run_id").alias("text_id"), F.col("metadata").alias("text")),
        asked.select(F.col("task_id").alias("name_id"), F.col("task_id").alias("keyword")),
    ).select(F.col("name_id").alias("task_id"), F.col("text_id").alias("run_id"), F.lit(3).alias("rank"))
    hits = exact.unionByName(prefix).unionByName(told)
    found = hits.join(snapshots.where("snapshot_type = 'integrated'").drop("proc_id").hint("merge"), "run_id")
    return first_per_key(found, ["task_id"], ["rank", F.desc("created_at"), F.desc("run_id")])


def graph_by_source(snapshots: DataFrame, runs: DataFrame, run_id: str | None = None, task_id: str | None = None) -> DataFrame:
    """Snapshot of a run when named, else of a task, else the newest."""
    if run_id:
        return load_integrated(snapshots.where(F.col("run_id") == run_id))
    if task_id:
        asked = runs.sparkSession.createDataFrame([(task_id,)], "task_id string")
        return integrated_of_task(snapshots, runs, asked)
    return latest_integrated(snapshots, runs)


def process_graph_or_snapshot(live: DataFrame, stored: DataFrame, key: str = "proc_id") -> DataFrame:
    """Live graph rows of a process where there are any, else the stored ones."""
    return live.unionByName(stored.join(live.select(key), key, "left_anti").select(*live.columns))
