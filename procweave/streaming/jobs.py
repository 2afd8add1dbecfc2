"""Status event streams: (job_id, ts, status, step, progress, message) rows, ordered per job by ts and seq.

Every streaming job has a batch twin that gives the same rows on bounded input.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procweave.functions import fixed
from procweave.operators.ordered import scan

STATE = ["status", "step", "progress", "message"]


def latest_job_state(events: DataFrame) -> DataFrame:
    """Newest status, step, progress and message per job; works on streams (update mode) and tables.

    With a watermark on ``ts`` set by the caller, old jobs can be bounded through ``job_windows``.
    """
    newest = F.max_by(F.struct(*STATE), F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(newest.alias("s"), F.max("ts").alias("ts")).select("job_id", "ts", "s.*")


def _state_key() -> Column:
    return F.struct(*[F.col(c) for c in STATE])


def emit_on_change_batch(events: DataFrame) -> DataFrame:
    """Records that differ from the job's one before, up to and with the first terminal status."""
    ended = F.col("status").isin(fixed.TERMINAL_STATUSES)
    marked = events.withColumn("__state", _state_key()).withColumn("__end", ended.cast("int"))
    seen = scan(marked, ["job_id"], ["ts", "seq"], lag={"__before": "__state"}, running={"__ends": F.col("__end")})
    changed = F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("__state"))
    alive = (F.col("__ends") - F.col("__end")) == 0
    return seen.where(changed & alive).select(*events.columns)


def emit_on_change(events: DataFrame, silence: str = "1 hour") -> DataFrame:
    """Streaming form: state per job is its last record and whether it ended.

    The state of a job is dropped when the watermark shows it silent for ``silence``; each batch of
    a job is read in event order.
    """
    columns = events.columns
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["ts", "seq"])
        now = rows[STATE].astype({"progress": "Int64"}).astype(object)
        now = now.where(now.notna(), None)
        before, ended, high = now.shift(1), False, 0
        fresh = pd.Series(False, index=rows.index)
        if state.exists:
            *last, ended, high = state.get
            before.iloc[0] = last
        else:
            fresh.iloc[0] = True
        # A missing value equals a missing one, as in the batch form.
        same = ((now == before) | (now.isna() & before.isna())).all(axis=1)
        over = rows["status"].isin(fixed.TERMINAL_STATUSES)
        open_before = (over.cumsum() - over == 0) & (not ended)
        high = max(high, int(rows["ts"].max().timestamp() * 1000))
        status, st, progress, message = now.iloc[-1]
        state.update((status, st, None if progress is None else int(progress), message, bool(ended or over.any()), high))
        state.setTimeoutTimestamp(max(high + ms, state.getCurrentWatermarkMs() + 1))
        yield rows[(fresh | ~same) & open_before][columns]

    schema = "status string, step string, progress int, message string, ended boolean, high long"
    return (
        events.withWatermark("ts", silence).groupBy("job_id")
        .applyInPandasWithState(step, events.schema, schema, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _up_to_end(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a job in event order up to its first terminal status, then one marker, then nothing."""
    parts = [b for b in batches if len(b)]
    if state.exists or not parts:
        return
    rows = pd.concat(parts).sort_values(["ts", "seq"])
    over = rows["status"].isin(fixed.TERMINAL_STATUSES)
    rows = rows[over.cumsum() - over == 0]
    if over.any():
        state.update((True,))
        end = rows.iloc[[-1]].copy()
        end[[c for c in rows.columns if c not in ("job_id", "ts", "status")]] = None
        end["step"] = "final"
        rows = pd.concat([rows.astype(object), end.astype(object)])
    yield rows


def replay_then_tail(events: DataFrame, job_id: str, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Query that hands all earlier events of a job and then new ones to ``sink``, and after the first terminal status
    one marker row (step ``final``). Events after the end are not delivered, also after a restart, and the query stops."""
    own = events.where(F.col("job_id") == job_id)
    # The marker has no values in most columns.
    rows = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema])
    told = own.groupBy("job_id").applyInPandasWithState(_up_to_end, rows, "ended boolean", "append", GroupStateTimeout.NoTimeout)
    started: list = []

    def deliver(batch: DataFrame, epoch: int) -> None:
        sink(batch, epoch)
        if not available_now and started and not batch.where("step = 'final'").isEmpty():
            threading.Thread(target=started[0].stop, daemon=True).start()

    writer = told.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    started.append((writer.trigger(availableNow=True) if available_now else writer).start())
    return started[0]


# Share of the run that a step's own progress covers.
STEP_RANGE = {"extract": (35, 50), "extract_queued": (40, 55)}


def overall_progress(current: Column, total: Column, step: str = "extract") -> Column:
    """Place of (current, total) of a step within the whole run, in percent."""
    low, high = STEP_RANGE[step]
    return (F.lit(low) + F.floor(current / F.greatest(total, F.lit(1)) * (high - low))).cast("int")


def job_windows(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """Sessions of activity per job; on a stream give ``lateness`` so that closed sessions leave state."""
    source = events.withWatermark("ts", lateness) if lateness else events
    return source.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(
        "job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events"
    )


def progress_rows(done: DataFrame, job_id: str, total: Column, now: Column) -> DataFrame:
    """Progress of a batch step as status rows, in place of a callback: ``done`` is (current, message)."""
    percent = overall_progress(F.col("current"), total)
    return done.select(
        F.lit(job_id).alias("job_id"), now.alias("ts"), F.lit("processing").alias("status"), F.lit("extract").alias("step"), percent.alias("progress"), "message",
    )
