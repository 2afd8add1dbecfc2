import datetime
import tempfile

from procweave.streaming import jobs

SCHEMA = "job_id string, ts timestamp, seq long, status string, step string, progress int, message string"


def _rows():
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    return [
        [("a", t(1), 1, "run", "x", 1, ""), ("a", t(2), 2, "run", "x", 1, ""), ("b", t(2), 3, "run", "x", 1, "")],
        [("a", t(3), 4, "run", "x", 2, ""), ("b", t(4), 5, "completed", "x", 9, ""), ("b", t(5), 6, "run", "x", 1, "")],
        [("a", t(6), 7, "run", "x", 1, ""), ("b", t(7), 8, "failed", "x", 1, "")],
    ]


def test_stream_over_several_batches_equals_its_batch_twin(spark):
    folder, out, state = (tempfile.mkdtemp(prefix="procweave-stream-") for _ in range(3))
    for i, rows in enumerate(_rows()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    run = jobs.emit_on_change(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(r.seq for r in spark.read.parquet(out).collect())
    whole = spark.createDataFrame([r for part in _rows() for r in part], SCHEMA)
    want = sorted(r.seq for r in jobs.emit_on_change_batch(whole).collect())
    assert got == want == [1, 3, 4, 5, 7]


def test_missing_progress_is_a_state_like_any_other(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    parts = [[("a", t(1), 1, "run", None, None, None), ("a", t(2), 2, "run", None, None, None)], [("a", t(3), 3, "run", None, None, None), ("a", t(4), 4, "run", "x", 5, None)], [("a", t(5), 5, "run", None, None, None)]]
    folder, out, state = (tempfile.mkdtemp(prefix="procweave-stream-") for _ in range(3))
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.emit_on_change(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([r for rows in parts for r in rows], SCHEMA)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == sorted(r.seq for r in jobs.emit_on_change_batch(whole).collect()) == [1, 4, 5]


def test_one_final_marker_and_nothing_after_the_end(spark):
    folder, state = (tempfile.mkdtemp(prefix="procweave-stream-") for _ in range(2))
    for rows in _rows():
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    seen = []
    sink = lambda batch, epoch: seen.extend((r.seq, r.step) for r in batch.collect())
    for _ in range(2):  # the second run goes on from the checkpoint
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.replay_then_tail(stream, "b", sink, state, available_now=True).awaitTermination()
        spark.createDataFrame([("b", datetime.datetime(2024, 1, 1, 0, 1), 99, "completed", "x", 1, "")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert sorted(seen, key=str) == [(3, "x"), (5, "x"), (None, "final")]


def test_latest_state(spark):
    whole = spark.createDataFrame([r for part in _rows() for r in part], SCHEMA)
    assert {(r.job_id, r.status, r.progress) for r in jobs.latest_job_state(whole).collect()} == {("a", "run", 1), ("b", "failed", 1)}
