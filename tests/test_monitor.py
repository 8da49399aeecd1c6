import pytest
from pyspark.sql import functions as F

from tarnfield.streaming import monitor

SCHEMA = "run_id long, sequence long, state string, progress double, ts timestamp"


def events(spark, *rows):
    return spark.createDataFrame(
        [(r, s, state, p, at) for r, s, state, p, at in rows], "run_id long, sequence long, state string, progress double, at double"
    ).select("run_id", "sequence", "state", "progress", F.timestamp_seconds("at").alias("ts"))


@pytest.mark.parametrize(
    "path,legal",
    [
        (["CREATED", "VALIDATING", "ACQUIRING_TERRAIN"], [True, True, True]),
        (["CREATED", "ACQUIRING_TERRAIN"], [True, False]),
        (["CREATED", "FAILED", "VALIDATING"], [True, True, False]),
        (["CREATED", "CANCELLING", "CANCELLED"], [True, True, True]),
        (["CREATED", "CANCELLING", "FAILED"], [True, True, False]),
        (["VALIDATING"], [False]),
    ],
)
def test_transitions(spark, path, legal):
    rows = events(spark, *[(1, i, s, 0.0, float(i)) for i, s in enumerate(path)])
    assert [r["legal"] for r in monitor.transitions(rows, 2).orderBy("sequence").collect()] == legal


def test_every_step_of_the_sequence_is_legal(spark):
    from tarnfield import config

    rows = events(spark, *[(1, i, s, 0.0, float(i)) for i, s in enumerate(config.RUN_SEQUENCE)])
    assert monitor.transitions(rows, 3).filter("legal").count() == len(config.RUN_SEQUENCE)


def test_status_eta_silence_and_interruption(spark):
    rows = events(
        spark,
        (1, 0, "CREATED", None, 0.0), (1, 1, "RUNNING_ENGINE", 0.25, 30.0), (1, 2, "RUNNING_ENGINE", 1.7, 60.0),
        (2, 0, "CREATED", None, 0.0), (2, 1, "RUNNING_ENGINE", 0.5, 5.0),
        (3, 0, "CREATED", None, 0.0), (3, 1, "FAILED", None, 1.0), (3, 2, "FAILED", None, 99.0),
    )
    status = monitor.with_eta(monitor.latest_status(rows))
    got = {r["run_id"]: r for r in status.collect()}
    assert got[1]["progress"] == 1.0 and got[1]["eta_s"] == 0
    assert got[2]["eta_s"] == 5.0
    assert [(r["run_id"], r["silent_s"]) for r in monitor.silences(rows, 10.0).orderBy("sequence").collect()] == [(1, 30.0), (1, 30.0)]
    lost = monitor.interrupted(status, F.timestamp_seconds(F.lit(100)), 50)
    assert [(r["run_id"], r["reason"]) for r in lost.collect()] == [(2, "RUN_INTERRUPTED")]
    assert sorted((r["run_id"], r["sequence"]) for r in monitor.feed(rows, 0).collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_log_lines(spark):
    lines = ["  45.5% complete,   12.3 s remaining ...", "150% complete, Inf s remaining", "5% complete, - s remaining", "hello"]
    got = monitor.parse_progress(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["fraction"], r["remaining_s"]) for r in got] == [(0.455, 12.3), (1.0, None), (0.05, None)]
    log = " Time in Momentum : 1.25 ( 50.0%)\n Time in Boundary input: 2e-1 (8%)\n Average time step (s) : 0.375"
    rows = monitor.parse_timings(spark.createDataFrame([(1, log)], "run int, log string"), "run").orderBy("section").collect()
    assert [(r["section"], r["seconds"], r["percent"], r["average_step_s"]) for r in rows] == [
        ("boundary_input", 0.2, 8.0, 0.375), ("momentum", 1.25, 50.0, 0.375)]


def feed_folder(spark, tmp_path, *batches):
    folder = str(tmp_path / "in")
    for b in batches:
        events(spark, *b).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_resumes_after_its_cursor_and_counts_once(spark, tmp_path):
    folder = feed_folder(spark, tmp_path, [(1, i, "CREATED", 0.1, float(i)) for i in range(5)])
    state = str(tmp_path / "state")
    stream = monitor.read_event_stream(spark, folder)
    assert monitor.drain(stream.select("run_id", "sequence"), "append", "x", folder=state).count() == 5
    feed_folder(spark, tmp_path, [(1, i, "VALIDATING", 0.2, float(i)) for i in range(5, 8)])
    again = monitor.drain(monitor.read_event_stream(spark, folder).select("run_id", "sequence"), "append", "x", folder=state)
    assert sorted(r["sequence"] for r in again.collect()) == list(range(8))
    assert again.select("batch_id").distinct().count() == 2


def test_streamed_status_equals_batch_status(spark, tmp_path):
    batches = [[(r, s, "RUNNING_ENGINE", 0.1 * s, float(s)) for r in range(4) for s in range(lo, lo + 3)] for lo in (0, 3, 6)]
    folder = feed_folder(spark, tmp_path, *batches)
    state = str(tmp_path / "status")
    stream = monitor.latest_status(monitor.read_event_stream(spark, folder, max_files=1))
    streamed = monitor.upsert(stream, ["run_id"], "status", folder=state, buckets=3)
    batch = monitor.latest_status(spark.read.parquet(folder))
    keys = ["run_id", "sequence", "state", "progress"]
    assert sorted(map(tuple, streamed.select(keys).collect())) == sorted(map(tuple, batch.select(keys).collect()))


def test_upsert_table_stays_compact(spark, tmp_path):
    """However many batches there were, a bucket has two slots and the manifest two turns."""
    batches = [[(r, s, "RUNNING_ENGINE", 0.0, float(s)) for r in range(9) if (r + s) % 3] for s in range(7)]
    folder, state = feed_folder(spark, tmp_path, *batches), tmp_path / "status"
    stream = monitor.latest_status(monitor.read_event_stream(spark, folder, max_files=1))
    table = monitor.upsert(stream, ["run_id"], "status", folder=str(state), buckets=2)
    want = {r["run_id"]: r["sequence"] for r in monitor.latest_status(spark.read.parquet(folder)).collect()}
    assert {r["run_id"]: r["sequence"] for r in table.collect()} == want and table.count() == 9
    assert len(list(state.glob("rows/slot=*/bucket=*"))) <= 4 and len(list(state.glob("manifest/turn=*"))) == 2
    # more events go on from the checkpoint
    feed_folder(spark, tmp_path, [(3, 50, "COMPLETE", 1.0, 50.0)])
    stream = monitor.latest_status(monitor.read_event_stream(spark, folder))
    table = monitor.upsert(stream, ["run_id"], "status", folder=str(state), buckets=2)
    assert {r["run_id"]: r["sequence"] for r in table.collect()} == want | {3: 50}
    # a batch that is replayed starts from the manifest of the one before it
    assert monitor._places(spark, str(state), before=7) != {} and monitor._places(spark, str(state), before=0) == {}


def test_event_time_silences_with_late_rows(spark, tmp_path):
    """Three batches; rows of the second come late but within the delay, one of the third comes too late."""
    day = 86_400.0
    batches = [
        [(1, 0, "CREATED", 0.0, 0.0), (1, 2, "VALIDATING", 0.0, 3 * day), (2, 0, "CREATED", 0.0, 0.0)],
        [(1, 1, "CREATED", 0.0, 1.5 * day), (2, 1, "COMPLETE", 1.0, 2 * day), (1, 3, "VALIDATING", 0.0, 3.2 * day)],
        [(2, 2, "CREATED", 0.0, 9 * day), (1, 4, "FAILED", 0.0, 8 * day), (3, 0, "CREATED", 0.0, 20 * day)],
    ]
    batches = [[(r, s, state, p, at + 10 * day) for r, s, state, p, at in b] for b in batches]  # the watermark starts at 0
    folder = feed_folder(spark, tmp_path, *batches)
    stream = monitor.read_event_stream(spark, folder, max_files=1)
    got = monitor.silences_by_event_time(stream, day, int(2 * day), folder=str(tmp_path / "s"))
    batch = monitor.silences(spark.read.parquet(folder).filter("run_id < 3"), day)
    key = lambda df: sorted((r["run_id"], r["sequence"], r["silent_s"]) for r in df.collect())
    assert key(got) == key(batch) and len(key(got)) == 4


def test_state_machine_keeps_state_across_batches(spark, tmp_path):
    steps = ["CREATED", "VALIDATING", "ACQUIRING_TERRAIN", "COMPLETE"]
    folder = feed_folder(spark, tmp_path, *[[(r, i, s, 0.0, float(i)) for r in (1, 2)] for i, s in enumerate(steps)])
    table = monitor.check_transitions_stream(monitor.read_event_stream(spark, folder, max_files=1))
    got = [r["legal"] for r in table.filter("run_id = 1").orderBy("sequence").collect()]
    assert got == [True, True, True, False]


def test_feed_stops_at_the_first_end_across_batches(spark, tmp_path):
    folder = feed_folder(
        spark,
        tmp_path,
        [(1, 0, "CREATED", 0.0, 0.0), (2, 0, "CREATED", 0.0, 0.0)],
        [(1, 1, "FAILED", 0.0, 1.0), (2, 1, "VALIDATING", 0.1, 1.0)],
        [(1, 2, "CREATED", 0.0, 2.0), (2, 2, "COMPLETE", 1.0, 2.0), (2, 3, "CREATED", 0.0, 3.0)],
    )
    rows = monitor.feed_stream(monitor.read_event_stream(spark, folder, max_files=1), cursor=-1).collect()
    assert sorted((r["run_id"], r["sequence"]) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert len({r["batch_id"] for r in rows}) == 3


def test_silence_alarm_fires_once_per_open_run(spark, tmp_path):
    import time

    folder = feed_folder(spark, tmp_path, [(1, 0, "CREATED", 0.0, 0.0), (2, 0, "COMPLETE", 1.0, 0.0)])
    for key, value in monitor.ROCKSDB.items():
        spark.conf.set(key, value)
    out = str(tmp_path / "out")
    alarms = monitor.silence_stream(monitor.read_event_stream(spark, folder), limit_s=1.0)
    running = (
        alarms.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    )
    try:
        found, end = [], time.time() + 60
        while not found and time.time() < end:
            time.sleep(1)
            try:
                found = spark.read.parquet(out).collect()
            except Exception:
                continue
    finally:
        running.stop()
        for key in monitor.ROCKSDB:
            spark.conf.unset(key)
    assert [r["run_id"] for r in found] == [1]
