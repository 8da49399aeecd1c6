"""Run monitoring: batch operators on event tables and their streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from tarnfield import config
from tarnfield.operators.ordered import next_in_key, previous_in_key
from tarnfield.runtime import cut_lineage, scratch_path

# Fixed formats of the engine's log lines.
PROGRESS_PATTERN = r"(\d+(?:\.\d+)?)%\s+complete,\s+([-+]?\d+(?:\.\d+)?|Inf|inf|-)\s+s\s+remaining"
TIMING_PATTERN = r"Time in ([^:]+):\s*([-+0-9.eE]+)\s*\(\s*([-+0-9.eE]+)%\)"
AVERAGE_STEP_PATTERN = r"Average time step \(s\)\s*:\s*([-+0-9.eE]+)"
# Sequence numbers per window part; a long run is cut into many parts.
CHUNK = 65_536


def allowed_next() -> dict[str, list[str]]:
    """Legal successors of each state.

    The normal sequence step by step; FAILED from every open state but CANCELLING; CANCELLING
    from every open step of the sequence; CANCELLED only after CANCELLING; terminals are final.
    """
    steps = config.RUN_SEQUENCE
    table = {s: [n, "FAILED", "CANCELLING"] for s, n in zip(steps, steps[1:])}
    table["CANCELLING"] = ["CANCELLED"]
    table.update({t: [] for t in config.TERMINAL_STATES})
    return table


def _is_legal(previous: Column, state: Column) -> Column:
    """First state CREATED, later ones by the table."""
    legal = F.lit(False)
    for source, targets in allowed_next().items():
        if targets:
            legal = legal | ((previous == source) & state.isin(*targets))
    return F.when(previous.isNull(), state == "CREATED").otherwise(legal)


def terminal(state: Column) -> Column:
    return state.isin(*config.TERMINAL_STATES)


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    return events.filter(F.col("sequence") > cursor)


def feed(events: DataFrame, cursor: int = 0) -> DataFrame:
    """Events after the cursor up to and including each run's first terminal state."""
    ends = events.filter(terminal(F.col("state"))).groupBy("run_id").agg(F.min("sequence").alias("_end"))
    joined = events_after(events, cursor).join(ends, "run_id", "left")
    return joined.filter(F.col("_end").isNull() | (F.col("sequence") <= F.col("_end"))).drop("_end")


def _by_chunk(size: int) -> Column:
    return F.floor(F.col("sequence") / size)


def transitions(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every event with its predecessor's state and whether the step is legal."""
    seen = previous_in_key(events, ["run_id"], "sequence", ["state"], _by_chunk(chunk))
    return seen.withColumn("legal", _is_legal(F.col("prev_state"), F.col("state")))


def latest_status(events: DataFrame) -> DataFrame:
    """Latest state per run, its progress within 0..1 and time; works on streams (update mode)."""
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress")))
    newest = F.max(F.struct("sequence", "state", progress.alias("progress"), "ts"))
    return events.groupBy("run_id").agg(newest.alias("n"), F.min("ts").alias("started")).select(
        "run_id", "started", "n.sequence", "n.state", "n.progress", F.col("n.ts").alias("ts")
    )


def micros(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp"))


def with_eta(status: DataFrame) -> DataFrame:
    """Remaining seconds by the progress made so far; unknown without progress."""
    elapsed = (micros(F.col("ts")) - micros(F.col("started"))) / 1e6
    return status.withColumns(
        {"elapsed_s": elapsed, "eta_s": F.when(F.col("progress") > 0, elapsed / F.col("progress") - elapsed)}
    )


def silences(events: DataFrame, limit_s: float = 10.0, chunk: int = CHUNK) -> DataFrame:
    """Waits of at least the limit before a run's next event, outside terminal states."""
    stamped = events.withColumn("at", micros(F.col("ts")))
    ahead = next_in_key(stamped, ["run_id"], "sequence", ["at"], _by_chunk(chunk))
    gap = (F.col("next_at") - F.col("at")) / 1e6
    return ahead.filter(~terminal(F.col("state"))).withColumn("silent_s", gap).filter(gap >= limit_s)


def stage_durations(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Seconds until the next event of a run, and since its first one up to that next event."""
    stamped = events.withColumn("at", micros(F.col("ts")))
    ahead = next_in_key(stamped, ["run_id"], "sequence", ["at"], _by_chunk(chunk))
    first = stamped.groupBy("run_id").agg(F.min("at").alias("_first"))
    return ahead.join(first, "run_id").withColumns(
        {
            "duration_s": (F.col("next_at") - F.col("at")) / 1e6,
            "total_s": (F.col("next_at") - F.col("_first")) / 1e6,
        }
    ).drop("_first")


def combined_progress(events: DataFrame) -> DataFrame:
    """Mean of the latest fractions of a run's parallel providers."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress")))
    latest = events.groupBy("run_id", "provider").agg(F.max(F.struct("sequence", share.alias("p"))).alias("n"))
    return latest.groupBy("run_id").agg(F.avg("n.p").alias("progress"))


def interrupted(status: DataFrame, now: Column, stale_s: float) -> DataFrame:
    """Runs left in an open state with a stale last sign of life, as they would be closed."""
    silent = (micros(now) - micros(F.col("ts"))) / 1e6
    return status.filter(~terminal(F.col("state")) & (silent > stale_s)).select(
        "run_id",
        F.col("state").alias("last_state"),
        F.lit("FAILED").alias("state"),
        F.lit("RUN_INTERRUPTED").alias("reason"),
    )


# --- log lines --------------------------------------------------------------------------------

def parse_progress(lines: DataFrame, text: str = "line") -> DataFrame:
    """Progress lines to a fraction in 0..1 and remaining seconds; other lines drop out."""
    share = F.regexp_extract(text, PROGRESS_PATTERN, 1).try_cast("double") / 100
    left = F.regexp_extract(text, PROGRESS_PATTERN, 2).try_cast("double")
    return lines.filter(F.col(text).rlike(PROGRESS_PATTERN)).withColumns(
        {
            "fraction": F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)),
            "remaining_s": F.when((left >= 0) & (left < float("inf")), left),
        }
    )


def parse_timings(logs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """Timing lines of a log to (section, seconds, percent), with the log's mean time step."""
    found = F.regexp_extract_all(text, F.lit(TIMING_PATTERN), F.lit(0))
    lines = logs.select(
        key,
        F.regexp_extract(text, AVERAGE_STEP_PATTERN, 1).try_cast("double").alias("average_step_s"),
        F.explode(found).alias("l"),
    )
    name = F.regexp_replace(F.lower(F.trim(F.regexp_extract("l", TIMING_PATTERN, 1))), " ", "_")
    return lines.select(
        key,
        "average_step_s",
        name.alias("section"),
        F.regexp_extract("l", TIMING_PATTERN, 2).try_cast("double").alias("seconds"),
        F.regexp_extract("l", TIMING_PATTERN, 3).try_cast("double").alias("percent"),
    )


# --- streams ----------------------------------------------------------------------------------

def _run_to_end(writer: DataStreamWriter, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is available and give its output table with ``batch_id``.

    Each micro-batch overwrites its own folder, so a batch replayed after a failure counts
    once. The checkpoint is the resume cursor: the same ``folder`` continues where it ended.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    _run_to_end(stream.writeStream.outputMode(mode).foreachBatch(keep), folder)
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


BUCKETS = 16


def _places(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """Bucket to the slot that holds it, by the newest manifest (of a batch before ``before``)."""
    rows = []
    for turn in (0, 1):  # one row per bucket each
        try:
            rows += spark.read.schema("batch_id LONG, bucket INT, slot INT").parquet(f"{folder}/manifest/turn={turn}").collect()
        except AnalysisException:
            continue
    rows = [r for r in rows if before is None or r["batch_id"] < before]
    newest = max((r["batch_id"] for r in rows), default=None)
    return {r["bucket"]: r["slot"] for r in rows if r["batch_id"] == newest}


def _slots(spark: SparkSession, folder: str, places: dict[int, int], schema) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/rows/slot={s}/bucket={b}" for b, s in sorted(places.items())])


def upsert(stream: DataFrame, keys: list[str], name: str, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Run an update-mode stream over what is available and give the latest row per key.

    The table is kept in buckets of keys with two slots each. A micro-batch merges its rows into the buckets it
    touches, writes them to the slot that is not in use, and then swaps slots by a small manifest, itself in
    two turns. So the table never holds more than two copies of a row however many batches there were, and a
    batch that is replayed starts from the manifest of the one before it.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    schema = stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        places = _places(spark, folder, batch_id)
        key = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = cut_lineage(batch.withColumn("bucket", key))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            held = _slots(spark, folder, {b: s for b, s in places.items() if b in touched}, schema)
            old = held.withColumn("bucket", key).join(fresh.select(*keys), keys, "left_anti")
            turned = {b: 1 - places.get(b, 1) for b in touched}
            slot = F.element_at(F.create_map(*[F.lit(x) for pair in turned.items() for x in pair]), F.col("bucket"))
            writer = old.unionByName(fresh).withColumn("slot", slot).repartition("bucket").write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").parquet(f"{folder}/rows")
            places |= turned
        rows = [(batch_id, b, s) for b, s in sorted(places.items())]
        told = spark.createDataFrame(rows, "batch_id LONG, bucket INT, slot INT").coalesce(1)
        told.write.mode("overwrite").parquet(f"{folder}/manifest/turn={batch_id % 2}")

    _run_to_end(stream.writeStream.outputMode("update").foreachBatch(merge), folder)
    return _slots(spark, folder, _places(spark, folder), schema)


def running_peaks(frames: DataFrame) -> DataFrame:
    """Running maximum, its first time and peak speed per cell as frames arrive."""
    from tarnfield.operators.summary import peak_wet_speed

    return frames.groupBy("row", "col").agg(
        F.max(F.struct("h", (-F.col("t")).alias("nt"))).alias("top"), peak_wet_speed().alias("peak_speed")
    ).select("row", "col", F.col("top.h").alias("max_depth"), (-F.col("top.nt")).alias("max_time"), "peak_speed")


SILENCE_OUTPUT = "run_id long, silent_since long"


class SilenceAlarm(StatefulProcessor):
    """Raises one row when a run in an open state shows no activity for the limit.

    Every batch of events replaces the run's timer; a terminal state clears it.
    """

    def __init__(self, limit_ms: int = 10_000):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, state, newest = timerValues.getCurrentProcessingTimeInMs(), None, -1
        for batch in rows:
            last = batch.loc[batch["sequence"].idxmax()]
            if last["sequence"] > newest:
                newest, state = last["sequence"], last["state"]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        is_open = state not in config.TERMINAL_STATES
        self.seen.update((now, is_open))
        if is_open:
            self.handle.registerTimer(now + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, is_open = self.seen.get()
        if is_open:
            yield pd.DataFrame({"run_id": [key[0]], "silent_since": [at]})

    def close(self) -> None:
        pass


class SilenceByEventTime(StatefulProcessor):
    """Waits of at least the limit before a run's next event, decided once the watermark has passed that event.

    Events wait in state until then, so late ones within the watermark's delay find their place. A timer stands
    at the earliest waiting event.
    """

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "sequence long, state string, at long")
        self.last = handle.getValueState("last", "sequence long, at long, open boolean")

    def _wake(self, rows: list[tuple]) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if rows:
            self.handle.registerTimer(min(r[2] for r in rows) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in zip(batch["sequence"].tolist(), batch["state"].tolist(), batch["at"].tolist()):
                self.waiting.appendValue(row)
        self._wake(list(self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        last, found = self.last.get() if self.last.exists() else None, []
        for sequence, state, at in sorted(r for r in rows if r[2] <= passed):
            if last is not None and last[2] and at - last[1] >= self.limit_us:
                found.append((key[0], last[0], (at - last[1]) / 1e6))
            last = (sequence, at, state not in config.TERMINAL_STATES)
        rest = [r for r in rows if r[2] > passed]
        if last is not None:
            self.last.update(tuple(last))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        self._wake(rest)
        if found:
            yield pd.DataFrame(found, columns=["run_id", "sequence", "silent_s"])

    def close(self) -> None:
        pass


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _earlier(spark: SparkSession, folder: str, schema: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """What earlier micro-batches kept of the runs in this one; a replayed batch does not see itself or later ones."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    kept = spark.read.schema(f"{schema}, batch_id LONG").option("basePath", folder).parquet(folder)
    kept = kept.filter(F.col("batch_id") < batch_id).drop("batch_id")
    return kept.join(batch.select("run_id").distinct(), "run_id", "left_semi")


def feed_stream(events: DataFrame, cursor: int = 0, folder: str | None = None) -> DataFrame:
    """Streaming twin of ``feed``: a run stops at its first terminal state, also over micro-batches.

    A micro-batch keeps the ends that it saw, and only those; later ones read the ends of the runs they touch.
    """
    spark = events.sparkSession
    folder = folder or scratch_path(spark, "feed")

    def step(batch: DataFrame, batch_id: int) -> None:
        ended = batch.filter(terminal(F.col("state"))).groupBy("run_id").agg(F.min("sequence").alias("end"))
        ended.write.mode("overwrite").parquet(f"{folder}/ends/batch_id={batch_id}")
        known = _earlier(spark, f"{folder}/ends", "run_id LONG, end LONG", batch, batch_id).unionByName(ended)
        ends = known.groupBy("run_id").agg(F.min("end").alias("end"))
        open_ = events_after(batch, cursor).join(ends, "run_id", "left")
        open_.filter("end IS NULL OR sequence <= end").drop("end").write.mode("overwrite").parquet(
            f"{folder}/out/batch_id={batch_id}"
        )

    _run_to_end(events.select("run_id", "sequence", "state").writeStream.foreachBatch(step), folder)
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def check_transitions_stream(events: DataFrame, chunk: int = CHUNK, folder: str | None = None) -> DataFrame:
    """Streaming twin of ``transitions``.

    A micro-batch is checked by the batch operator together with the last event so far of the runs it touches,
    so a run of any length is cut into chunks here too. It keeps the last events of those runs only; replaying a
    batch reads what the batches before it kept and rewrites the same rows.
    """
    spark = events.sparkSession
    folder = folder or scratch_path(spark, "transitions")
    names = ["run_id", "sequence", "state"]

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*names).withColumn("_old", F.lit(False))
        kept = _earlier(spark, f"{folder}/last", "run_id LONG, sequence LONG, state STRING", batch, batch_id)
        held = kept.groupBy("run_id").agg(F.max(F.struct("sequence", "state")).alias("l")).select("run_id", "l.*")
        rows = fresh.unionByName(held.withColumn("_old", F.lit(True)))
        checked = transitions(rows, chunk).filter(~F.col("_old")).drop("_old")
        checked.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")
        last = rows.groupBy("run_id").agg(F.max(F.struct("sequence", "state")).alias("l")).select("run_id", "l.*")
        last.write.mode("overwrite").parquet(f"{folder}/last/batch_id={batch_id}")

    _run_to_end(events.select(*names).writeStream.foreachBatch(step), folder)
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def silence_stream(events: DataFrame, limit_s: float = 10.0) -> DataFrame:
    """Streaming twin of ``silences`` on processing time (set ``ROCKSDB``); the caller stops the query."""
    return events.select("run_id", "sequence", "state").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=SilenceAlarm(int(limit_s * 1000)),
        outputStructType=SILENCE_OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def silences_by_event_time(events: DataFrame, limit_s: float, delay_s: int, folder: str | None = None) -> DataFrame:
    """Streaming twin of ``silences`` on event time, run over what is available: ``run_id``, ``sequence``, ``silent_s``.

    An event counts once the watermark, the latest time seen less ``delay_s``, has passed it; events that come
    later than that are dropped. Needs a state store with column families, which is set for the run.
    """
    spark = events.sparkSession
    folder = folder or scratch_path(spark, "silences")
    at = F.col("ts").cast("timestamp")
    timed = events.select("run_id", "sequence", "state", at.alias("ts"), F.unix_micros(at).alias("at"))
    found = timed.withWatermark("ts", f"{delay_s} seconds").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=SilenceByEventTime(int(limit_s * 1_000_000)),
        outputStructType="run_id long, sequence long, silent_s double",
        outputMode="Append",
        timeMode="EventTime",
    )
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for key, value in ROCKSDB.items():
        spark.conf.set(key, value)
    try:
        return drain(found, "append", "silences", folder).drop("batch_id")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder or glob of event Parquet as a stream with the schema it has on disk."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
