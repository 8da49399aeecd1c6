"""Run monitoring, log lines and rule checks; streams next to their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfield.operators import blocks, validate
from tarnfield.plans import adapters as A
from tarnfield.plans.cube_queries import r6
from tarnfield.plans.registry import query
from tarnfield.streaming import monitor

# Small enough to cut the test runs into several chunks.
CHUNK = 2000

LEGAL = """CASE WHEN prev_state IS NULL THEN state = 'CREATED' WHEN prev_state = 'CREATED' THEN state IN ('VALIDATING', 'FAILED', 'CANCELLING')
   WHEN prev_state = 'VALIDATING' THEN state IN ('ACQUIRING_TERRAIN', 'FAILED', 'CANCELLING')
   WHEN prev_state = 'ACQUIRING_TERRAIN' THEN state IN ('ACQUIRING_VECTORS', 'FAILED', 'CANCELLING') ELSE false END"""
STEPS = """, steps AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY sequence) AS prev_state,
   lead(ts) OVER (PARTITION BY run_id ORDER BY sequence) AS next_ts, min(ts) OVER (PARTITION BY run_id) AS first_ts FROM run_events) """
OPEN = "state NOT IN ('COMPLETE', 'FAILED', 'CANCELLED')"


def stream_of_events(spark, folder):
    return A.shape_run_events(monitor.read_event_stream(spark, f"{folder}/[e]vents.parquet"))


FEED = """, ends AS (SELECT run_id, min(sequence) AS e FROM run_events WHERE state IN ('COMPLETE', 'FAILED', 'CANCELLED') GROUP BY 1)
   SELECT r.run_id, r.sequence, r.state FROM run_events r LEFT JOIN ends USING (run_id) WHERE r.sequence > 100 AND (e IS NULL OR r.sequence <= e)"""


@query("r1_event_feed", "run_events", FEED)
def r1(spark, folder):
    return monitor.feed(A.run_events(spark, folder), 100).select("run_id", "sequence", "state")


@query(
    "r1_event_feed_stream",
    "run_events",
    FEED,
)
def r1_stream(spark, folder):
    return monitor.feed_stream(stream_of_events(spark, folder), 100).drop("batch_id")


@query("t8_events_after_cursor", "run_events", "SELECT run_id, sequence FROM run_events WHERE sequence > 5000")
def t8(spark, folder):
    return monitor.events_after(A.run_events(spark, folder), 5000).select("run_id", "sequence")


@query(
    "r2_state_transitions",
    "run_events",
    STEPS + f"SELECT run_id, sequence, state, prev_state, {LEGAL} AS legal FROM steps",
)
def r2(spark, folder):
    checked = monitor.transitions(A.run_events(spark, folder), CHUNK)
    return checked.select("run_id", "sequence", "state", "prev_state", "legal")


@query(
    "r2_state_transitions_stream",
    "run_events",
    STEPS + f"SELECT run_id, sequence, state, prev_state, {LEGAL} AS legal FROM steps",
)
def r2_stream(spark, folder):
    checked = monitor.check_transitions_stream(stream_of_events(spark, folder), CHUNK)
    return checked.select("run_id", "sequence", "state", "prev_state", "legal")


LATEST = """, latest AS (SELECT run_id, min(ts) AS started, max(sequence) AS sequence, arg_max(state, sequence) AS state,
    greatest(0, least(1, arg_max(progress, sequence))) AS progress, arg_max(ts, sequence) AS ts FROM run_events GROUP BY 1) """


@query("r3_latest_status", "run_events", LATEST + "SELECT run_id, sequence, state, round(progress, 6) + 0.0 AS progress FROM latest")
def r3(spark, folder):
    status = monitor.latest_status(A.run_events(spark, folder))
    return status.select("run_id", "sequence", "state", r6(F.col("progress"), "progress"))


@query("r3_latest_status_stream", "run_events", LATEST + "SELECT run_id, sequence, state, round(progress, 6) + 0.0 AS progress FROM latest")
def r3_stream(spark, folder):
    table = monitor.upsert(monitor.latest_status(stream_of_events(spark, folder)), ["run_id"], "status")
    return table.select("run_id", "sequence", "state", r6(F.col("progress"), "progress"))


@query(
    "r4_eta",
    "run_events",
    LATEST
    + """SELECT run_id, round((epoch_us(ts) - epoch_us(started)) / 1e6, 3) AS elapsed_s,
       CASE WHEN progress > 0 THEN round((epoch_us(ts) - epoch_us(started)) / 1e6 / progress - (epoch_us(ts) - epoch_us(started)) / 1e6, 3) END AS eta_s FROM latest""",
)
def r4(spark, folder):
    status = monitor.with_eta(monitor.latest_status(A.run_events(spark, folder)))
    return status.select("run_id", F.round("elapsed_s", 3).alias("elapsed_s"), F.round("eta_s", 3).alias("eta_s"))


@query(
    "r5_silences_stream",
    "run_events",
    f""", seen AS (SELECT * FROM run_events WHERE epoch_us(ts) <= ((SELECT max(epoch_us(ts)) FROM run_events) // 1000 - 172800000) * 1000),
       steps AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY sequence) AS next_ts FROM seen)
       SELECT run_id, sequence, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS silent_s FROM steps
       WHERE {OPEN} AND epoch_us(next_ts) - epoch_us(ts) >= 86400000000""",
)
def r5_stream(spark, folder):
    """Event-time timers; what the watermark, two days behind the latest event, has passed."""
    return monitor.silences_by_event_time(stream_of_events(spark, folder), 86400, 172_800)


@query(
    "r5_silences",
    "run_events",
    STEPS
    + f"""SELECT run_id, sequence, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS silent_s FROM steps
       WHERE {OPEN} AND epoch_us(next_ts) - epoch_us(ts) >= 86400000000""",
)
def r5(spark, folder):
    quiet = monitor.silences(A.run_events(spark, folder), 86400, CHUNK)
    return quiet.select("run_id", "sequence", "silent_s")


@query(
    "r6_stage_durations",
    "run_events",
    STEPS
    + """SELECT state, count(next_ts) AS n, round(sum((epoch_us(next_ts) - epoch_us(ts)) / 1e6), 2) AS seconds FROM steps GROUP BY 1""",
)
def r6_stages(spark, folder):
    spans = monitor.stage_durations(A.run_events(spark, folder), CHUNK)
    return spans.groupBy("state").agg(
        F.count("duration_s").alias("n"), F.round(F.sum("duration_s"), 2).alias("seconds")
    )


@query(
    "w8_cumulative_durations",
    "run_events",
    STEPS
    + """SELECT run_id, sequence, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS duration_s, (epoch_us(next_ts) - epoch_us(first_ts)) / 1e6 AS total_s FROM steps""",
)
def w8(spark, folder):
    spans = monitor.stage_durations(A.run_events(spark, folder), CHUNK)
    return spans.select("run_id", "sequence", "duration_s", "total_s")


@query(
    "r7_combined_progress",
    "run_events",
    """, l AS (SELECT run_id, sequence % 2 AS provider, greatest(0, least(1, arg_max(progress, sequence))) AS p FROM run_events GROUP BY 1, 2)
       SELECT run_id, round(avg(p), 6) + 0.0 AS progress FROM l GROUP BY 1""",
)
def r7(spark, folder):
    events = A.run_events(spark, folder).withColumn("provider", F.col("sequence") % 2)
    return monitor.combined_progress(events).select("run_id", r6(F.col("progress"), "progress"))


PEAKS = """, f AS (SELECT CAST(user_id // 15 AS INT) AS "row", CAST(user_id % 15 AS INT) AS col, event_id AS t, value / 100 AS h,
     ((event_id * 37) % 200 - 100) / 100.0::DOUBLE AS u, ((event_id * 53) % 200 - 100) / 100.0::DOUBLE AS v FROM events)
  SELECT "row", col, round(max(h), 6) AS max_depth, arg_max(t, row(h, -t)) AS max_time,
    round(max(CASE WHEN h > 0.01 THEN sqrt(u*u+v*v) END), 6) AS peak_speed FROM f GROUP BY 1, 2"""


def arriving_frames(events):
    key, e = F.col("user_id"), F.col("event_id")
    return events.select(
        A.int_div(key, 15).cast("int").alias("row"),
        (key % 15).cast("int").alias("col"),
        e.alias("t"),
        (F.col("value") / 100).alias("h"),
        ((e * 37 % 200 - 100) / F.lit(100.0)).alias("u"),
        ((e * 53 % 200 - 100) / F.lit(100.0)).alias("v"),
    )


@query("r8_running_peaks_stream", "", PEAKS.replace(", f AS", "WITH f AS", 1))
def r8(spark, folder):
    events = monitor.read_event_stream(spark, f"{folder}/[e]vents.parquet")
    peaks = monitor.upsert(monitor.running_peaks(arriving_frames(events)), ["row", "col"], "peaks")
    return peaks.withColumns({"max_depth": F.round("max_depth", 6), "peak_speed": F.round("peak_speed", 6)})


@query(
    "r9_interrupted_runs",
    "run_events",
    LATEST
    + f"""SELECT run_id, state AS last_state, 'FAILED' AS state, 'RUN_INTERRUPTED' AS reason FROM latest
       WHERE {OPEN} AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) > 3600000000""",
)
def r9(spark, folder):
    status = monitor.latest_status(A.run_events(spark, folder))
    return monitor.interrupted(status, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 3600)


@query(
    "s15_progress_lines",
    "",
    """SELECT event_id, least(1.0, (event_id % 1300) / 10.0::DOUBLE / 100) AS fraction, CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 THEN NULL ELSE value END AS remaining_s
       FROM events WHERE event_id % 5 <> 0""",
)
def s15(spark, folder):
    key = F.col("event_id")
    left = F.when(key % 7 == 0, "Inf").when(key % 7 == 1, "-").otherwise(F.col("value").cast("string"))
    line = F.when(key % 5 == 0, F.lit("reading input")).otherwise(
        F.concat(F.format_string("%.1f", key % 1300 / 10.0), F.lit("% complete,  "), left, F.lit(" s remaining ..."))
    )
    lines = A.table(spark, folder, "events").select("event_id", line.alias("line"))
    return monitor.parse_progress(lines).select("event_id", "fraction", "remaining_s")


@query(
    "s16_engine_timings",
    "",
    """SELECT o_orderkey AS run, o_orderkey % 50 / 10.0::DOUBLE AS average_step_s, section, CASE section WHEN 'momentum_flux' THEN o_totalprice ELSE 1.5 END AS seconds,
       CASE section WHEN 'momentum_flux' THEN 80.5 ELSE 2.0 END::DOUBLE AS percent FROM orders, (VALUES ('momentum_flux'), ('input')) s(section)""",
)
def s16(spark, folder):
    log = F.concat(
        F.lit(" Time in Momentum flux :  "), F.format_string("%.2f", "o_totalprice"), F.lit(" ( 80.5%)\n Time in input: 1.5 (2.0%)\n"),
        F.lit(" Average time step (s) : "), F.format_string("%.1f", F.col("o_orderkey") % 50 / 10.0),
    )
    logs = A.table(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), log.alias("log"))
    return monitor.parse_timings(logs, "run")


# --- rule checks ------------------------------------------------------------------------------

@query(
    "v1_event_rules",
    "rain_events",
    """, e AS (SELECT event_id AS k, CAST(event_id - CASE WHEN event_id % 977 = 5 THEN 1 ELSE 0 END AS VARCHAR) AS event_id, CASE WHEN event_id % 31 = 0 THEN -duration_minutes ELSE duration_minutes END AS d,
           CASE WHEN event_id % 37 = 0 THEN 0 ELSE total_mm END AS tot, event_id % 14 AS rank, event_id % 400 - 200 AS lon FROM rain_events)
       SELECT event_id, 'duration' AS rule FROM e WHERE d <= 0 UNION ALL SELECT event_id, 'total' FROM e WHERE tot <= 0
       UNION ALL SELECT event_id, 'rank' FROM e WHERE rank NOT BETWEEN 1 AND 10 UNION ALL SELECT event_id, 'longitude' FROM e WHERE abs(lon) > 180
       UNION ALL SELECT event_id, 'duplicate' FROM e GROUP BY 1 HAVING count(*) > 1""",
)
def v1(spark, folder):
    key = F.col("event_id")
    events = A.rain_events(spark, folder).select(
        (key - F.when(key % 977 == 5, 1).otherwise(0)).cast("string").alias("event_id"),
        "station_id",
        (key % 400 - 200).cast("double").alias("station_lon_deg"),
        F.lit(35.0).alias("station_lat_deg"),
        F.when(key % 31 == 0, -F.col("duration_minutes")).otherwise(F.col("duration_minutes")).alias("duration_minutes"),
        F.when(key % 37 == 0, 0.0).otherwise(F.col("total_mm")).alias("total_precipitation_mm"),
        (key % 14).cast("int").alias("rank"),
        F.lit(False).alias("profile_available"),
        F.lit(None).cast("string").alias("profile_id"),
    )
    return validate.event_violations(events)


@query(
    "v2_area_rules",
    "points",
    """, a AS (SELECT point_id AS area_id, CASE WHEN point_id % 2 = 0 THEN 'preset_square' ELSE 'rectangle' END AS mode, lon - 1 AS west, lon + CASE WHEN point_id % 11 = 0 THEN -2 ELSE 1 END AS east,
         lat - 1 AS south, lat + 1 AS north, lon + CASE WHEN point_id % 13 = 0 THEN 3 ELSE 0 END AS lon, lat, 500.0 + 250 * (point_id % 7) AS w, 500.0 + 250 * (point_id % 7) + CASE WHEN point_id % 17 = 0 THEN 1 ELSE 0 END AS h,
         CASE WHEN point_id % 19 = 0 THEN 1.0 ELSE 0.0 END AS extra FROM points)
       SELECT area_id, 'order' AS rule FROM a WHERE west >= east UNION ALL SELECT area_id, 'centre' FROM a WHERE lon NOT BETWEEN west AND east
       UNION ALL SELECT area_id, 'area' FROM a WHERE extra > 0 UNION ALL SELECT area_id, 'preset_shape' FROM a WHERE mode = 'preset_square' AND w <> h
       UNION ALL SELECT area_id, 'preset_size' FROM a WHERE mode = 'preset_square' AND w / 2 NOT IN (250, 500, 1000, 2000, 4000)""",
)
def v2(spark, folder):
    key, lon, lat = F.col("point_id"), F.col("lon"), F.col("lat")
    width = 500.0 + 250 * (key % 7)
    height = width + F.when(key % 17 == 0, 1).otherwise(0)
    areas = A.points(spark, folder).select(
        key.alias("area_id"),
        F.when(key % 2 == 0, "preset_square").otherwise("rectangle").alias("mode"),
        (lon - 1).alias("west"),
        (lon + F.when(key % 11 == 0, -2).otherwise(1)).alias("east"),
        (lat - 1).alias("south"),
        (lat + 1).alias("north"),
        (lon + F.when(key % 13 == 0, 3).otherwise(0)).alias("lon"),
        lat.alias("lat"),
        width.alias("width_m"),
        height.alias("height_m"),
        (width * height + F.when(key % 19 == 0, 1.0).otherwise(0.0)).alias("area_m2"),
    )
    return validate.area_violations(areas)


@query(
    "v3_series_rules",
    "",
    """WITH s AS (SELECT l_orderkey AS series, l_linenumber AS seq, l_quantity AS elapsed FROM lineitem),
       d AS (SELECT series, seq, max(elapsed) AS elapsed FROM s GROUP BY 1, 2),
       l AS (SELECT *, lag(elapsed) OVER (PARTITION BY series ORDER BY seq) AS prev_elapsed FROM d)
       SELECT series, seq, elapsed, prev_elapsed FROM l WHERE elapsed <= prev_elapsed""",
)
def v3(spark, folder):
    from tarnfield.operators import timeline

    samples = A.table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("seq")
    ).agg(F.max("l_quantity").alias("elapsed"))
    return timeline.not_increasing(samples, "series", "seq", "elapsed")


@query(
    "v4_cube_rules",
    "raw_frames frame_cells",
    """, f AS (SELECT *, CASE WHEN "row" = 2 AND col < 3 THEN NULL ELSE u END AS u2 FROM raw_frames UNION ALL SELECT *, NULL FROM raw_frames WHERE col = 4 AND t % 9 = 0),
       k AS (SELECT t, "row", col, count(*) AS n, count_if(isnan(h)) AS bad, count_if(u2 IS NULL) AS half FROM f GROUP BY 1, 2, 3)
       SELECT t, (SELECT count(*) FROM frame_cells) - count(c.mask) AS missing, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeated,
         count(k.n) - count(c.mask) AS foreign_cells,
         CAST(coalesce(sum(CASE WHEN c.mask > 0 THEN bad END), 0) AS BIGINT) AS bad_depth, CAST(coalesce(sum(half), 0) AS BIGINT) AS half_velocity
       FROM (SELECT unnest(range(40))::INT AS t) FULL JOIN k USING (t) LEFT JOIN frame_cells c ON c."row" = k."row" AND c.col = k.col GROUP BY 1""",
)
def v4(spark, folder):
    frames = A.raw_frames(spark, folder)
    nothing = F.lit(None).cast("double")
    broken = frames.withColumn("u", F.when((F.col("row") == 2) & (F.col("col") < 3), nothing).otherwise(F.col("u")))
    again = frames.filter("col = 4 AND t % 9 = 0").withColumn("u", nothing)
    axis = spark.range(40).select(F.col("id").cast("int").alias("t"))  # longer than the run, so that frames lack all rows
    return validate.cube_violations(broken.unionByName(again), A.frame_cells(spark, folder), axis)


@query(
    "v6_policy_rules",
    "",
    """WITH p AS (SELECT p_partkey AS policy_id, list_transform(range(1 + p_size % 7), lambda i: CASE WHEN p_partkey % 5 = 0 AND i = 2 THEN 5 ELSE 1 << i END) AS levels,
         p_size * 10.0::DOUBLE AS core_m, CASE WHEN p_partkey % 9 = 0 THEN 'Infinity'::DOUBLE ELSE p_partkey % 60 * 10.0::DOUBLE END AS mid_m, 1 << (p_partkey % 4) AS mid_ceiling,
         list_transform(range(p_size % 7), lambda i: CASE WHEN p_partkey % 7 = 0 THEN -0.1::DOUBLE ELSE 0.1::DOUBLE * (i + 1) END) AS limits FROM part)
       SELECT policy_id, CASE WHEN levels[1] <> 1 OR len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] <> 2 * levels[i])) > 0 OR levels[len(levels)] > 32 THEN 'levels'
         WHEN NOT list_contains(levels, mid_ceiling) THEN 'mid_ceiling' WHEN NOT (core_m >= 0 AND core_m <= mid_m AND mid_m < 'Infinity'::DOUBLE) THEN 'radii'
         WHEN len(limits) < len(levels) - 1 OR len(list_filter(limits, lambda v: v < 0)) > 0 THEN 'limits' END AS problem FROM p""",
)
def v6(spark, folder):
    """A table of policies, one per part, each judged by its first broken rule."""
    key, size = F.col("p_partkey"), F.col("p_size") % 7
    level = lambda i: F.when((key % 5 == 0) & (i == 2), 5).otherwise(F.pow(F.lit(2), i).cast("int"))
    limit = lambda i: F.when(key % 7 == 0, -0.1).otherwise(i * 0.1)
    counted = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    policies = A.table(spark, folder, "part").select(
        key.alias("policy_id"),
        F.transform(F.sequence(F.lit(0), size), level).alias("levels"),
        (F.col("p_size") * 10.0).alias("core_m"),
        F.when(key % 9 == 0, float("inf")).otherwise(key % 60 * 10.0).alias("mid_m"),
        F.pow(F.lit(2), key % 4).cast("int").alias("mid_ceiling"),
        F.transform(counted, limit).alias("limits"),
    )
    return policies.select("policy_id", validate.policy_problem().alias("problem"))


@query(
    "v7_source_identity",
    "",
    "SELECT 'events.parquet' AS file_name, 'changed' AS change UNION ALL SELECT 'orders.parquet', 'gone' UNION ALL SELECT 'part.parquet', 'added'",
)
def v7(spark, folder):
    """Recorded: events with another size, and orders; now: events, lineitem and part."""
    now = [validate.describe_source(spark, f"{folder}/{n}.parquet") for n in ("events", "lineitem", "part")]
    then = [validate.describe_source(spark, f"{folder}/{n}.parquet") for n in ("events", "lineitem", "orders")]
    resized = then[0].withColumn("file_size", F.col("file_size") + 1)
    return validate.source_changes(
        now[0].unionByName(now[1]).unionByName(now[2]), resized.unionByName(then[1]).unionByName(then[2])
    )


@query(
    "v7_archive_consistency",
    "",
    """WITH a AS (SELECT o_orderkey AS archive_id, CASE WHEN o_orderkey % 13 = 0 THEN '9' ELSE CAST(o_orderkey % 2 + 1 AS VARCHAR) END AS version,
         o_orderkey % 7 = 0 AS moved, o_orderkey % 11 = 0 AS other_mode, o_orderkey % 17 = 0 AS broken FROM orders),
       m AS (SELECT l_orderkey AS archive_id, 'part' || CASE WHEN l_linenumber = 6 THEN 1 ELSE l_linenumber END AS name,
         CAST(l_quantity * 1000 AS BIGINT) - CASE WHEN l_quantity = 1 THEN 2000 ELSE 0 END AS size FROM lineitem),
       l AS (SELECT archive_id, name, count(*) AS times, min(size) AS least, sum(size) AS bytes FROM m GROUP BY 1, 2),
       due AS (SELECT archive_id, 'part' || k AS name FROM a, range(1, 5) r(k) WHERE (version = '1' AND k <= 3) OR (version = '2' AND k <= 4))
       SELECT archive_id, 'schema version' AS problem, version AS detail FROM a WHERE version = '9'
       UNION ALL SELECT archive_id, 'unreadable', 'manifest' FROM a WHERE broken
       UNION ALL SELECT archive_id, 'disagree', 'analysis_area' FROM a WHERE moved AND NOT broken
       UNION ALL SELECT archive_id, 'disagree', 'accuracy_mode' FROM a WHERE other_mode AND NOT broken
       UNION ALL SELECT archive_id, 'member missing', name FROM due ANTI JOIN l USING (archive_id, name)
       UNION ALL SELECT archive_id, 'member unexpected', name FROM l ANTI JOIN due USING (archive_id, name) WHERE archive_id IN (SELECT archive_id FROM due)
       UNION ALL SELECT archive_id, 'member twice', name FROM l SEMI JOIN due USING (archive_id, name) WHERE times > 1
       UNION ALL SELECT archive_id, 'member size', name FROM l WHERE least < 0
       UNION ALL SELECT archive_id, 'archive size', CAST(sum(bytes)::BIGINT AS VARCHAR) FROM l GROUP BY 1 HAVING sum(bytes) > 200000""",
)
def v7_archives(spark, folder):
    """Orders as archives: config and manifest of the same order, its lines as members."""
    key = F.col("o_orderkey")

    def document(west, mode):
        area = F.struct(west.alias("west"), F.lit(35).alias("south"))
        return F.to_json(F.struct(area.alias("analysis_area"), mode.alias("accuracy_mode"), key.alias("run")))

    mode = F.col("o_orderpriority")
    archives = A.table(spark, folder, "orders").select(
        key.alias("archive_id"),
        F.when(key % 13 == 0, "9").otherwise((key % 2 + 1).cast("string")).alias("schema_version"),
        document(F.col("o_custkey"), mode).alias("config"),
        F.when(key % 17 == 0, F.lit("{broken")).otherwise(
            document(F.col("o_custkey") + F.when(key % 7 == 0, 1).otherwise(0), F.when(key % 11 == 0, F.lit("none")).otherwise(mode))
        ).alias("manifest"),
    )
    line = F.when(F.col("l_linenumber") == 6, 1).otherwise(F.col("l_linenumber"))
    members = A.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("archive_id"),
        F.concat(F.lit("part"), line.cast("string")).alias("name"),
        ((F.col("l_quantity") * 1000).cast("long") - F.when(F.col("l_quantity") == 1, 2000).otherwise(0)).alias("size"),
    )
    expected = {"1": ["part1", "part2", "part3"], "2": ["part1", "part2", "part3", "part4"]}
    return validate.archive_problems(archives, members, expected, 200_000, ["analysis_area", "accuracy_mode"])


@query(
    "v8_official_sources",
    "",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/:?#]+)', ['scheme', 'host']) AS x FROM pages)
       SELECT page_id, 'source_url' AS rule FROM p WHERE NOT (x.scheme = 'https' AND (x.host = 'example.org' OR ends_with(x.host, '.example.org')))""",
)
def v8(spark, folder):
    from tarnfield.functions.columns import official_url

    pages = A.table(spark, folder, "pages")
    return validate.violations(pages, "page_id", {"source_url": ~official_url(F.col("url"), "example.org")})
