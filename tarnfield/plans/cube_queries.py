"""Sources, no-data policy and reductions on the depth cube."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarnfield.functions.columns import class_index, duration_label, elapsed_label, finite, output_interval_s
from tarnfield.functions.columns import resource_class, uniform_intensity, wet, zoom_stride
from tarnfield.operators import policy, summary
from tarnfield.operators.grid import GridSpec
from tarnfield.plans import adapters as A
from tarnfield.plans.registry import query
from tarnfield.runtime import scratch_path
from tarnfield.sources import cube, dense, documents, raw_cube

EXTENT = "(SELECT max(\"row\") + 1 AS hh, max(col) + 1 AS ww FROM frame_cells)"


def r6(value, name):
    return (F.round(value, 6) + F.lit(0.0)).alias(name)


def summary_of(spark, folder):
    return summary.cell_summary(A.frames(spark, folder), A.frame_cells(spark, folder))


SUMMARY_SQL = """, peaks AS (
    SELECT "row", col, max(h) AS top, arg_max(t, row(h, -t)) AS tm,
           max(CASE WHEN h > 0.01 THEN sqrt(u * u + v * v) END) AS pk
    FROM frames GROUP BY 1, 2),
  cell_summary AS (
    SELECT c."row", c.col, c.elevation_m, c.mask > 0 AS active,
           CASE WHEN c.mask > 0 THEN top END AS max_depth, CASE WHEN c.mask > 0 THEN tm END AS max_time,
           CASE WHEN c.mask > 0 THEN pk END AS peak_speed
    FROM frame_cells c LEFT JOIN peaks p ON c."row" = p."row" AND c.col = p.col) """


@query(
    "s1_cube_scan",
    "frames",
    """SELECT t, count(*) AS n, round(sum(h), 6) AS depth_sum, round(max(h), 6) AS depth_max,
       round(sum(u), 6) + 0.0 AS u_sum FROM frames GROUP BY t""",
)
def s1(spark, folder):
    """The stored cube, folded tile by tile inside the scan tasks."""
    totals = A.stored_cube(spark, folder).totals()
    return totals.select(
        "t", F.col("cells").alias("n"), r6(F.col("h_sum"), "depth_sum"), r6(F.col("h_max"), "depth_max"), r6(F.col("u_sum"), "u_sum")
    )


@query(
    "s1_raw_cube",
    "frames",
    """SELECT t, "row", col, round(CAST(CAST(h AS FLOAT) AS DOUBLE), 6) AS h, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) + 0.0 AS v
       FROM frames WHERE "row" >= 1 AND col BETWEEN 2 AND 11 AND t < (SELECT max(t) FROM frames)""",
)
def s1_raw(spark, folder):
    """Written through the raw connector and read back; the axis filters become chunk and byte ranges."""
    frames, path = A.frames(spark, folder), scratch_path(spark, "raw-cube")
    last = frames.agg(F.max("t")).first()[0]
    raw_cube.write_raw(frames, path, GridSpec.measure(A.frame_cells(spark, folder)), last + 1, tile=8)
    found = spark.read.format("raw_cube").options(path=path, variables="h,u,v").load()
    cut = found.filter((F.col("row") >= 1) & (F.col("col") >= 2) & (F.col("col") <= 11) & (F.col("t") < last))
    return cut.select("t", "row", "col", r6(F.col("h").cast("double"), "h"), r6(F.col("v").cast("double"), "v"))


@query(
    "s2_window_read",
    "frames frame_cells",
    f"""SELECT t, "row", col, round(h, 6) AS h FROM frames, {EXTENT} e
        WHERE t = 7 AND "row" >= e.hh // 4 AND "row" < greatest(e.hh // 4 + 1, (3 * e.hh) // 4) AND col >= 3 AND col < 12""",
)
def s2(spark, folder):
    """A window cut out of the stored arrays."""
    stored = A.stored_cube(spark, folder)
    low = stored.grid.height // 4
    rows = (low, max(low + 1, 3 * stored.grid.height // 4))
    window = stored.window(7, rows, (3, 12), ("h",))
    return window.select("t", "row", "col", r6(F.col("h"), "h"))


@query(
    "s3_point_series",
    "frames frame_cells",
    f"""SELECT t, round(h, 6) AS h FROM frames, {EXTENT} e WHERE "row" = e.hh // 2 AND col = e.ww // 2""",
)
def s3(spark, folder):
    """All times of one cell out of the stored arrays."""
    stored = A.stored_cube(spark, folder)
    return stored.point_series(stored.grid.height // 2, stored.grid.width // 2).select("t", r6(F.col("h"), "h"))


@query(
    "s17_cube_sink_round_trip",
    "frames",
    """SELECT t, "row" // 4 AS trow, count(*) AS n, round(sum(CAST(CAST(h AS FLOAT) AS DOUBLE)), 6) AS depth_sum FROM frames GROUP BY 1, 2""",
)
def s17(spark, folder):
    path = scratch_path(spark, "cube")
    cube.write_cube(A.frames(spark, folder).withColumn("run_id", F.lit("r1")), path, tile=4)
    stored = cube.read_cube(spark, path)
    return stored.groupBy("t", "trow").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("h"), "depth_sum"))


@query(
    "s17_face_cube",
    "frames",
    """SELECT t, ("row" * 15 + col) // 64 AS block, count(*) AS n, round(sum(h), 9) AS depth_sum, round(sum(v), 9) + 0.0 AS v_sum
       FROM frames WHERE "row" * 15 + col >= 20 GROUP BY 1, 2""",
)
def s17_faces(spark, folder):
    """The face form: blocks of 64 faces, never expanded to cells; read back from the 20th face on."""
    face = (F.col("row") * 15 + F.col("col")).alias("face")
    series = A.frames(spark, folder).select(F.lit("r1").alias("run_id"), "t", face, "h", "u", "v")
    faces = A.frame_cells(spark, folder).select(face, "mask", "elevation_m")
    stored = dense.write_faces(series, scratch_path(spark, "faces"), faces, block=64, dtype="float64")
    found = dense.face_cells(stored, faces=(20, stored.document["faces"]))
    return found.groupBy("t", F.floor(F.col("face") / 64).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("h"), 9).alias("depth_sum"), (F.round(F.sum("v"), 9) + F.lit(0.0)).alias("v_sum")
    )


@query(
    "s17_result_document",
    "raw_frames frame_cells",
    """, m AS (SELECT f.*, mask, CASE WHEN isnan(h) THEN NULL ELSE h END AS depth FROM raw_frames f
            JOIN frame_cells c ON c."row" = f."row" AND c.col = f.col),
       of AS (SELECT count(*) FILTER (mask = 1) AS active, count(*) FILTER (mask > 1) AS boundary,
                round(min(CASE WHEN mask = 1 THEN elevation_m END), 6) AS z_low, round(max(CASE WHEN mask = 1 THEN elevation_m END), 6) AS z_high,
                max("row") + 1 AS hh, max(col) + 1 AS ww FROM frame_cells),
       per AS (SELECT "row", col, max(greatest(depth, 0)) FILTER (depth IS NOT NULL) AS top FROM m WHERE mask = 1 GROUP BY 1, 2)
       SELECT '1' AS schema_version, 'regular' AS storage_kind, -ww / 2.0::DOUBLE AS west_m, hh / 2.0::DOUBLE AS north_m, 'm' AS depth_unit,
         list_sort(list(DISTINCT t)) AS times, true AS flows, round(max(CASE WHEN mask = 1 THEN greatest(depth, 0) END), 6) AS deepest,
         (SELECT count(*) FILTER (top IS NOT NULL) FROM per) AS reconstructed,
         count(*) FILTER (mask = 1 AND depth < 0) AS negative, round(min(CASE WHEN mask = 1 THEN depth END), 6) AS lowest, boundary, active, z_low, z_high
       FROM m, of GROUP BY hh, ww, boundary, active, z_low, z_high""",
)
def s17_document(spark, folder):
    """The document of a raw cube, published with its dense form and read back from disk."""
    cells, raw = A.frame_cells(spark, folder), A.raw_frames(spark, folder)
    grid, path = GridSpec.measure(cells), scratch_path(spark, "told-cube")
    told = json.loads(documents.result_document(raw, cells, grid).first()["document"])
    dense.write_dense(raw.withColumn("run_id", F.lit("r1")), path, grid, tile=16, dtype="float64", document=told)
    stored = spark.read.parquet(f"{path}/published")
    kind = (
        "schema_version string, storage_kind string, bounds struct<west_m:double,north_m:double>, units map<string,string>, "
        "available_time_indices array<int>, flow_vectors_available boolean, max_depth_summary struct<global_max_depth_m:double,"
        "hmax_reconstructed_cells:long,negative_depth_clipped_values:long,min_raw_active_depth_m:double,excluded_boundary_cells:long>, "
        "elevation_legend struct<low_m:double,high_m:double>, grid_level_summary map<string,long>"
    )
    d = stored.select(F.from_json("document", kind).alias("d")).select("d.*")
    most = F.col("max_depth_summary")
    return d.select(
        "schema_version",
        "storage_kind",
        "bounds.west_m",
        "bounds.north_m",
        F.col("units")["water_depth"].alias("depth_unit"),
        F.col("available_time_indices").alias("times"),
        F.col("flow_vectors_available").alias("flows"),
        r6(most["global_max_depth_m"], "deepest"),
        most["hmax_reconstructed_cells"].alias("reconstructed"),
        most["negative_depth_clipped_values"].alias("negative"),
        r6(most["min_raw_active_depth_m"], "lowest"),
        most["excluded_boundary_cells"].alias("boundary"),
        F.col("grid_level_summary")["1m"].alias("active"),
        r6(F.col("elevation_legend.low_m"), "z_low"),
        r6(F.col("elevation_legend.high_m"), "z_high"),
    )


@query(
    "s19_exchange_cell_table",
    "cells",
    """SELECT "row", col, round(elevation_m, 6) + 0.0 AS z, building, road,
       CASE WHEN road THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END AS manning,
       CASE WHEN building THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS rain_weight FROM cells""",
)
def s19(spark, folder):
    path = scratch_path(spark, "exchange")
    cells = A.cells(spark, folder)
    cells.select(
        "row",
        "col",
        r6(F.col("elevation_m"), "z"),
        "building",
        "road",
        F.when(F.col("road"), 0.03).otherwise(0.05).alias("manning"),
        F.when(F.col("building"), 0.0).otherwise(1.0).alias("rain_weight"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "p1_finite_or_null",
    "raw_frames",
    """SELECT t, count(*) AS n, count(CASE WHEN NOT isnan(h) THEN h END) AS kept,
       round(max(CASE WHEN NOT isnan(h) THEN h END), 6) + 0.0 AS h_max,
       round(min(CASE WHEN NOT isnan(h) THEN h END), 6) + 0.0 AS h_min FROM raw_frames GROUP BY t""",
)
def p1(spark, folder):
    frames = policy.clean(A.raw_frames(spark, folder), "h")
    return frames.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.count("h").alias("kept"), r6(F.max("h"), "h_max"), r6(F.min("h"), "h_min")
    )


@query(
    "p2_active_boundary",
    "frame_cells",
    """SELECT mask, count_if(mask = 1) AS strict_active, count_if(mask > 0) AS positive_active,
       count_if(mask IN (2, 3, 6)) AS boundary FROM frame_cells GROUP BY mask""",
)
def p2(spark, folder):
    cells = A.frame_cells(spark, folder)
    both = policy.split_active(cells).withColumnRenamed("active", "strict").drop("boundary")
    both = policy.split_active(both, "positive")
    return both.groupBy("mask").agg(
        F.count_if("strict").alias("strict_active"),
        F.count_if("active").alias("positive_active"),
        F.count_if("boundary").alias("boundary"),
    )


@query(
    "p3_depth_normalisation",
    "raw_frames frame_cells",
    """SELECT t, "row", col, CASE WHEN mask = 1 THEN CASE WHEN isnan(h) OR h < 0 THEN 0.0::DOUBLE ELSE round(h, 6) END END AS h,
       CASE WHEN mask = 1 THEN isnan(h) END AS filled, CASE WHEN mask = 1 AND NOT isnan(h) THEN h < 0 END AS clipped
       FROM raw_frames JOIN frame_cells USING ("row", col)""",
)
def p3(spark, folder):
    frames = policy.normalise_depth(masked_frames(spark, folder), F.col("active"))
    return frames.select("t", "row", "col", r6(F.col("h"), "h"), "filled", "clipped")


def masked_frames(spark, folder):
    cells = policy.split_active(A.frame_cells(spark, folder)).select("row", "col", "active")
    return A.raw_frames(spark, folder).join(cells, ["row", "col"])


@query(
    "p3_refused_depths",
    "raw_frames frame_cells",
    """SELECT t, "row", col FROM raw_frames JOIN frame_cells USING ("row", col) WHERE mask = 1 AND isnan(h)""",
)
def p3_refused(spark, folder):
    return policy.refused_depths(masked_frames(spark, folder), F.col("active")).select("t", "row", "col")


@query(
    "p3_depth_report",
    "raw_frames frame_cells",
    """SELECT count(*) AS n, count_if(isnan(h)) AS dry_filled, count_if(NOT isnan(h) AND h < 0) AS negative_clipped,
       round(least(min(CASE WHEN NOT isnan(h) THEN h END), 0.0), 6) AS raw_min FROM raw_frames JOIN frame_cells USING ("row", col) WHERE mask = 1""",
)
def p3_report(spark, folder):
    return policy.depth_report(masked_frames(spark, folder), F.col("active")).withColumn("raw_min", F.round("raw_min", 6))


@query(
    "p4_velocity_normalisation",
    "raw_frames frame_cells",
    """SELECT f.t, f."row", f.col,
       CASE WHEN mask = 1 THEN CASE WHEN NOT isnan(h) AND h > 0 THEN u ELSE 0.0::DOUBLE END END AS u,
       CASE WHEN mask = 1 THEN CASE WHEN NOT isnan(h) AND h > 0 THEN v ELSE 0.0::DOUBLE END END AS v
       FROM raw_frames f JOIN frame_cells c ON f."row" = c."row" AND f.col = c.col""",
)
def p4(spark, folder):
    frames = policy.normalise_depth(masked_frames(spark, folder), F.col("active"))
    return policy.normalise_velocity(frames).select("t", "row", "col", "u", "v")


@query(
    "p5_wet_masks",
    "frames",
    """SELECT t, count_if(h > 0.01) AS wet_strict, count_if(h >= 0.01) AS wet_inclusive, count_if(h > 0) AS wet_any
       FROM frames GROUP BY t""",
)
def p5(spark, folder):
    return A.frames(spark, folder).groupBy("t").agg(
        F.count_if(wet("h")).alias("wet_strict"),
        F.count_if(wet("h", inclusive=True)).alias("wet_inclusive"),
        F.count_if(wet("h", 0.0)).alias("wet_any"),
    )


@query(
    "p6_speed_direction",
    "frames",
    """SELECT t, "row", col, round(sqrt(u*u+v*v), 6) AS speed,
       CASE WHEN u*u+v*v > 0 THEN round(u / sqrt(u*u+v*v), 6) + 0.0 END AS dir_x,
       CASE WHEN u*u+v*v > 0 THEN round(v / sqrt(u*u+v*v), 6) + 0.0 END AS dir_y FROM frames""",
)
def p6(spark, folder):
    flow = policy.with_flow(A.frames(spark, folder))
    return flow.select(
        "t", "row", "col", r6(F.col("speed"), "speed"), r6(F.col("dir_x"), "dir_x"), r6(F.col("dir_y"), "dir_y")
    )


@query(
    "p7_velocity_decimation",
    "frames frame_cells",
    f"""SELECT t, "row", col, u, v FROM frames,
       (SELECT greatest(1, CAST(ceil(sqrt(hh * ww / 200.0)) AS INT)) AS s FROM {EXTENT}) k
       WHERE "row" % k.s = 0 AND col % k.s = 0""",
)
def p7(spark, folder):
    grid = GridSpec.measure(A.frame_cells(spark, folder))
    stride = policy.velocity_stride(grid, 200)
    return policy.decimate(A.frames(spark, folder), stride).select("t", "row", "col", "u", "v")


@query(
    "p14_class_index",
    "frames",
    """SELECT CAST((h > 0.05)::INT + (h > 0.1)::INT + (h > 0.2)::INT + (h > 0.4)::INT + (h > 0.8)::INT
       + (h > 1.6)::INT AS INT) AS class, count(*) AS n FROM frames GROUP BY 1""",
)
def p14(spark, folder):
    breaks = F.array(*[F.lit(b) for b in (0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 1e9)])
    frames = A.frames(spark, folder).select(class_index(F.col("h"), breaks).alias("class"))
    return frames.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p17_resource_class",
    "",
    """SELECT c_custkey AS area_id, CAST(ceil((c_custkey % 61 * 70 + 500) / 2.0) * ceil((c_custkey % 47 * 90 + 500) / 2.0) AS BIGINT)
         AS cells,
       CASE WHEN ceil((c_custkey % 61 * 70 + 500) / 2.0) * ceil((c_custkey % 47 * 90 + 500) / 2.0) <= 250000 THEN 'small'
            WHEN ceil((c_custkey % 61 * 70 + 500) / 2.0) * ceil((c_custkey % 47 * 90 + 500) / 2.0) <= 1000000 THEN 'medium'
            WHEN ceil((c_custkey % 61 * 70 + 500) / 2.0) * ceil((c_custkey % 47 * 90 + 500) / 2.0) <= 4000000 THEN 'large'
            ELSE 'very_large' END AS resource FROM customer""",
)
def p17(spark, folder):
    key = F.col("c_custkey")
    wide, tall = F.ceil((key % 61 * 70 + 500) / 2.0), F.ceil((key % 47 * 90 + 500) / 2.0)
    areas = A.table(spark, folder, "customer").select(key.alias("area_id"), (wide * tall).alias("cells"))
    return areas.withColumn("resource", resource_class(F.col("cells")))


@query(
    "p18_output_interval",
    "",
    """SELECT o_orderkey, CAST(least(900, greatest(60, ceil(greatest(60.0, (o_orderkey * 37 % 200000) / 119.0) / 60) * 60)) AS INT)
       AS interval_s FROM orders""",
)
def p18(spark, folder):
    duration = F.col("o_orderkey") * 37 % 200000
    return A.table(spark, folder, "orders").select("o_orderkey", output_interval_s(duration).alias("interval_s"))


@query(
    "p19_zoom_stride",
    "",
    """SELECT l_quantity AS zoom, CAST(greatest(1, least(4096, floor(6 * power(2.0, 18 - l_quantity) + 0.5))) AS INT) AS stride,
       count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def p19(spark, folder):
    lines = A.table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("zoom"), zoom_stride(F.col("l_quantity")).alias("stride")
    )
    return lines.groupBy("zoom", "stride").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p20_elapsed_labels",
    "",
    """, shaped AS (SELECT event_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000.0 + 0.5) AS BIGINT) AS m FROM events)
       SELECT event_id, (CASE WHEN m // 1440 > 0 THEN CAST(m // 1440 AS VARCHAR) || '日 ' ELSE '' END)
         || lpad(CAST(m % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS label
       FROM shaped""".replace(", shaped", "WITH shaped", 1),
)
def p20(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    start = F.lit("2024-01-01 00:00:00")
    return A.table(spark, folder, "events").select(
        "event_id", elapsed_label(text, start, F.col("event_id")).alias("label")
    )


@query(
    "p20_duration_labels",
    "",
    """SELECT o_orderkey, (CASE WHEN m // 1440 > 0 THEN CAST(m // 1440 AS VARCHAR) || '日 ' ELSE '' END)
         || lpad(CAST(m % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS label
       FROM (SELECT o_orderkey, CAST(floor(o_orderkey % 9999 / 2.0 + 0.5) AS BIGINT) AS m FROM orders)""",
)
def p20_minutes(spark, folder):
    minutes = F.col("o_orderkey") % 9999 / 2.0
    return A.table(spark, folder, "orders").select("o_orderkey", duration_label(minutes).alias("label"))


@query(
    "p21_uniform_intensity",
    "rain_events",
    """SELECT event_id, total_mm / (duration_minutes / 60.0::DOUBLE) AS intensity FROM rain_events""",
)
def p21(spark, folder):
    rate = uniform_intensity(F.col("total_mm"), F.col("duration_minutes"))
    return A.rain_events(spark, folder).select("event_id", rate.alias("intensity"))


@query(
    "a1_max_depth",
    "raw_frames",
    """, parts AS (
         SELECT "row", col, CASE WHEN isnan(h) THEN NULL ELSE greatest(h, 0.0) END AS h,
                CASE WHEN t % 10 = 0 AND (col + "row") % 4 <> 0 AND NOT isnan(h) THEN h + 0.5 END AS hmax FROM raw_frames)
       SELECT "row", col, round(coalesce(max(hmax), max(h)), 6) + 0.0 AS max_depth, max(hmax) IS NULL AS reconstructed
       FROM parts GROUP BY 1, 2""",
)
def a1(spark, folder):
    frames = A.raw_frames(spark, folder)
    missing = (F.col("row") + F.col("col")) % 4 == 0
    stored = frames.filter("t % 10 = 0").select(
        "row", "col", F.when(~missing, finite("h") + 0.5).alias("hmax")
    )
    best = summary.max_depth(frames, stored)
    return best.select("row", "col", r6(F.col("max_depth"), "max_depth"), "reconstructed")


@query("a2_first_max_time", "frames", 'SELECT "row", col, arg_max(t, row(h, -t)) AS max_time FROM frames GROUP BY 1, 2')
def a2(spark, folder):
    return A.frames(spark, folder).groupBy("row", "col").agg(summary.first_max_time().alias("max_time"))


@query(
    "a3_peak_wet_speed",
    "frames",
    """SELECT "row", col, round(max(CASE WHEN h > 0.01 THEN sqrt(u*u+v*v) END), 6) AS peak_speed FROM frames GROUP BY 1, 2""",
)
def a3(spark, folder):
    return A.frames(spark, folder).groupBy("row", "col").agg(r6(summary.peak_wet_speed(), "peak_speed"))


@query(
    "a4_cell_summary",
    "frames frame_cells",
    SUMMARY_SQL
    + """SELECT "row", col, elevation_m, active, round(max_depth, 6) AS max_depth, max_time,
       round(peak_speed, 6) AS peak_speed FROM cell_summary""",
)
def a4(spark, folder):
    best = summary_of(spark, folder)
    return best.withColumns({"max_depth": F.round("max_depth", 6), "peak_speed": F.round("peak_speed", 6)})


@query(
    "a5_diagnostics",
    "frames frame_cells",
    SUMMARY_SQL
    + """SELECT count_if(active) AS active_cells, count_if(active AND max_depth IS NOT NULL) AS finite_max,
       round(max(max_depth), 6) AS global_max,
       round(coalesce(min(CASE WHEN max_depth >= 0.01 THEN max_depth END), 0.01), 6) AS min_visible,
       min(CASE WHEN active THEN elevation_m END) AS terrain_min, max(CASE WHEN active THEN elevation_m END) AS terrain_max,
       count_if(active AND elevation_m IS NULL) AS bad_terrain, count_if(max_depth < 0) AS negative_max FROM cell_summary""",
)
def a5(spark, folder):
    row = summary.diagnostics(summary_of(spark, folder))
    return row.withColumns({"global_max": F.round("global_max", 6), "min_visible": F.round("min_visible", 6)})


@query(
    "a6_deepest_cell",
    "frames frame_cells",
    SUMMARY_SQL
    + f"""SELECT "row", col, round(max_depth, 6) AS max_depth, col + 0.5 - ww / 2.0::DOUBLE AS x_m,
       "row" + 0.5 - hh / 2.0::DOUBLE AS y_m FROM cell_summary, {EXTENT} WHERE max_depth IS NOT NULL
       ORDER BY cell_summary.max_depth DESC, "row", col LIMIT 1""",
)
def a6(spark, folder):
    grid = GridSpec.measure(A.frame_cells(spark, folder))
    return summary.deepest_cell(summary_of(spark, folder), grid).withColumn("max_depth", F.round("max_depth", 6))


@query(
    "a7_value_ranges",
    "frames frame_cells",
    SUMMARY_SQL
    + """SELECT 'depth' AS what, round(coalesce(min(CASE WHEN max_depth >= 0.01 THEN max_depth END), 0), 6) AS low,
         round(coalesce(max(CASE WHEN max_depth >= 0.01 THEN max_depth END), 0), 6) AS high FROM cell_summary
       UNION ALL SELECT 'terrain', min(CASE WHEN active THEN elevation_m END), max(CASE WHEN active THEN elevation_m END) FROM cell_summary
       UNION ALL SELECT 'speed', round(min(peak_speed), 6), round(max(peak_speed), 6) FROM cell_summary""",
)
def a7(spark, folder):
    best = summary_of(spark, folder)
    parts = {
        "depth": (F.col("max_depth"), F.col("max_depth") >= 0.01),
        "terrain": (F.col("elevation_m"), F.col("active")),
        "speed": (F.col("peak_speed"), F.col("active")),
    }
    aggregates = [
        f(F.when(keep, value)).alias(f"{name}_{f.__name__}")
        for name, (value, keep) in parts.items()
        for f in (F.min, F.max)
    ]
    one = best.agg(*aggregates)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("what"),
                    F.round(F.coalesce(F.col(f"{name}_min"), F.lit(0.0)), 6).alias("low"),
                    F.round(F.coalesce(F.col(f"{name}_max"), F.lit(0.0)), 6).alias("high"),
                )
                for name in parts
            ]
        )
    )
    return one.select(rows.alias("r")).select("r.*")


@query(
    "a8_area_histogram",
    "frames frame_cells",
    """SELECT floor(f.h * 50) / 50 AS value, sum(4.0::DOUBLE) AS area FROM frames f
       JOIN frame_cells c ON f."row" = c."row" AND f.col = c.col WHERE c.mask > 0 GROUP BY 1""",
)
def a8(spark, folder):
    cells = A.frame_cells(spark, folder).filter("mask > 0").select("row", "col")
    frames = A.frames(spark, folder).join(cells, ["row", "col"])
    return summary.value_histogram(frames, F.floor(F.col("h") * 50) / 50, F.lit(4.0))


@query(
    "a10_block_areas",
    "frame_cells",
    """SELECT "row" // 4 AS brow, col // 4 AS bcol, sum(CASE WHEN mask > 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS area
       FROM frame_cells GROUP BY 1, 2""",
)
def a10(spark, folder):
    area = F.when(F.col("mask") > 0, 4.0).otherwise(0.0)
    return summary.block_sums(A.frame_cells(spark, folder), 4, area)


@query(
    "a13_block_minimum",
    "cells",
    """SELECT "row" // 8 AS brow, col // 8 AS bcol,
       CASE WHEN count(*) < 64 THEN least(min(CASE WHEN building THEN 1 ELSE 16 END), 8)
            ELSE min(CASE WHEN building THEN 1 ELSE 16 END) END AS block_min FROM cells GROUP BY 1, 2""",
)
def a13(spark, folder):
    cells = A.cells(spark, folder).withColumn("limit_m", F.when(F.col("building"), 1).otherwise(16))
    return summary.block_minimum(cells, 8, "limit_m")


@query(
    "a23_input_summary",
    "cells",
    """SELECT count(*) AS n, count(elevation_m) AS finite_z, min(elevation_m) AS z_min, max(elevation_m) AS z_max,
       round(avg(building::INT), 6) AS building_fraction, round(avg(road::INT), 6) AS road_fraction,
       CAST(sum(CASE WHEN building THEN 0 ELSE 1 END) AS DOUBLE) AS rain_sum FROM cells""",
)
def a23(spark, folder):
    cells = A.cells(spark, folder).withColumn("rain_weight", F.when(F.col("building"), 0.0).otherwise(1.0))
    got = summary.input_summary(cells)
    return got.withColumns(
        {n: F.round(n, 6) for n in ("building_fraction", "road_fraction")}
    )


@query(
    "a25_mask_counts",
    "frame_cells",
    """SELECT count_if(mask > 0) AS active, count_if(mask = 0) AS blocked, count_if(mask = 3) AS mask3,
       count_if(mask = 6) AS mask6 FROM frame_cells""",
)
def a25(spark, folder):
    mask = F.col("mask")
    return A.frame_cells(spark, folder).agg(
        F.count_if(mask > 0).alias("active"),
        F.count_if(mask == 0).alias("blocked"),
        F.count_if(mask == 3).alias("mask3"),
        F.count_if(mask == 6).alias("mask6"),
    )


@query(
    "a26_final_storage",
    "raw_frames",
    """SELECT round(sum(h), 6) AS volume, max(t) AS last_t FROM raw_frames
       WHERE NOT isnan(h) AND t = (SELECT max(t) FROM raw_frames)""",
)
def a26(spark, folder):
    return summary.final_storage(A.raw_frames(spark, folder)).withColumn("volume", F.round("volume", 6))


@query(
    "a28_overview",
    "cells",
    """, e AS (SELECT max("row") + 1 AS hh, max(col) + 1 AS ww FROM cells),
       o AS (SELECT hh, ww, CASE WHEN greatest(hh, ww) <= 256 THEN hh
                             ELSE greatest(1, CAST(round_even(hh * 256.0 / greatest(hh, ww), 0) AS INT)) END AS oh,
                    CASE WHEN greatest(hh, ww) <= 256 THEN ww
                             ELSE greatest(1, CAST(round_even(ww * 256.0 / greatest(hh, ww), 0) AS INT)) END AS ow FROM e)
       SELECT CAST(i.i AS INT) AS "row", CAST(j.j AS INT) AS col, building FROM o, LATERAL (SELECT unnest(range(o.oh)) AS i) i,
         LATERAL (SELECT unnest(range(o.ow)) AS j) j, cells c
       WHERE c."row" = CAST(floor((i.i + 0.5) * hh / oh) AS INT) AND c.col = CAST(floor((j.j + 0.5) * ww / ow) AS INT)""",
)
def a28(spark, folder):
    cells = A.cells(spark, folder)
    return summary.overview(cells, GridSpec.measure(cells), "building", 256)


@query(
    "a28_overview_reduced",
    "cells",
    """, wide AS (SELECT CAST(p_partkey // 1000 AS INT) AS "row", CAST(p_partkey % 1000 AS INT) AS col, building FROM cells),
       e AS (SELECT max("row") + 1 AS hh, max(col) + 1 AS ww FROM wide),
       o AS (SELECT hh, ww, CASE WHEN ww <= 256 AND hh <= 256 THEN hh ELSE greatest(1, CAST(round_even(hh * 256.0 / greatest(hh, ww), 0) AS INT)) END AS oh,
                    CASE WHEN ww <= 256 AND hh <= 256 THEN ww ELSE greatest(1, CAST(round_even(ww * 256.0 / greatest(hh, ww), 0) AS INT)) END AS ow FROM e)
       SELECT CAST(i.i AS INT) AS "row", CAST(j.j AS INT) AS col, building FROM o, LATERAL (SELECT unnest(range(o.oh)) AS i) i,
         LATERAL (SELECT unnest(range(o.ow)) AS j) j, wide c
       WHERE c."row" = CAST(floor((i.i + 0.5) * hh / oh) AS INT) AND c.col = CAST(floor((j.j + 0.5) * ww / ow) AS INT)""",
)
def a28_reduced(spark, folder):
    """The same cells laid out in rows of 1000, so that the limit of 256 takes effect at every size."""
    key = F.col("p_partkey")
    wide = A.cells(spark, folder).select(A.int_div(key, 1000).cast("int").alias("row"), (key % 1000).cast("int").alias("col"), "building")
    return summary.overview(wide, GridSpec.measure(wide), "building", 256)


@query(
    "p13_point_lookup",
    "frames frame_cells points",
    SUMMARY_SQL
    + f""", loc AS (SELECT point_id, lon - 134 AS x, lat - 34 AS y FROM points),
       placed AS (SELECT point_id, NOT (x >= -ww / 2.0 AND x < ww / 2.0 AND y >= -hh / 2.0 AND y < hh / 2.0) AS outside,
         CASE WHEN x >= -ww / 2.0 AND x < ww / 2.0 AND y >= -hh / 2.0 AND y < hh / 2.0 THEN CAST(floor(y + hh / 2.0) AS INT) END AS "row",
         CASE WHEN x >= -ww / 2.0 AND x < ww / 2.0 AND y >= -hh / 2.0 AND y < hh / 2.0 THEN CAST(floor(x + ww / 2.0) AS INT) END AS col
         FROM loc, {EXTENT})
       SELECT p.point_id, p.outside, p."row", p.col, coalesce(s.active, false) AND NOT p.outside AS has_data,
         round(s.max_depth, 6) AS max_depth, s.max_time
       FROM placed p LEFT JOIN cell_summary s ON p."row" = s."row" AND p.col = s.col""",
)
def p13(spark, folder):
    grid = GridSpec.measure(A.frame_cells(spark, folder))
    points = A.points(spark, folder).select(
        "point_id", (F.col("lon") - 134).alias("x"), (F.col("lat") - 34).alias("y")
    )
    found = cube.inspect_points(points, summary_of(spark, folder), grid)
    return found.select("point_id", "outside", "row", "col", "has_data", r6(F.col("max_depth"), "max_depth"), "max_time")
