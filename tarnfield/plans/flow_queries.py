"""Flow arrows, frame selection, elevation merging and map projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfield.functions import geo
from tarnfield.functions.columns import phase_hash
from tarnfield.operators import elevation, sampling, timeline
from tarnfield.operators.grid import GridSpec
from tarnfield.plans import adapters as A
from tarnfield.plans.cube_queries import EXTENT, r6
from tarnfield.plans.registry import query
from tarnfield.runtime import scratch_path

WET7 = """, wet AS (SELECT "row", col, h, u, v, sqrt(u*u+v*v) AS speed FROM frames JOIN frame_cells USING ("row", col) WHERE mask > 0 AND t = 7 AND h >= 0.01 AND sqrt(u*u+v*v) >= 0.1) """


def frame(spark, folder, t=7):
    """One frame with the mask of its cells."""
    mask = A.frame_cells(spark, folder).select("row", "col", "mask")
    return A.frames(spark, folder).filter(F.col("t") == t).join(mask, ["row", "col"])


def grid_of(spark, folder):
    return GridSpec.measure(A.frame_cells(spark, folder), lon0=139.0, lat0=35.0)


BLOCK_BEST = WET7 + f""", st AS (SELECT greatest(4, CAST(ceil(sqrt(hh * ww / 12.0)) AS INT)) AS s, hh, ww FROM {EXTENT}),
  best AS (SELECT "row" // s AS br, col // s AS bc, arg_min(row("row", col, h, u, v, speed), row(-speed, "row", col)) AS b, s, hh, ww FROM wet, st GROUP BY ALL),
  arrows AS (SELECT br, bc, b[1] AS "row", b[2] AS col, b[3] AS h, b[4] AS u, b[5] AS v, b[6] AS speed,
    least(least(s, hh - br * s), least(s, ww - bc * s)) * 1.0::DOUBLE AS span_m, hh, ww FROM best) """


@query(
    "w4_fastest_per_block",
    "frames frame_cells",
    BLOCK_BEST + 'SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, "row", col, round(speed, 6) AS speed, span_m FROM arrows',
)
def w4(spark, folder):
    best = sampling.fastest_per_block(frame(spark, folder), grid_of(spark, folder), 12, 0.1)
    return best.select("brow", "bcol", "row", "col", r6(F.col("speed"), "speed"), "span_m")


SEGMENTS = BLOCK_BEST + """, g AS (SELECT "row", col, u / speed AS dx, v / speed AS dy, 0.8 * span_m AS len, col + 0.5 - ww / 2.0 AS x, "row" + 0.5 - hh / 2.0 AS y FROM arrows),
  p AS (SELECT *, x - dx * len * 0.42 AS tx, y - dy * len * 0.42 AS ty, x + dx * len * 0.58 AS px, y + dy * len * 0.58 AS py, len * 0.28 AS hd,
     cos(radians(30)) AS ca, sin(radians(30)) AS sa FROM g) """


@query(
    "m5_arrow_geometry",
    "frames frame_cells",
    SEGMENTS
    + """SELECT "row", col, 0 AS part, round(tx, 6) + 0.0 AS x0, round(ty, 6) + 0.0 AS y0, round(px, 6) + 0.0 AS x1, round(py, 6) + 0.0 AS y1 FROM p
       UNION ALL SELECT "row", col, 1, round(px, 6) + 0.0, round(py, 6) + 0.0, round(px + (-dx * ca + dy * sa) * hd, 6) + 0.0, round(py + (-dx * sa - dy * ca) * hd, 6) + 0.0 FROM p
       UNION ALL SELECT "row", col, 2, round(px, 6) + 0.0, round(py, 6) + 0.0, round(px + (-dx * ca - dy * sa) * hd, 6) + 0.0, round(py + (dx * sa - dy * ca) * hd, 6) + 0.0 FROM p""",
)
def m5(spark, folder):
    grid = grid_of(spark, folder)
    lines = sampling.arrow_lines(sampling.fastest_per_block(frame(spark, folder), grid, 12, 0.1), grid)
    ends = sampling.arrow_segments(lines)
    return ends.select("row", "col", "part", *[r6(F.col(n), n) for n in ("x0", "y0", "x1", "y1")])


@query(
    "s18_geojson_sink",
    "frames frame_cells",
    SEGMENTS
    + """, ends AS (SELECT p."row", p.col, unnest([0, 0, 1, 1, 2, 2]) AS line, unnest([0, 1, 0, 1, 0, 1]) AS nth,
         unnest([tx, px, px, px + (-dx * ca + dy * sa) * hd, px, px + (-dx * ca - dy * sa) * hd]) AS x,
         unnest([ty, py, py, py + (-dx * sa - dy * ca) * hd, py, py + (dx * sa - dy * ca) * hd]) AS y FROM p)
       SELECT 'Feature' AS kind, 'MultiLineString' AS shape, e."row", e.col AS "column", round(a.speed, 6) AS speed, line, nth,
         round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM ends e JOIN arrows a ON a."row" = e."row" AND a.col = e.col""",
)
def s18(spark, folder):
    """Written as GeoJSON and read back; every coordinate is projected to local metres again."""
    grid, path = grid_of(spark, folder), scratch_path(spark, "features")
    lines = sampling.arrow_lines(sampling.fastest_per_block(frame(spark, folder), grid, 12, 0.1), grid)
    sampling.write_features(sampling.geojson_features(lines, grid, 7), path)
    schema = (
        "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, "
        "properties STRUCT<speed_mps: DOUBLE, row: INT, column: INT>"
    )
    read = spark.read.schema(schema).json(path).select("*", F.posexplode("geometry.coordinates").alias("line", "ends"))
    read = read.select("*", F.posexplode("ends").alias("nth", "p"))
    x, y = geo.to_local(F.get("p", F.lit(0)), F.get("p", F.lit(1)), grid.lon0, grid.lat0)
    return read.select(
        F.col("type").alias("kind"),
        F.col("geometry.type").alias("shape"),
        F.col("properties.row").alias("row"),
        F.col("properties.column").alias("column"),
        r6(F.col("properties.speed_mps"), "speed"),
        "line",
        "nth",
        (F.round(x, 3) + F.lit(0.0)).alias("x"),
        (F.round(y, 3) + F.lit(0.0)).alias("y"),
    )


@query(
    "w5_nearest_to_bin_centre",
    "frames frame_cells",
    WET7
    + f""", win AS (SELECT 1 AS r0, hh - 1 AS r1, 2 AS c0, ww - 1 AS c1, 4 AS s FROM {EXTENT}),
       c AS (SELECT wet.*, "row" // s AS br, col // s AS bc,
          "row" - (greatest("row" // s * s, r0) + least(("row" // s + 1) * s, r1) - 1) / 2.0 AS dr,
          col - (greatest(col // s * s, c0) + least((col // s + 1) * s, c1) - 1) / 2.0 AS dc
          FROM wet, win WHERE "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1),
       best AS (SELECT br, bc, arg_min(row("row", col, speed), row(dr * dr + dc * dc, "row", col)) AS b FROM c GROUP BY 1, 2)
       SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, b[1] AS "row", b[2] AS col, round(b[3], 6) AS speed FROM best""",
)
def w5(spark, folder):
    grid = grid_of(spark, folder)
    best = sampling.nearest_to_bin_centre(
        frame(spark, folder), grid, 4.0, (1, grid.height - 1), (2, grid.width - 1), 0.1
    )
    return best.select("brow", "bcol", "row", "col", r6(F.col("speed"), "speed"))


FACE_BINS = """, f AS (SELECT '1:' || "row" || ':' || col AS face_id, "row", col, sqrt(u*u+v*v) AS speed FROM frames JOIN frame_cells USING ("row", col) WHERE mask > 0 AND t = 7 AND h >= 0.01),
  bins AS (SELECT *, least(2, CAST(floor(("row" + 0.5) * 3 / hh) AS INT)) AS rb, least(2, CAST(floor((col + 0.5) * 3 / ww) AS INT)) AS cb
           FROM f, """ + EXTENT + """)
  SELECT arg_min(face_id, row(-speed, face_id)) AS face_id, round(max(speed), 6) AS speed FROM bins GROUP BY rb, cb"""


def sampled_faces(spark, folder):
    from tarnfield.operators.blocks import face_id

    faces = frame(spark, folder).withColumns({"size": F.lit(1), "frow": F.col("row"), "fcol": F.col("col")})
    return sampling.face_sampling(faces.withColumn("face_id", face_id()), grid_of(spark, folder), 9)


@query("w3_first_per_bin", "frames frame_cells", FACE_BINS)
def w3(spark, folder):
    return sampled_faces(spark, folder).select("face_id", r6(F.col("speed"), "speed"))


@query(
    "g18_coverage_sampling",
    "frames frame_cells",
    FACE_BINS.replace(
        "SELECT arg_min(face_id, row(-speed, face_id)) AS face_id, round(max(speed), 6) AS speed FROM bins GROUP BY rb, cb",
        "SELECT rb AS rbin, cb AS cbin, 1::BIGINT AS faces FROM bins GROUP BY rb, cb",
    ),
)
def g18(spark, folder):
    grid = grid_of(spark, folder)
    best = sampled_faces(spark, folder)

    def bin_of(index, extent):
        return F.least(F.lit(2), F.floor((F.col(index) + 0.5) * 3 / extent).cast("int"))

    keys = [bin_of("frow", grid.height).alias("rbin"), bin_of("fcol", grid.width).alias("cbin")]
    return best.groupBy(*keys).agg(F.count(F.lit(1)).alias("faces"))


@query(
    "j13_frame_interpolation",
    "frames frame_cells",
    """, a AS (SELECT *, sqrt(u*u+v*v) AS s FROM frames JOIN frame_cells USING ("row", col) WHERE mask > 0 AND t = 7), b AS (SELECT *, sqrt(u*u+v*v) AS s FROM frames WHERE t = 8 AND u*u+v*v > 0)
       SELECT a."row", a.col, round(a.u + (coalesce(b.u, a.u) - a.u) * 0.25, 6) + 0.0 AS u, round(a.v + (coalesce(b.v, a.v) - a.v) * 0.25, 6) + 0.0 AS v,
         round(a.s + (coalesce(b.s, a.s) - a.s) * 0.25, 6) AS speed FROM a LEFT JOIN b ON a."row" = b."row" AND a.col = b.col
       WHERE a.h >= 0.01 AND a.s > 0""",
)
def j13(spark, folder):
    grid = grid_of(spark, folder)
    one, two = (
        sampling.arrow_lines(f.withColumns({"speed": F.sqrt(F.col("u") ** 2 + F.col("v") ** 2), "span_m": F.lit(4.0)}), grid)
        for f in (sampling.flowing(frame(spark, folder)), frame(spark, folder, 8))
    )
    mixed = sampling.interpolate_arrows(one, two, 0.25)
    return mixed.select("row", "col", r6(F.col("u"), "u"), r6(F.col("v"), "v"), r6(F.col("speed"), "speed"))


NODES = """, nodes AS (SELECT "row" * 15 + col AS node_id, col * 10.0 + ("row" * 15 + col) % 7 AS x, "row" * 10.0 + ("row" * 15 + col) % 5 AS y,
      u / sqrt(u*u+v*v) AS dx, v / sqrt(u*u+v*v) AS dy, sqrt(u*u+v*v) AS speed FROM frames WHERE t = 7 AND u*u+v*v > 0),
  nn AS (SELECT a.node_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM nodes a JOIN nodes b ON a.node_id <> b.node_id GROUP BY 1),
  sp AS (SELECT greatest(8.0, median(d)) AS s FROM nn) """


def flow_nodes(spark, folder):
    key = F.col("row") * 15 + F.col("col")
    s = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    return frame(spark, folder).filter(F.col("u") ** 2 + F.col("v") ** 2 > 0).select(
        key.alias("node_id"),
        (F.col("col") * 10.0 + key % 7).alias("x"),
        (F.col("row") * 10.0 + key % 5).alias("y"),
        (F.col("u") / s).alias("dx"),
        (F.col("v") / s).alias("dy"),
        s.alias("speed"),
    )


@query("j15_vector_spacing", "frames", NODES + "SELECT round(s, 6) AS spacing FROM sp")
def j15(spark, folder):
    return sampling.vector_spacing(flow_nodes(spark, folder)).select(F.round("spacing", 6).alias("spacing"))


@query(
    "j14_field_sampling",
    "frames points",
    NODES
    + """, q AS (SELECT point_id, (lon - 122) * 6 AS x, (lat - 24) * 5 AS y FROM points),
       cand AS (SELECT point_id, n.*, sqrt((q.x-n.x)*(q.x-n.x)+(q.y-n.y)*(q.y-n.y)) AS d FROM q JOIN nodes n ON true),
       k AS (SELECT cand.*, s, row_number() OVER (PARTITION BY point_id ORDER BY d, node_id) AS rn FROM cand, sp WHERE d <= 3 * s),
       w AS (SELECT *, 1 / (0.15 + (d / s) * (d / s)) AS w FROM k WHERE rn <= 8),
       a AS (SELECT point_id, sum(dx * w) AS sx, sum(dy * w) AS sy, sum(speed * w) / sum(w) AS sp FROM w GROUP BY 1)
       SELECT point_id, round(sx / sqrt(sx*sx+sy*sy), 6) + 0.0 AS dx, round(sy / sqrt(sx*sx+sy*sy), 6) + 0.0 AS dy, round(sp, 6) AS speed FROM a
       WHERE sqrt(sx*sx+sy*sy) > 1e-6""",
)
def j14(spark, folder):
    nodes = flow_nodes(spark, folder)
    points = A.points(spark, folder).select(
        "point_id", ((F.col("lon") - 122) * 6).alias("x"), ((F.col("lat") - 24) * 5).alias("y")
    )
    got = sampling.sample_field(points, nodes, sampling.vector_spacing(nodes))
    return got.select("point_id", r6(F.col("dx"), "dx"), r6(F.col("dy"), "dy"), r6(F.col("speed"), "speed"))


@query(
    "m9_phase_hash",
    "frame_cells",
    """SELECT "row", col, round(xor(("row" + 1) * 73856093::BIGINT & 4294967295, (col + 1) * 19349663::BIGINT & 4294967295) / 4294967296.0::DOUBLE, 9) AS phase
       FROM frame_cells""",
)
def m9(spark, folder):
    return A.frame_cells(spark, folder).select(
        "row", "col", F.round(phase_hash(F.col("row"), F.col("col")), 9).alias("phase")
    )


@query(
    "m9_elapsed_seconds",
    "",
    """SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER () AS elapsed_us, strftime(ts, '%Y%m%d %H%M%S') AS stamp FROM events""",
)
def m9_elapsed(spark, folder):
    events = A.table(spark, folder, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = events.agg(F.min("us")).first()[0]
    return events.select(
        "event_id", (F.col("us") - start).alias("elapsed_us"), F.date_format("ts", "yyyyMMdd HHmmss").alias("stamp")
    )


# --- time axis --------------------------------------------------------------------------------

TIMES = """WITH times AS (SELECT user_id AS run, rank() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t,
      CAST((epoch_us(ts) - 1704067200000000) // 1000000 AS DOUBLE) AS elapsed_s, event_id FROM events),
  span AS (SELECT run, max(elapsed_s) AS last_s FROM times GROUP BY 1),
  targets AS (SELECT run, k, k * 43200.0::DOUBLE AS target_s FROM span, LATERAL (SELECT unnest(range(0, CAST(floor((last_s + 0.5 - 1e-9) / 43200) AS INT) + 1)) AS k) x),
  near AS (SELECT g.run, g.k, g.target_s, arg_min(event_id, row(abs(elapsed_s - target_s), event_id)) AS t, min(abs(elapsed_s - target_s)) AS off_s
           FROM targets g LEFT JOIN times f ON f.run = g.run AND CAST(floor(elapsed_s / 43200) AS INT) IN (g.k, g.k - 1) GROUP BY 1, 2, 3) """


def event_times(spark, folder):
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    return A.table(spark, folder, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("t"), F.floor(us / 1000000).cast("double").alias("elapsed_s")
    )


@query("j18_nearest_in_time", "", TIMES + "SELECT run, CAST(k AS INT) AS k, target_s, t, off_s FROM near")
def j18(spark, folder):
    return timeline.nearest_frames(event_times(spark, folder), 43200, ["run"])


@query(
    "w9_selected_frames",
    "",
    TIMES
    + """, ok AS (SELECT * FROM near WHERE t IS NOT NULL AND off_s <= 432),
       runs AS (SELECT run, t, lag(t) OVER (PARTITION BY run ORDER BY k) AS p FROM ok),
       ends AS (SELECT run, arg_max(event_id, row(elapsed_s, event_id)) AS t, max(elapsed_s) AS e FROM times GROUP BY 1),
       cov AS (SELECT run, max(target_s) AS c FROM ok GROUP BY 1)
       SELECT run, t FROM runs WHERE p IS NULL OR p <> t
       UNION SELECT run, t FROM ends JOIN cov USING (run) WHERE e - c > 432""",
)
def w9(spark, folder):
    return timeline.selected_frames(event_times(spark, folder), 43200, ["run"], strict=False)


# --- elevation --------------------------------------------------------------------------------

MERGED = """, e2 AS (SELECT "row", col, CASE WHEN z < 200000 THEN source_id END AS source_id, CASE WHEN z < 200000 THEN z END AS z FROM elevation),
  best AS (SELECT "row", col, min(source_id) AS source_id, arg_min(z, source_id) AS z FROM e2 GROUP BY 1, 2) """


def merged(spark, folder):
    """Offers of 200 000 and more count as missing, so that lower priorities matter and some cells stay uncovered."""
    offers = A.elevation(spark, folder).withColumn("z", F.when(F.col("z") < 200000, F.col("z")))
    return elevation.coalesce_providers(offers)


@query("j5_priority_coalesce", "elevation", MERGED + 'SELECT "row", col, source_id, z FROM best')
def j5(spark, folder):
    return merged(spark, folder)


@query(
    "j6_first_source_wins",
    "elevation",
    """, e2 AS (SELECT "row", col, source_id, CASE WHEN z < 200000 THEN z END AS z FROM elevation)
       SELECT "row", col, min(CASE WHEN z IS NOT NULL THEN (source_id * 2) % 5 + 1 END) AS source_id,
         arg_min(z, CASE WHEN z IS NOT NULL THEN (source_id * 2) % 5 END) AS z FROM e2 GROUP BY 1, 2""",
)
def j6(spark, folder):
    offers = A.elevation(spark, folder).withColumn("z", F.when(F.col("z") < 200000, F.col("z")))
    order = [5, 3, 1, 4, 2]  # an order of its own, all sources
    return elevation.fill_holes(*[offers.filter(F.col("source_id") == k) for k in order])


@query(
    "a24_provider_counts",
    "elevation",
    MERGED
    + """, names AS (SELECT * FROM (VALUES (1, 'DEM1A'), (2, 'DEM5A'), (3, 'DEM5B'), (4, 'DEM5C'), (5, 'DEM10B')) n(source_id, provider))
       SELECT n.source_id, provider, count(b.z) AS cells FROM names n LEFT JOIN best b USING (source_id)
       WHERE n.source_id <= (SELECT max(source_id) FROM best) OR EXISTS (SELECT 1 FROM best WHERE z IS NULL) GROUP BY 1, 2""",
)
def a24(spark, folder):
    return elevation.provider_counts(merged(spark, folder))


@query(
    "s13_decode_rgb",
    "",
    """WITH px AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS g, l_suppkey % 256 AS b FROM lineitem),
       c AS (SELECT *, r * 65536 + g * 256 + b AS code FROM px)
       SELECT r, g, b, count(*) AS n, CASE WHEN code = 8388608 THEN NULL WHEN code > 8388608 THEN round((code - 16777216) * 0.01::DOUBLE, 2)
         ELSE round(code * 0.01::DOUBLE, 2) END AS z FROM c GROUP BY r, g, b, code""",
)
def s13(spark, folder):
    pixels = A.table(spark, folder, "lineitem").select(
        (F.col("l_partkey") % 256).alias("r"),
        (F.floor("l_extendedprice") % 256).alias("g"),
        (F.col("l_suppkey") % 256).alias("b"),
    )
    z = elevation.decode_rgb(F.col("r"), F.col("g"), F.col("b"))
    return pixels.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("z", F.round(z, 2))


@query(
    "s11_dem_text",
    "cells",
    """SELECT CAST("row" // 8 AS BIGINT) AS file_id, CAST((("row" % 8) * 50 + col + 3) // 50 AS INT) AS "row", CAST((("row" % 8) * 50 + col + 3) % 50 AS INT) AS col,
         CASE WHEN water THEN NULL ELSE round(elevation_m, 3) + 0.0 END AS z FROM cells WHERE ("row" % 8) * 50 + col + 3 < 400""",
)
def s11(spark, folder):
    cells = A.cells(spark, folder)
    value = F.format_string("%.3f", F.when(F.col("water"), -9999.0).otherwise(F.col("elevation_m")))
    at = F.col("row") % 8 * 50 + F.col("col")
    texts = cells.groupBy(A.int_div(F.col("row"), 8).alias("file_id")).agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), F.concat(F.lit("地表面,"), value).alias("line")))).alias("l")
    )
    body = F.concat_ws("\n", F.transform("l", lambda s: s["line"]))
    files = texts.select(
        "file_id",
        F.concat(
            F.lit("<gml:high>49 7</gml:high><gml:tupleList>\n"), body,
            F.lit("\n</gml:tupleList><gml:startPoint>3 0</gml:startPoint>"),
        ).alias("text"),
    )
    return elevation.parse_dem_text(files).withColumn("z", F.round("z", 3) + F.lit(0.0))


@query(
    "m4_bilinear_sampling",
    "cells",
    """, q AS (SELECT c_custkey AS target_id, c_custkey % 37 + c_custkey % 8 / 8.0::DOUBLE AS r, c_custkey % 48 + c_custkey % 5 / 5.0::DOUBLE AS c FROM customer),
       k AS (SELECT target_id, CAST(floor(r) AS INT) + dr AS "row", CAST(floor(c) AS INT) + dc AS col,
           (CASE WHEN dr = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN dc = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w
         FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)),
       j AS (SELECT target_id, w, CASE WHEN water THEN NULL ELSE elevation_m END AS z FROM k LEFT JOIN cells s ON s."row" = k."row" AND s.col = k.col WHERE w > 0)
       SELECT target_id, CASE WHEN count(z) = count(*) THEN round(sum(z * w), 6) + 0.0 END AS z FROM j GROUP BY 1""",
)
def m4(spark, folder):
    key = F.col("c_custkey")
    targets = A.table(spark, folder, "customer").select(
        key.alias("target_id"), (key % 37 + key % 8 / 8.0).alias("r"), (key % 48 + key % 5 / 5.0).alias("c")
    )
    cells = A.cells(spark, folder)
    source = cells.select("row", "col", F.when(~F.col("water"), F.col("elevation_m")).alias("z"))
    return elevation.bilinear(targets, source).select("target_id", r6(F.col("z"), "z"))


@query(
    "g6_seam_blend",
    "elevation",
    MERGED
    + """, n4 AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc)),
       s0 AS (SELECT "row", col, source_id, z AS z FROM best) """
    + "".join(
        f""", seam{k} AS (SELECT c."row", c.col, avg(CASE WHEN m.source_id = n.source_id THEN 2 * n.z - m.z ELSE n.z END - c.z) AS fix
             FROM s{k - 2} c JOIN s{k - 2} n ON abs(n."row" - c."row") + abs(n.col - c.col) = 1 AND n.source_id < {k}
             LEFT JOIN s{k - 2} m ON m."row" = 2 * n."row" - c."row" AND m.col = 2 * n.col - c.col
             WHERE c.source_id = {k} GROUP BY 1, 2),
       near{k} AS (SELECT c."row", c.col, arg_min(fix, row(pow(c."row" - m."row", 2) + pow(c.col - m.col, 2), m."row", m.col)) AS fix,
             min(sqrt(pow(c."row" - m."row", 2) + pow(c.col - m.col, 2))) AS d FROM s{k - 2} c JOIN seam{k} m
             ON pow(c."row" - m."row", 2) + pow(c.col - m.col, 2) <= 9 WHERE c.source_id = {k} GROUP BY 1, 2),
       s{k - 1} AS (SELECT c."row", c.col, c.source_id, c.z + coalesce(0.5 * (1 + cos(pi() * n.d / 3)) * n.fix, 0) AS z FROM s{k - 2} c
             LEFT JOIN near{k} n ON n."row" = c."row" AND n.col = c.col) """
        for k in range(2, 6)
    )
    + 'SELECT "row", col, source_id, round(z, 7) AS z FROM s4',
)
def g6(spark, folder):
    blended = elevation.blend_seams(merged(spark, folder), 3, 5, tile=24)
    return blended.select("row", "col", "source_id", F.round("z", 7).alias("z"))


# --- projection -------------------------------------------------------------------------------

@query(
    "m2_slippy_tiles",
    "points",
    """, c AS (SELECT point_id, lon, greatest(-85.05112878::DOUBLE, least(85.05112878::DOUBLE, lat * 2)) AS lat FROM points)
       SELECT point_id, CAST(floor((lon + 180) / 360 * 32768) AS INT) AS tx,
         CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768) AS INT) AS ty FROM c""",
)
def m2(spark, folder):
    return A.points(spark, folder).select(
        "point_id",
        F.floor(geo.tile_x(F.col("lon"), 15)).cast("int").alias("tx"),
        F.floor(geo.tile_y(F.col("lat") * 2, 15)).cast("int").alias("ty"),
    )


@query(
    "m2_tile_range",
    "points",
    """, b AS (SELECT point_id, lon, lat, lon + 0.03 AS east, lat + 0.02 AS north FROM points)
       SELECT point_id, CAST(floor((lon + 180) / 360 * 16384) AS INT) - 1 AS x0, CAST(floor((east + 180) / 360 * 16384) AS INT) + 1 AS x1,
         CAST(floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * 16384) AS INT) - 1 AS y0,
         CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS INT) + 1 AS y1 FROM b""",
)
def m2_range(spark, folder):
    lon, lat = F.col("lon"), F.col("lat")
    box = geo.tile_range(lon, lat, lon + 0.03, lat + 0.02, 14)
    return A.points(spark, folder).select("point_id", *[c.alias(n) for n, c in box.items()])


@query(
    "m3_projection_round_trip",
    "points",
    "SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points",
)
def m3(spark, folder):
    """Offsets of a few km around each point, projected and back."""
    lon, lat = F.col("lon"), F.col("lat")
    centre = (lon + (F.col("point_id") % 9 - 4) / 100.0, lat + (F.col("point_id") % 7 - 3) / 100.0)
    x, y = geo.to_local(lon, lat, *centre)
    there = A.points(spark, folder).select("point_id", centre[0].alias("lon0"), centre[1].alias("lat0"), x.alias("x"), y.alias("y"))
    back = geo.to_lonlat(F.col("x"), F.col("y"), F.col("lon0"), F.col("lat0"))
    return there.select("point_id", r6(back[0], "lon"), r6(back[1], "lat"))


LOCAL_SQL = """
  ell AS (SELECT 6378137.0::DOUBLE AS a, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2, radians(35.0::DOUBLE) AS p1),
  q1 AS (SELECT c.*, a, e2, p1, radians(lat) AS phi, radians(lon - 139.0) AS dl, a / sqrt(1 - e2 * pow(sin(p1), 2)) AS n1,
           a / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) AS n FROM corner c, ell),
  q2 AS (SELECT *, atan((1 - e2) * tan(phi) + e2 * n1 * sin(p1) / (n * cos(phi))) AS psi FROM q1),
  q3 AS (SELECT *, atan2(sin(dl), cos(p1) * tan(psi) - sin(p1) * cos(dl)) AS az,
           2 * asin(sqrt(pow(sin((psi - p1) / 2), 2) + cos(p1) * cos(psi) * pow(sin(dl / 2), 2))) AS s FROM q2),
  q4 AS (SELECT *, sqrt(e2 / (1 - e2)) * sin(p1) AS g, sqrt(e2 / (1 - e2)) * cos(p1) * cos(az) AS h FROM q3),
  q5 AS (SELECT *, n1 * s * (1 - s*s*h*h*(1-h*h)/6 + s*s*s/8*g*h*(1-2*h*h) + s*s*s*s/120*(h*h*(4-7*h*h) - 3*g*g*(1-7*h*h)) - s*s*s*s*s/48*g*h) AS c FROM q4),
  local AS (SELECT *, c * sin(az) AS x, c * cos(az) AS y FROM q5) """


@query(
    "p12_viewport_box",
    "points",
    """, v AS (SELECT point_id, 139.0 - 0.01 + point_id % 100 / 10000.0::DOUBLE AS w, 35.0 - 0.008 + point_id % 70 / 10000.0::DOUBLE AS s FROM points),
       corner AS (SELECT point_id, w + i * 0.004 AS lon, s + j * 0.003 AS lat FROM v, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),"""
    + LOCAL_SQL
    + """SELECT point_id, CAST(greatest(0, least(2000, floor(min(y) + 1000))) AS INT) AS row0, CAST(greatest(0, least(2000, ceil(max(y) + 1000))) AS INT) AS row1,
         CAST(greatest(0, least(3000, floor(min(x) + 1500))) AS INT) AS col0, CAST(greatest(0, least(3000, ceil(max(x) + 1500))) AS INT) AS col1
         FROM local GROUP BY 1""",
)
def p12(spark, folder):
    grid = GridSpec(3000, 2000, lon0=139.0, lat0=35.0)
    west = F.lit(139.0) - 0.01 + F.col("point_id") % 100 / 10000.0
    south = F.lit(35.0) - 0.008 + F.col("point_id") % 70 / 10000.0
    views = A.points(spark, folder).select(
        "point_id", west.alias("west"), south.alias("south"), (west + 0.004).alias("east"), (south + 0.003).alias("north")
    )
    return geo.viewport_cells(views, grid).select("point_id", "row0", "row1", "col0", "col1")


@query(
    "m3_local_metres",
    "points",
    ", corner AS (SELECT point_id, 139 + (lon - 134) / 500 AS lon, 35 + (lat - 34) / 500 AS lat FROM points),"
    + LOCAL_SQL
    + "SELECT point_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM local",
)
def m3_local(spark, folder):
    x, y = geo.to_local(139 + (F.col("lon") - 134) / 500, 35 + (F.col("lat") - 34) / 500, 139.0, 35.0)
    return A.points(spark, folder).select(
        "point_id", (F.round(x, 4) + F.lit(0.0)).alias("x"), (F.round(y, 4) + F.lit(0.0)).alias("y")
    )
