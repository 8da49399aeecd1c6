"""Neighbourhoods, components, terrain blocks and the multi-resolution map."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators import blocks, components, envelope, policy
from tarnfield.operators.grid import GridSpec, disc_offsets
from tarnfield.plans import adapters as A
from tarnfield.plans.cube_queries import r6
from tarnfield.plans.registry import query
from tarnfield.runtime import cut_lineage

NEAR4 = "(abs(n.\"row\" - c.\"row\") + abs(n.col - c.col) = 1)"
NEAR8 = "(abs(n.\"row\" - c.\"row\") <= 1 AND abs(n.col - c.col) <= 1 AND NOT (n.\"row\" = c.\"row\" AND n.col = c.col))"


# --- corner products and surface rules ---------------------------------------------------------

CORNERS = """, centres AS (
    SELECT "row", col, CASE WHEN count(z) = 4 THEN avg(z) END AS z, bool_and(uncovered) AS uncovered FROM (
      SELECT "row" - dr AS "row", col - dc AS col, CASE WHEN water THEN NULL ELSE elevation_m END AS z, water OR building AS uncovered
      FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)) GROUP BY 1, 2 HAVING count(*) = 4) """


def corner_product(spark, folder):
    return A.cells(spark, folder).select(
        "row",
        "col",
        F.when(~F.col("water"), F.col("elevation_m")).alias("z"),
        (F.col("water") | F.col("building")).alias("uncovered"),
    )


@query("p8_elevation_to_centres", "cells", CORNERS + 'SELECT "row", col, round(z, 6) + 0.0 AS z FROM centres')
def p8(spark, folder):
    centres = policy.corners_to_centres(corner_product(spark, folder))
    return centres.select("row", "col", r6(F.col("z"), "z"))


@query("p9_uncovered_to_centres", "cells", CORNERS + 'SELECT "row", col, uncovered FROM centres')
def p9(spark, folder):
    return policy.corners_to_centres(corner_product(spark, folder)).select("row", "col", "uncovered")


LAND = """, e AS (SELECT max("row") AS hh, max(col) AS ww FROM cells),
  s AS (SELECT "row", col, building AND NOT water AS b, road, water FROM cells),
  flags AS (SELECT c.*, coalesce(bool_or(n.b), false) AS beside_b,
              coalesce(bool_or(n.water AND abs(n."row" - c."row") + abs(n.col - c.col) = 1), false) AS beside_w
            FROM s c LEFT JOIN s n ON abs(n."row" - c."row") <= 1 AND abs(n.col - c.col) <= 1
              AND NOT (n."row" = c."row" AND n.col = c.col)
            GROUP BY ALL) """


def surface(spark, folder):
    cells = A.cells(spark, folder).withColumn("building", F.col("building") & ~F.col("water"))
    return policy.surface_rules(cells)


@query(
    "p10_roughness",
    "cells",
    LAND
    + """SELECT "row", col, CASE WHEN beside_b AND NOT b AND NOT water THEN 0.06::DOUBLE WHEN road AND NOT b THEN 0.03::DOUBLE
         ELSE 0.05::DOUBLE END AS manning_n FROM flags""",
)
def p10(spark, folder):
    return surface(spark, folder).select("row", "col", policy.roughness().alias("manning_n"))


@query(
    "p11_hydraulic_mask",
    "cells",
    LAND
    + """SELECT "row", col, CASE WHEN water OR b THEN 0 WHEN "row" IN (0, hh) OR col IN (0, ww) THEN 1
         WHEN beside_w THEN 3 ELSE 1 END AS mask FROM flags, e""",
)
def p11(spark, folder):
    grid = GridSpec.measure(A.cells(spark, folder))
    return surface(spark, folder).select("row", "col", policy.hydraulic_mask(grid).alias("mask"))


@query(
    "j16_land_filters",
    "cells",
    """, b AS (SELECT "row", col FROM cells WHERE building), w AS (SELECT "row", col FROM cells WHERE water)
       SELECT "row", col FROM b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w."row" = b."row" AND w.col = b.col)""",
)
def j16(spark, folder):
    cells = A.cells(spark, folder)
    return cells.filter("building").join(cells.filter("water"), ["row", "col"], "left_anti").select("row", "col")


@query(
    "g1_neighbour_counts",
    "cells",
    f"""SELECT c."row", c.col, count_if(n.building) AS beside, count_if(n.building AND {NEAR4}) AS facing
        FROM cells c JOIN cells n ON {NEAR8} GROUP BY 1, 2""",
)
def g1(spark, folder):
    from tarnfield.operators.grid import others, stencil

    facing = F.col("building") & ((F.col("dr") == 0) | (F.col("dc") == 0))
    return stencil(
        A.cells(spark, folder),
        [
            others(F.count_if, F.col("building")).alias("beside"),
            others(F.count_if, facing).alias("facing"),
        ],
        ["building"],
        eight=True,
    )


@query(
    "g1_zone_boundary",
    "scene",
    f"""SELECT c."row", c.col, bool_or(n.building <> c.building) AS boundary FROM scene c JOIN scene n ON {NEAR4} GROUP BY 1, 2""",
)
def g1_zone(spark, folder):
    return blocks.zone_boundary(A.scene(spark, folder), "building")


@query(
    "w6_second_differences",
    "cells",
    """SELECT "row", col, round(lag(elevation_m) OVER r - 2 * elevation_m + lead(elevation_m) OVER r, 6) + 0.0 AS east_west,
         round(lag(elevation_m) OVER c - 2 * elevation_m + lead(elevation_m) OVER c, 6) + 0.0 AS north_south FROM cells
       WINDOW r AS (PARTITION BY "row" ORDER BY col), c AS (PARTITION BY col ORDER BY "row")""",
)
def w6(spark, folder):
    from tarnfield.operators.grid import at, stencil

    z = "elevation_m"
    seen = stencil(
        A.cells(spark, folder),
        [at(0, 0, z).alias("c"), at(0, -1, z).alias("w"), at(0, 1, z).alias("e"), at(-1, 0, z).alias("s"), at(1, 0, z).alias("n")],
        [z],
    )
    return seen.select(
        "row",
        "col",
        r6(F.col("w") - 2 * F.col("c") + F.col("e"), "east_west"),
        r6(F.col("s") - 2 * F.col("c") + F.col("n"), "north_south"),
    )


# --- components -------------------------------------------------------------------------------

def reach_sql(source: str, condition: str) -> str:
    """Smallest row-major index reachable over 8-neighbours, by plain recursion."""
    return f""", mask AS (SELECT "row", col, "row" * (SELECT max(col) + 1 FROM {source}) + col AS id FROM {source} WHERE {condition}),
      reach AS (SELECT id, "row", col, id AS root FROM mask
        UNION SELECT n.id, n."row", n.col, r.root FROM reach r JOIN mask n
          ON abs(n."row" - r."row") <= 1 AND abs(n.col - r.col) <= 1),
      labelled AS (SELECT id, "row", col, min(root) AS label FROM reach GROUP BY ALL) """


@query("g2_components", "cells", reach_sql("cells", "building") + 'SELECT "row", col, CAST(label AS BIGINT) AS label FROM labelled')
def g2(spark, folder):
    cells = A.cells(spark, folder)
    return components.components(cells.filter("building"), GridSpec.measure(cells), tile=32)


@query(
    "g2_component_sizes",
    "cells",
    reach_sql("cells", "building")
    + """SELECT CAST(label AS BIGINT) AS label, count(*) AS cells, min("row") AS row0, max("row") AS row1, min(col) AS col0, max(col) AS col1
         FROM labelled GROUP BY 1""",
)
def g2_sizes(spark, folder):
    cells = A.cells(spark, folder)
    return components.component_report(components.components(cells.filter("building"), GridSpec.measure(cells)))


def gappy(spark, folder):
    cells = A.cells(spark, folder)
    return cells.select("row", "col", F.when(~F.col("water"), F.col("elevation_m")).alias("z"))


GAPS = reach_sql("cells", "water") + """, e AS (SELECT max("row") AS hh, max(col) AS ww FROM cells),
  coast AS (SELECT label, bool_or("row" IN (0, hh) OR col IN (0, ww)) AS coastal FROM labelled, e GROUP BY 1) """


@query("g4_coastal_gaps", "cells", GAPS + 'SELECT "row", col, coastal FROM labelled JOIN coast USING (label)')
def g4(spark, folder):
    cells = gappy(spark, folder)
    return components.coastal_gaps(cells, GridSpec.measure(cells), tile=16)


@query(
    "a24_gap_report",
    "cells",
    GAPS
    + """, g AS (SELECT c."row", c.col, water, coastal FROM cells c LEFT JOIN labelled l ON l."row" = c."row" AND l.col = c.col
                 LEFT JOIN coast k ON k.label = l.label)
       SELECT count(*) AS n, count_if(water) AS missing, count_if(coastal) AS coastal, count_if(NOT coastal) AS interior,
         count_if(water) / count(*) AS missing_fraction, count_if(NOT coastal) / count(*) AS interior_fraction,
         count_if(coastal) / count(*) AS coastal_fraction, count_if(NOT coastal) / count(*) <= 0.02 AS covered FROM g""",
)
def a24_gaps(spark, folder):
    cells = gappy(spark, folder)
    return components.gap_report(cells, components.coastal_gaps(cells, GridSpec.measure(cells)))


@query(
    "g5_nearest_fill",
    "cells",
    """, best AS (SELECT m."row", m.col, arg_min(v.elevation_m, row(pow(m."row" - v."row", 2) + pow(m.col - v.col, 2), v."row", v.col)) AS z
         FROM cells m, cells v WHERE m.water AND NOT v.water GROUP BY 1, 2)
       SELECT "row", col, round(z, 6) + 0.0 AS z, true AS filled FROM best
       UNION ALL SELECT "row", col, round(elevation_m, 6) + 0.0, false FROM cells WHERE NOT water""",
)
def g5(spark, folder):
    return envelope.fill_nearest(gappy(spark, folder), tile=16, strip=16).select("row", "col", r6(F.col("z"), "z"), "filled")


RINGS = reach_sql("cells", "building") + """, roofs AS (SELECT label, count(*) AS roof FROM labelled GROUP BY 1),
  near AS (SELECT l.label, g."row", g.col, min(greatest(abs(l."row" - g."row"), abs(l.col - g.col))) AS d
           FROM labelled l JOIN cells g ON NOT g.building AND abs(l."row" - g."row") <= 5 AND abs(l.col - g.col) <= 5 GROUP BY 1, 2, 3),
  first_ring AS (SELECT label, min(d) AS d FROM near GROUP BY 1),
  served AS (SELECT n.label, n."row", n.col FROM near n JOIN first_ring f ON n.label = f.label AND n.d = f.d) """

G3_WEIGHTS = RINGS + """, share AS (SELECT r.label, r.roof * 1.0::DOUBLE / count(*) AS s FROM roofs r JOIN served USING (label) GROUP BY r.label, r.roof),
  extra AS (SELECT "row", col, sum(s) AS extra FROM served JOIN share USING (label) GROUP BY 1, 2),
  weights AS (SELECT c."row", c.col, building, CASE WHEN building THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END + coalesce(extra, 0) AS w
              FROM cells c LEFT JOIN extra x ON x."row" = c."row" AND x.col = c.col) """


@query(
    "j12_ring_recipients",
    "cells",
    RINGS + 'SELECT CAST(label AS BIGINT) AS label, "row", col FROM served',
)
def j12(spark, folder):
    cells = A.cells(spark, folder)
    labelled = cut_lineage(components.components(cells.filter("building"), GridSpec.measure(cells), tile=8))
    return components.roof_recipients(labelled, cells.filter("NOT building"), tile=8)


@query("g3_roof_rain", "cells", G3_WEIGHTS + 'SELECT "row", col, round(w, 6) AS rain_weight FROM weights')
def g3(spark, folder):
    cells = A.cells(spark, folder).withColumn("active", F.lit(True))
    weights = components.allocate_roof_rain(cells, GridSpec.measure(cells), tile=16)
    return weights.select("row", "col", r6(F.col("rain_weight"), "rain_weight"))


@query(
    "a21_mass_balance",
    "cells",
    G3_WEIGHTS
    + """SELECT count(*) * 1.0::DOUBLE AS active_area, round(sum(w), 6) AS weighted_area, abs(sum(w) - count(*)) / count(*) <= 1e-9 AS conserved
         FROM weights""",
)
def a21(spark, folder):
    cells = A.cells(spark, folder).withColumn("active", F.lit(True))
    balance = components.mass_balance(components.allocate_roof_rain(cells, GridSpec.measure(cells)))
    return balance.select("active_area", r6(F.col("weighted_area"), "weighted_area"), "conserved")


@query(
    "a22_perimeter_rain",
    "cells",
    reach_sql("cells", "building")
    + f""", edges AS (SELECT c.label, n."row", n.col FROM labelled c JOIN cells n ON NOT n.building AND {NEAR4}),
       share AS (SELECT label, (SELECT count(*) FROM labelled l WHERE l.label = edges.label) * 1.0::DOUBLE / count(*) AS s FROM edges GROUP BY 1),
       extra AS (SELECT "row", col, sum(s) AS extra FROM edges JOIN share USING (label) GROUP BY 1, 2)
       SELECT c."row", c.col, round(CASE WHEN building THEN 0.0 ELSE 1.0 END + coalesce(extra, 0), 6) AS rain_weight
       FROM cells c LEFT JOIN extra x ON x."row" = c."row" AND x.col = c.col""",
)
def a22(spark, folder):
    cells = A.cells(spark, folder)
    weights = components.perimeter_roof_rain(cells, GridSpec.measure(cells), tile=16)
    return weights.select("row", "col", r6(F.col("rain_weight"), "rain_weight"))


@query(
    "g17_flow_accumulation",
    "cells",
    f""", ptr AS (SELECT c."row" * 50 + c.col AS id, arg_min(n."row" * 50 + n.col, row(n.elevation_m, n."row", n.col))
                  FILTER (n.elevation_m < c.elevation_m) AS nxt FROM cells c JOIN cells n ON {NEAR8} GROUP BY 1),
       path AS (SELECT id AS src, id AS here FROM ptr UNION ALL SELECT src, nxt FROM path JOIN ptr ON here = id WHERE nxt IS NOT NULL)
       SELECT CAST(here // 50 AS INT) AS "row", CAST(here % 50 AS INT) AS col, count(*) AS acc FROM path GROUP BY here""",
)
def g17(spark, folder):
    return components.accumulate_flow(components.downstream(A.cells(spark, folder)), 50, tile=8)


@query(
    "g17_block_concentration",
    "cells",
    f""", full8 AS (SELECT "row" // 8 AS br, col // 8 AS bc FROM cells GROUP BY 1, 2 HAVING count(*) = 64),
       ptr AS (SELECT c."row" * 50 + c.col AS id, c."row" // 8 AS br, c.col // 8 AS bc,
                 arg_min(n."row" * 50 + n.col, row(n.elevation_m, n."row", n.col)) FILTER (n.elevation_m < c.elevation_m) AS nxt
               FROM cells c JOIN cells n ON {NEAR8} AND n."row" // 8 = c."row" // 8 AND n.col // 8 = c.col // 8 GROUP BY 1, 2, 3),
       path AS (SELECT id AS src, id AS here, br, bc FROM ptr
                UNION ALL SELECT src, ptr.nxt, path.br, path.bc FROM path JOIN ptr ON here = id WHERE ptr.nxt IS NOT NULL),
       acc AS (SELECT br, bc, here, count(*) AS n FROM path GROUP BY ALL)
       SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, max(n) / 64 AS concentration FROM acc JOIN full8 USING (br, bc) GROUP BY 1, 2""",
)
def g17_block(spark, folder):
    return blocks.flow_concentration(A.cells(spark, folder), 8)


# --- block evidence ---------------------------------------------------------------------------

def metrics_sql(src: str, s: int) -> str:
    """Plane-fit evidence per complete block of ``src``, written with windows and joins."""
    half, spread = (s - 1) / 2, s * sum((i - (s - 1) / 2) ** 2 for i in range(s))
    return f""", b{s} AS (SELECT "row", col, "row" // {s} AS br, col // {s} AS bc, "row" % {s} - {half}::DOUBLE AS y,
            col % {s} - {half}::DOUBLE AS x, elevation_m AS z FROM {src}),
      m{s} AS (SELECT br, bc, avg(z) AS zm, sum(x * z) / {spread} AS sx, sum(y * z) / {spread} AS sy, max(z) - min(z) AS rng,
            stddev_pop(z) AS sd FROM b{s} GROUP BY 1, 2 HAVING count(*) = {s * s}),
      r{s} AS (SELECT br, bc, rng, sd, z - zm - sx * x - sy * y AS r FROM b{s} JOIN m{s} USING (br, bc)),
      f{s} AS (SELECT br, bc, max(rng) AS rng, max(sd) AS sd, sqrt(avg(r * r)) AS rmse, max(abs(r)) AS mx, max(r) - min(r) AS relief
            FROM r{s} GROUP BY 1, 2),
      d{s} AS (SELECT br, bc, z - 2 * lag(z) OVER (PARTITION BY br, bc, "row" ORDER BY col)
              + lag(z, 2) OVER (PARTITION BY br, bc, "row" ORDER BY col) AS d FROM b{s}
            UNION ALL SELECT br, bc, z - 2 * lag(z) OVER (PARTITION BY br, bc, col ORDER BY "row")
              + lag(z, 2) OVER (PARTITION BY br, bc, col ORDER BY "row") FROM b{s}),
      k{s} AS (SELECT br, bc, sqrt(avg(d * d)) AS curv FROM d{s} WHERE d IS NOT NULL GROUP BY 1, 2),
      x{s} AS (SELECT c.br, c.bc, c."row", c.col, min(n.z) > c.z OR max(n.z) < c.z AS ext FROM b{s} c JOIN b{s} n ON {NEAR8}
            WHERE c."row" % {s} BETWEEN 1 AND {s - 2} AND c.col % {s} BETWEEN 1 AND {s - 2} GROUP BY c.br, c.bc, c."row", c.col, c.z),
      n{s} AS (SELECT br, bc, bool_or(ext) AS conn FROM x{s} GROUP BY 1, 2),
      metrics{s} AS (SELECT f.br, f.bc, rng, sd, rmse, mx, relief, coalesce(curv, 0) AS curv, coalesce(conn, false) AS conn
            FROM f{s} f LEFT JOIN k{s} k ON k.br = f.br AND k.bc = f.bc LEFT JOIN n{s} n ON n.br = f.br AND n.bc = f.bc) """


def safe_sql(s: int) -> str:
    a, b, c, d = config.BLOCK_LIMITS[s]
    return f"(rmse <= {a} AND mx <= {b} AND curv <= {c} AND relief <= {d} AND NOT (conn AND relief >= 0.05))"


@query(
    "a17_plane_fit",
    "cells",
    metrics_sql("cells", 4)
    + """SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, round(rmse, 6) AS rmse, round(mx, 6) AS max_abs_residual,
         round(rng, 6) AS elevation_range, round(sd, 6) AS elevation_std, round(relief, 6) AS relief FROM metrics4""",
)
def a17(spark, folder):
    names = ("rmse", "max_abs_residual", "elevation_range", "elevation_std", "relief")
    return blocks.block_metrics(A.cells(spark, folder), 4).select("brow", "bcol", *[r6(F.col(n), n) for n in names])


@query(
    "a18_curvature",
    "cells",
    metrics_sql("cells", 4) + "SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, round(curv, 6) AS curvature FROM metrics4",
)
def a18(spark, folder):
    return blocks.block_metrics(A.cells(spark, folder), 4).select("brow", "bcol", r6(F.col("curvature"), "curvature"))


@query(
    "a19_connectivity",
    "cells",
    metrics_sql("cells", 8) + "SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, conn AS connectivity FROM metrics8",
)
def a19(spark, folder):
    return blocks.block_metrics(A.cells(spark, folder), 8).select("brow", "bcol", "connectivity")


@query(
    "a20_block_safety",
    "cells",
    metrics_sql("cells", 4) + f"SELECT CAST(br AS INT) AS brow, CAST(bc AS INT) AS bcol, {safe_sql(4)} AS safe FROM metrics4",
)
def a20(spark, folder):
    metrics = blocks.block_metrics(A.cells(spark, folder), 4)
    return blocks.safe_blocks(metrics, 4).select("brow", "bcol", "safe")


STRUCTURE = f""", around AS (SELECT c."row", c.col, c.elevation_m AS z, min(n.elevation_m) AS low, max(n.elevation_m) AS high,
      max(abs(n.elevation_m - c.elevation_m)) AS delta,
      max(CASE WHEN n."row" = c."row" AND n.col = c.col - 1 THEN n.elevation_m END) AS w,
      max(CASE WHEN n."row" = c."row" AND n.col = c.col + 1 THEN n.elevation_m END) AS e,
      max(CASE WHEN n.col = c.col AND n."row" = c."row" - 1 THEN n.elevation_m END) AS s,
      max(CASE WHEN n.col = c.col AND n."row" = c."row" + 1 THEN n.elevation_m END) AS n
    FROM scene c JOIN scene n ON {NEAR8} GROUP BY c."row", c.col, c.elevation_m),
  ext AS (SELECT max("row") AS hh, max(col) AS ww FROM scene),
  structures AS (SELECT "row", col, "row" NOT IN (0, hh) AND col NOT IN (0, ww) AND
      (greatest(abs(w - 2 * z + e), abs(n - 2 * z + s)) >= 0.05 OR ((z < low OR z > high) AND delta >= 0.05)) AS structure FROM around, ext) """


@query("g11_structure_mask", "scene", STRUCTURE + 'SELECT "row", col, coalesce(structure, false) AS structure FROM structures')
def g11(spark, folder):
    cells = A.scene(spark, folder)
    return blocks.structure_mask(cells, GridSpec.measure(cells))


def near_sql(features: str, reach: int, distance: float) -> str:
    """Cells of the scene within a footprint distance of the feature cells."""
    steps = ", ".join(f"({r}, {c})" for r, c in disc_offsets(distance, 1.0, 1.0))
    return f'SELECT DISTINCT f."row" + dr AS "row", f.col + dc AS col FROM {features} f, (VALUES {steps}) o(dr, dc)'


@query(
    "j11_metric_buffer",
    "scene",
    """, f AS (SELECT "row", col FROM scene WHERE road OR native)
       SELECT c."row", c.col, EXISTS (SELECT 1 FROM f WHERE sqrt(pow(greatest(abs(f."row" - c."row") - 1, 0), 2)
         + pow(greatest(abs(f.col - c.col) - 1, 0), 2)) <= 6 + 1e-12) AS near FROM scene c""",
)
def j11(spark, folder):
    cells = A.scene(spark, folder).withColumn("feature", F.col("road") | F.col("native"))
    return blocks.within_distance(cells, "feature", 6.0, GridSpec.measure(cells), tile=32)


CEILING = (
    STRUCTURE
    + f""", bedge AS (SELECT c."row", c.col FROM scene c JOIN scene n ON {NEAR4} WHERE c.building AND NOT n.building GROUP BY 1, 2),
  interior AS (SELECT "row", col FROM scene WHERE building AND mask = 0 EXCEPT SELECT "row", col FROM bedge),
  direct AS (SELECT "row", col FROM scene WHERE building OR road OR native),
  st AS (SELECT "row", col FROM structures WHERE structure EXCEPT SELECT "row", col FROM interior),
  near_direct AS ({near_sql("direct", 4, 2.0)}), t_in AS ({near_sql("st", 4, 2.0)}), t_out AS ({near_sql("st", 8, 6.0)}),
  flags AS (SELECT c.*, nd."row" IS NOT NULL AND d."row" IS NULL AS nd, be."row" IS NOT NULL AS be, i."row" IS NOT NULL AS interior,
      st."row" IS NOT NULL AS st, ti."row" IS NOT NULL AND i."row" IS NULL AS ti, tout."row" IS NOT NULL AND i."row" IS NULL AS tout,
      sqrt(pow(c.col + 0.5 - (ww + 1) / 2.0, 2) + pow(c."row" + 0.5 - (hh + 1) / 2.0, 2)) AS radius
    FROM scene c CROSS JOIN ext LEFT JOIN near_direct nd ON nd."row" = c."row" AND nd.col = c.col
      LEFT JOIN direct d ON d."row" = c."row" AND d.col = c.col LEFT JOIN bedge be ON be."row" = c."row" AND be.col = c.col
      LEFT JOIN interior i ON i."row" = c."row" AND i.col = c.col LEFT JOIN st ON st."row" = c."row" AND st.col = c.col
      LEFT JOIN t_in ti ON ti."row" = c."row" AND ti.col = c.col LEFT JOIN t_out tout ON tout."row" = c."row" AND tout.col = c.col),
  ceil1 AS (SELECT *, CASE WHEN native OR road OR be OR st OR radius <= 2.5 THEN 1 WHEN nd OR ti OR radius <= 5.5 THEN 2 WHEN tout THEN 4 ELSE 8 END
      AS ceiling_m,
      CASE WHEN native THEN 'native_structure' WHEN road THEN 'road' WHEN be THEN 'building_boundary' WHEN st THEN 'terrain_structure'
           WHEN radius <= 2.5 THEN 'target_core' WHEN nd THEN 'near_hard_structure' WHEN ti THEN 'terrain_near' WHEN radius <= 5.5 THEN 'target_mid'
           WHEN tout THEN 'terrain_buffer' ELSE 'terrain_pending' END AS reason FROM flags) """
)


def ceiling_map(spark, folder):
    cells = A.scene(spark, folder)
    return blocks.ceilings(cells, GridSpec.measure(cells), core_m=2.5, mid_m=5.5)


@query("g12_ceilings", "scene", CEILING + 'SELECT "row", col, ceiling_m, reason FROM ceil1')
def g12(spark, folder):
    return ceiling_map(spark, folder).select("row", "col", "ceiling_m", "reason")


def coarsen_sql() -> str:
    """One level after the other: complete child blocks, ceiling, one zone, then safety."""
    sql = ', res1 AS (SELECT "row", col, elevation_m, zone, ceiling_m, reason, interior, 1 AS res FROM ceil1) '
    for s in config.LEVELS_M[1:]:
        h = s // 2
        sql += metrics_sql("res1", s)
        sql += f""", e{s} AS (SELECT "row" // {s} AS br, col // {s} AS bc, bool_and(interior) AS inner_all FROM res{h} GROUP BY 1, 2
            HAVING count(*) = {s * s} AND min(res) = {h} AND max(res) = {h} AND min(ceiling_m) >= {s} AND min(zone) = max(zone)),
          ok{s} AS (SELECT e.br, e.bc FROM e{s} e JOIN metrics{s} m ON e.br = m.br AND e.bc = m.bc WHERE inner_all OR {safe_sql(s)}),
          res{s} AS (SELECT r."row", r.col, elevation_m, zone, ceiling_m, interior, CASE WHEN o.br IS NULL THEN res ELSE {s} END AS res,
              CASE WHEN o.br IS NULL THEN reason ELSE 'terrain_coarsened' END AS reason
            FROM res{h} r LEFT JOIN ok{s} o ON o.br = r."row" // {s} AND o.bc = r.col // {s}) """
    return sql


def balance_sql(rounds: int = 8) -> str:
    """Halve every too-coarse block once per round; extra rounds change nothing."""
    sql = ', bal0 AS (SELECT "row", col, res AS start, res, reason, ceiling_m, zone FROM res8) '
    for k in range(rounds):
        sql += f""", hit{k} AS (SELECT DISTINCT c.res, c."row" // c.res AS br, c.col // c.res AS bc FROM bal{k} c JOIN bal{k} n ON {NEAR4}
              WHERE c.res > 2 * n.res),
          bal{k + 1} AS (SELECT b."row", b.col, start, CASE WHEN h.br IS NULL THEN b.res ELSE b.res // 2 END AS res, reason, ceiling_m, zone
            FROM bal{k} b LEFT JOIN hit{k} h ON h.res = b.res AND h.br = b."row" // b.res AND h.bc = b.col // b.res) """
    return sql + f""", final AS (SELECT "row", col, CAST(res AS INT) AS resolution_m, ceiling_m, zone,
        CASE WHEN res <> start THEN 'balanced_transition' ELSE reason END AS reason FROM bal{rounds}) """


def coarse_map(spark, folder):
    return blocks.coarsen(ceiling_map(spark, folder))


def final_map(spark, folder):
    return blocks.balance(coarse_map(spark, folder))


@query("g13_coarsening", "scene", CEILING + coarsen_sql() + 'SELECT "row", col, CAST(res AS INT) AS resolution_m, reason FROM res8')
def g13(spark, folder):
    return coarse_map(spark, folder).select("row", "col", "resolution_m", "reason")


FINAL = CEILING + coarsen_sql() + balance_sql()


@query("g14_two_to_one_balance", "scene", FINAL + 'SELECT "row", col, resolution_m, reason FROM final')
def g14(spark, folder):
    return final_map(spark, folder).select("row", "col", "resolution_m", "reason")


@query(
    "g14_two_grids",
    "scene",
    FINAL + 'SELECT grid_id, "row", col, resolution_m, reason FROM final, (VALUES (0), (1)) g(grid_id)',
)
def g14_grids(spark, folder):
    """Two grids over the same rows and columns in one table; each is mapped by itself."""
    cells = A.scene(spark, folder)
    grid, by = GridSpec.measure(cells), ("grid_id",)
    both = cells.withColumn("grid_id", F.explode(F.array(F.lit(0), F.lit(1))))
    limited = blocks.ceilings(both, grid, core_m=2.5, mid_m=5.5, tile=32, by=by)
    final = blocks.balance(blocks.coarsen(limited, tile=32, by=by), tile=32, by=by)
    return final.select("grid_id", "row", "col", "resolution_m", "reason")


@query(
    "g15_face_table",
    "scene",
    FINAL
    + """SELECT resolution_m AS size, CAST("row" // resolution_m AS INT) AS frow, CAST(col // resolution_m AS INT) AS fcol,
         count(*) * 1.0::DOUBLE AS overlap_m2, resolution_m || ':' || ("row" // resolution_m) || ':' || (col // resolution_m) AS face_id
         FROM final GROUP BY ALL""",
)
def g15(spark, folder):
    return blocks.faces(final_map(spark, folder))


@query(
    "g15_map_violations",
    "scene",
    FINAL
    + f""", broken AS (SELECT f."row", f.col, CASE WHEN (f."row" * 50 + f.col) % 97 = 0 THEN 3 WHEN (f."row" * 50 + f.col) % 41 = 0 THEN 8 ELSE f.resolution_m END AS r,
         f.ceiling_m, f.zone FROM final f),
       blocks AS (SELECT r, count(*) AS n, count_if(r NOT IN (1, 2, 4, 8)) AS level, count_if(r > ceiling_m) AS ceiling,
         min(zone) AS z0, max(zone) AS z1 FROM broken GROUP BY r, "row" // r, col // r),
       near AS (SELECT c."row", c.col, c.r, min(n.r) AS low FROM broken c JOIN broken n ON {NEAR4} GROUP BY ALL)
       SELECT 'level' AS rule, sum(level)::BIGINT AS cells FROM blocks UNION ALL SELECT 'ceiling', sum(ceiling)::BIGINT FROM blocks
       UNION ALL SELECT 'alignment', coalesce(sum(CASE WHEN n <> r * r THEN n END), 0)::BIGINT FROM blocks
       UNION ALL SELECT 'zone', coalesce(sum(CASE WHEN z0 <> z1 THEN n END), 0)::BIGINT FROM blocks
       UNION ALL SELECT 'balance', count_if(r > 2 * low)::BIGINT FROM near""",
)
def g15_check(spark, folder):
    """The map with some cells broken on purpose: a size that is no level, and blocks that stand alone."""
    at = F.col("row") * 50 + F.col("col")
    size = F.when(at % 97 == 0, 3).when(at % 41 == 0, 8).otherwise(F.col("resolution_m"))
    return blocks.map_violations(cut_lineage(final_map(spark, folder).withColumn("resolution_m", size)))


@query(
    "g16_level_regions",
    "scene",
    FINAL
    + """, mask AS (SELECT "row", col, "row" * (SELECT max(col) + 1 FROM final) + col AS id, resolution_m AS size FROM final),
      reach AS (SELECT id, "row", col, size, id AS root FROM mask UNION SELECT n.id, n."row", n.col, n.size, r.root FROM reach r JOIN mask n
          ON n.size = r.size AND abs(n."row" - r."row") <= 1 AND abs(n.col - r.col) <= 1),
      lab AS (SELECT id, "row", col, size, min(root) AS label FROM reach GROUP BY ALL)
      SELECT size, CAST(label AS BIGINT) AS label, count(*) AS cells, min("row") AS row0, max("row") AS row1, min(col) AS col0, max(col) AS col1,
        count(*) * 1.0::DOUBLE AS area_m2 FROM lab GROUP BY 1, 2""",
)
def g16(spark, folder):
    cells = cut_lineage(final_map(spark, folder))
    return blocks.level_regions(cells, GridSpec.measure(cells), tile=16)


@query(
    "p15_block_colours",
    "scene",
    FINAL
    + """SELECT "row", col, CASE resolution_m WHEN 1 THEN '#264653' WHEN 2 THEN '#2A6F97' WHEN 4 THEN '#3D9180' ELSE '#7AA874' END AS colour FROM final""",
)
def p15_blocks(spark, folder):
    from tarnfield.functions.columns import block_colour

    return final_map(spark, folder).select("row", "col", block_colour(F.col("resolution_m")).alias("colour"))


@query(
    "j4_aligned_rasters",
    "cells",
    """, terrain AS (SELECT "row", col, elevation_m FROM cells), mask AS (SELECT "row", col, CASE WHEN building OR water THEN 0 ELSE 1 END AS mask FROM cells),
         rain AS (SELECT "row", col, CASE WHEN building THEN 0 ELSE 1 END AS w FROM cells WHERE NOT water)
       SELECT count(*) AS cells, count(r.w) AS with_rain, CAST(sum(m.mask) AS BIGINT) AS active, CAST(sum(r.w) AS BIGINT) AS rain
       FROM terrain t LEFT JOIN mask m ON m."row" = t."row" AND m.col = t.col LEFT JOIN rain r ON r."row" = t."row" AND r.col = t.col""",
)
def j4(spark, folder):
    """Three rasters of one grid on their cell key."""
    cells, key = A.cells(spark, folder), ["row", "col"]
    terrain = cells.select(*key, "elevation_m")
    mask = cells.select(*key, F.when(F.col("building") | F.col("water"), 0).otherwise(1).alias("mask"))
    rain = cells.filter(~F.col("water")).select(*key, F.when(F.col("building"), 0).otherwise(1).alias("w"))
    return terrain.join(mask, key, "left").join(rain, key, "left").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("w").alias("with_rain"),
        F.sum("mask").alias("active"),
        F.sum("w").alias("rain"),
    )


@query(
    "a11_level_counts",
    "scene",
    FINAL
    + """SELECT resolution_m, count(*) AS cells, CAST(count(*) // (resolution_m * resolution_m) AS BIGINT) AS blocks FROM final GROUP BY 1""",
)
def a11(spark, folder):
    return blocks.level_counts(final_map(spark, folder))


@query(
    "a11_reduction_ratio",
    "scene",
    FINAL
    + """, c AS (SELECT count(*) AS cells, count(*) // (resolution_m * resolution_m) AS blocks FROM final GROUP BY resolution_m)
       SELECT CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(cells) AS BIGINT) AS cells, round(sum(blocks) / sum(cells), 6) AS ratio FROM c""",
)
def a11_ratio(spark, folder):
    return blocks.reduction(final_map(spark, folder)).withColumn("ratio", F.round("ratio", 6))


@query(
    "a12_reason_counts",
    "scene",
    FINAL
    + """SELECT reason, count(*) AS cells, min(resolution_m) AS min_resolution, max(resolution_m) AS max_resolution FROM final GROUP BY 1""",
)
def a12(spark, folder):
    return blocks.reason_counts(final_map(spark, folder))


@query(
    "m6_levels",
    "scene",
    FINAL + 'SELECT "row", col, CAST(log2(resolution_m) AS INT) AS level FROM final',
)
def m6(spark, folder):
    return blocks.with_level(final_map(spark, folder)).select("row", "col", "level")
