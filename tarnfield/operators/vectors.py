"""Polygons and lines: ring assembly, clipping, rasterising, inset, buffers, provider fallback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.grid import GridSpec

RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edges(ring: Column) -> Column:
    """Consecutive point pairs as (x1, y1, x2, y2)."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, 1, n),
        F.slice(ring, 2, n),
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )


# --- ring assembly ----------------------------------------------------------------------------

def stitch(lines: list[list[tuple]]) -> list[list[tuple]]:
    """Join fragments that share end points into closed rings; open leftovers are dropped."""
    todo = [list(line) for line in lines if len(line) >= 2]
    rings = []
    while todo:
        ring = todo.pop()
        while ring[0] != ring[-1]:
            for i, other in enumerate(todo):
                if other[0] == ring[-1]:
                    ring += other[1:]
                elif other[-1] == ring[-1]:
                    ring += other[-2::-1]
                else:
                    continue
                todo.pop(i)
                break
            else:
                break
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def assemble_relations(relations: DataFrame) -> DataFrame:
    """Relations (feature_id, members) to rings with sign +1 (outer) or -1 (inner).

    ``members`` is an array of (role, line); one relation is one row, so nothing is grouped. A
    missing role counts as outer; other roles are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for feature, members in zip(batch["feature_id"], batch["members"]):
                for role, sign in (("outer", 1), ("inner", -1)):
                    lines = [
                        [(p["x"], p["y"]) for p in m["line"]]
                        for m in (members if members is not None else [])
                        if (m["role"] or "outer") == role and m["line"] is not None
                    ]
                    for part, ring in enumerate(stitch(lines)):
                        rows.append((feature, part, sign, [{"x": x, "y": y} for x, y in ring]))
            yield pd.DataFrame(rows, columns=["feature_id", "part", "sign", "ring"])

    return relations.select("feature_id", "members").mapInPandas(
        run, f"feature_id string, part int, sign int, ring {RING}"
    )


# --- clipping ---------------------------------------------------------------------------------

def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    terms = F.transform(edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def clip_lines(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Polylines cut to a rectangle; pieces that stay connected stay one line."""
    xmin, ymin, xmax, ymax = box

    def cut(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        starts, ends = [F.lit(0.0)], [F.lit(1.0)]
        outside = F.lit(False)
        for step, gap in ((-dx, e["x1"] - xmin), (dx, xmax - e["x1"]), (-dy, e["y1"] - ymin), (dy, ymax - e["y1"])):
            share = gap / step
            starts.append(F.when(step < 0, share).otherwise(0.0))
            ends.append(F.when(step > 0, share).otherwise(1.0))
            outside = outside | ((step == 0) & (gap < 0))
        t0, t1 = F.greatest(*starts), F.least(*ends)
        a = point(e["x1"] + t0 * dx, e["y1"] + t0 * dy)
        # an end that is not cut stays as it is, so that neighbours still meet in it
        b = F.when(t1 == 1, point(e["x2"], e["y2"])).otherwise(point(e["x1"] + t1 * dx, e["y1"] + t1 * dy))
        return F.struct(a.alias("a"), b.alias("b"), (~outside & (t0 < t1)).alias("ok"))

    pieces = F.filter(F.transform(edges(F.col("ring")), cut), lambda s: s["ok"])

    def join(lines: Column, s: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        tip = F.try_element_at(last, F.lit(-1))
        grown = F.concat(
            F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.array(s["b"])))
        )
        return F.when(tip.isNotNull() & (tip == s["a"]), grown).otherwise(
            F.concat(lines, F.array(F.array(s["a"], s["b"])))
        )

    merged = F.aggregate(pieces, F.array().cast(f"array<{RING}>"), join)
    return features.withColumn("_l", merged).select(
        *[c for c in features.columns if c != "ring"], F.posexplode("_l").alias("part", "ring")
    )


# --- rasterising ------------------------------------------------------------------------------

def _rows(low: Column, high: Column, height: int) -> Column:
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(height - 1))
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))


def _cols(frame: DataFrame, low: Column, high: Column, width: int, keep: list[str]) -> DataFrame:
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(width - 1))
    return frame.select(
        *keep, "row", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))).alias("col")
    )


def ring_id() -> Column:
    """Tells the rings of one feature apart."""
    return F.xxhash64("feature_id", "ring").alias("ring_id")


def _spans(features: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells (feature_id, ring_id, row, col) whose centre lies inside the ring (even-odd rule).

    Edges unfold first and each meets only the rows whose centre line it crosses, so a ring costs its crossings,
    not its edges times its rows. The crossings of a ring and row are sorted and paired. A ring that comes
    twice under one feature counts once.
    """
    y0, x0 = -grid.height_m / 2, -grid.width_m / 2
    parts = features.select("feature_id", ring_id(), F.posexplode(edges(F.col("ring"))).alias("i", "e"))
    parts = parts.select("feature_id", "ring_id", "i", "e.*").filter("y1 <> y2")
    # rows whose centre may lie between the ends, widened by one against rounding
    low = F.floor((F.least("y1", "y2") - y0) / grid.dy - 0.5)
    high = F.ceil((F.greatest("y1", "y2") - y0) / grid.dy - 0.5)
    met = parts.select("*", _rows(low, high, grid.height).alias("row"))
    y = F.lit(y0) + (F.col("row") + 0.5) * grid.dy
    met = met.filter((F.col("y1") <= y) != (F.col("y2") <= y))
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    sorted_ = met.groupBy("feature_id", "ring_id", "row").agg(F.array_sort(F.collect_set(F.struct(x.alias("x"), "i"))).alias("xs"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1),
        lambda i: F.struct(F.get("xs", 2 * i)["x"].alias("a"), F.get("xs", 2 * i + 1)["x"].alias("b")),
    )
    spans = sorted_.filter(F.size("xs") >= 2).select("feature_id", "ring_id", "row", F.explode(pairs).alias("s"))
    first = F.ceil((F.col("s.a") - x0) / grid.dx - 0.5)
    last = F.ceil((F.col("s.b") - x0) / grid.dx - 0.5) - 1
    return _cols(spans, first, last, grid.width, ["feature_id", "ring_id"])


def _near_edges(features: DataFrame, grid: GridSpec, distance_m: float) -> DataFrame:
    """Cells whose centre is nearer than ``distance_m`` to an edge: each edge meets only the cells around it."""
    y0, x0 = -grid.height_m / 2, -grid.width_m / 2
    parts = features.select("feature_id", ring_id(), F.explode(edges(F.col("ring"))).alias("e"))
    parts = parts.select("feature_id", "ring_id", "e.*").distinct()
    low, high = F.least("y1", "y2") - distance_m, F.greatest("y1", "y2") + distance_m
    rows = parts.select(
        "*", _rows(F.floor((low - y0) / grid.dy - 0.5), F.ceil((high - y0) / grid.dy - 0.5), grid.height).alias("row")
    ).repartition("feature_id", "row")
    y = F.lit(y0) + (F.col("row") + 0.5) * grid.dy
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def x_at(level: Column) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - F.col("y1")) / dy))
        return F.when(dy == 0, F.col("x1")).otherwise(F.col("x1") + share * dx)

    flat = dy == 0
    xa = F.when(flat, F.least("x1", "x2")).otherwise(F.least(x_at(y - distance_m), x_at(y + distance_m))) - distance_m
    xb = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(x_at(y - distance_m), x_at(y + distance_m))) + distance_m
    keep = ["feature_id", "ring_id", "x1", "y1", "x2", "y2"]
    cells = _cols(rows, F.floor((xa - x0) / grid.dx - 0.5), F.ceil((xb - x0) / grid.dx - 0.5), grid.width, keep)
    cx, cy = grid.x_of(F.col("col")), grid.y_of(F.col("row"))
    length2 = dx * dx + dy * dy
    share = F.when(length2 > 0, ((cx - F.col("x1")) * dx + (cy - F.col("y1")) * dy) / length2).otherwise(0.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    gx, gy = cx - F.col("x1") - share * dx, cy - F.col("y1") - share * dy
    return cells.filter(gx * gx + gy * gy < distance_m * distance_m).select("feature_id", "ring_id", "row", "col").distinct()


def rasterise_polygons(features: DataFrame, grid: GridSpec, all_touched: bool = False) -> DataFrame:
    """(feature_id, row, col) of cells whose centre lies inside, or of all cells touched."""
    inside = _spans(features, grid).select("feature_id", "row", "col")
    if not all_touched:
        return inside
    return inside.unionByName(rasterise_lines(features, grid)).distinct()


def rasterise_lines(features: DataFrame, grid: GridSpec) -> DataFrame:
    """All cells a polyline passes through: per grid row the x range of the segment within it."""
    y0, x0 = -grid.height_m / 2, -grid.width_m / 2
    parts = features.select("feature_id", F.explode(edges(F.col("ring"))).alias("e")).select("feature_id", "e.*")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = parts.select(
        "*", _rows(F.floor((low - y0) / grid.dy), F.floor((high - y0) / grid.dy), grid.height).alias("row")
    ).repartition("feature_id", "row")
    bottom, top = F.lit(y0) + F.col("row") * grid.dy, F.lit(y0) + (F.col("row") + 1) * grid.dy
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    def x_at(y: Column) -> Column:
        return F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * slope)

    flat = F.col("y1") == F.col("y2")
    ya, yb = F.greatest(low, bottom), F.least(high, top)
    xa = F.when(flat, F.least("x1", "x2")).otherwise(F.least(x_at(ya), x_at(yb)))
    xb = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(x_at(ya), x_at(yb)))
    cells = _cols(rows, F.floor((xa - x0) / grid.dx), F.floor((xb - x0) / grid.dx), grid.width, ["feature_id"])
    return cells.distinct()


def rasterise_inset(features: DataFrame, grid: GridSpec, inset_m: float = 0.5) -> DataFrame:
    """Cells whose centre lies inside the ring and at least ``inset_m`` from each of its edges.

    That is the erosion of the polygon by a disc; small buildings vanish by themselves.
    """
    near = _near_edges(features, grid, inset_m)
    inside = _spans(features, grid).join(near, ["feature_id", "ring_id", "row", "col"], "left_anti")
    return inside.select("feature_id", "row", "col")


def buffer_lines(features: DataFrame, half_width: float, mitre_limit: float = 5.0) -> DataFrame:
    """Road bodies as rings: a flat-capped rectangle per segment and a mitred wedge per bend.

    Bends sharper than the mitre limit are bevelled.
    """

    def direction(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        n = F.sqrt(dx * dx + dy * dy)
        return F.struct(e["x1"], e["y1"], e["x2"], e["y2"], (dx / n).alias("dx"), (dy / n).alias("dy"))

    def rectangle(e: Column) -> Column:
        ox, oy = -e["dy"] * half_width, e["dx"] * half_width
        a, b = point(e["x1"] + ox, e["y1"] + oy), point(e["x2"] + ox, e["y2"] + oy)
        c, d = point(e["x2"] - ox, e["y2"] - oy), point(e["x1"] - ox, e["y1"] - oy)
        return F.array(a, b, c, d, a)

    def wedge(e: Column, f: Column) -> Column:
        cross = e["dx"] * f["dy"] - e["dy"] * f["dx"]
        side = F.when(cross > 0, -half_width).otherwise(half_width)
        px, py = e["x2"], e["y2"]
        ax, ay, bx, by = -e["dy"] * side, e["dx"] * side, -f["dy"] * side, f["dx"] * side
        dot = e["dx"] * f["dx"] + e["dy"] * f["dy"]
        tip = point(px + (ax + bx) / (1 + dot), py + (ay + by) / (1 + dot))
        p, a, b = point(px, py), point(px + ax, py + ay), point(px + bx, py + by)
        sharp = 2 / (1 + dot) > mitre_limit * mitre_limit
        return F.when(cross == 0, F.array().cast(RING)).when(sharp | (dot <= -1), F.array(p, a, b, p)).otherwise(
            F.array(p, a, tip, b, p)
        )

    real = F.filter(edges(F.col("ring")), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    steps = features.withColumn("_d", F.transform(real, direction))
    n = F.greatest(F.size("_d") - 1, F.lit(0))
    bodies = F.concat(
        F.transform("_d", rectangle), F.zip_with(F.slice("_d", 1, n), F.slice("_d", 2, n), wedge)
    )
    return steps.select("feature_id", F.posexplode(bodies).alias("part", "ring")).filter(F.size("ring") >= 4)


def combine_providers(primary: DataFrame, secondary: DataFrame, areas: DataFrame, merge: bool = False) -> DataFrame:
    """Features per area from the primary provider, the secondary where it has none.

    ``merge`` keeps both. Areas that neither provider covers come back with ``problem`` set.
    """
    if merge:
        backup = secondary
    else:
        backup = secondary.join(primary.select("area_id").distinct(), "area_id", "left_anti")
    found = primary.unionByName(backup).withColumn("problem", F.lit(None).cast("string"))
    empty = areas.select("area_id").join(found.select("area_id").distinct(), "area_id", "left_anti")
    return found.unionByName(empty.withColumn("problem", F.lit("no_provider")), allowMissingColumns=True)


def ring_key(ring: Column) -> Column:
    """Identity of a ring, for dropping footprints that two elements repeat."""
    return F.sha2(F.to_json(ring), 256)
