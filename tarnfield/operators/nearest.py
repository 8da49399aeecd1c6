"""Exact k nearest sites by descending a cell tree, on the sphere or in the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.geo import haversine_km
from tarnfield.operators.ordered import top_per_key
from tarnfield.runtime import broadcast_if_small, cut_lineage

AXES = ("x", "y", "z")
# Levels gained per descent: up to 16 children in the plane, 64 boxes (few of them occupied) in space.
STRIDE = 2
# Descent ends once no cell holds more sites than this, or cells reach the finest level.
CROWD = 32
MAX_LEVEL = 40
SLACK = 1e-9
ROOTS = 64  # cells that a descent may start from
POINTS_PER_TASK = 4096
SHARED = 100_000  # cells of seven numbers that are sent to every task


def _place(df: DataFrame, sphere: bool) -> DataFrame:
    """Coordinates to search in: the plane itself, or the unit sphere in space.

    Straight-line distance in space grows with great-circle distance, so boxes prune both.
    """
    if not sphere:
        return df.withColumns({"lon": F.col("x"), "lat": F.col("y"), "z": F.lit(0.0)})
    lon, lat = F.radians("x"), F.radians("y")
    return df.withColumns(
        {
            "lon": F.col("x"),
            "lat": F.col("y"),
            "x": F.cos(lat) * F.cos(lon),
            "y": F.cos(lat) * F.sin(lon),
            "z": F.sin(lat),
        }
    )


def _cell(level: int, origin: dict[str, float], span: float) -> list[Column]:
    """Index of the cell that holds a site, one number per axis."""
    size = span / 2**level
    return [F.floor((F.col(a) - origin[a]) / size).cast("long").alias(f"c{a}") for a in AXES]


def _bounds(level: int, origin: dict[str, float], span: float) -> tuple[Column, Column]:
    """Nearest and farthest a cell's content can be from the point (px, py, pz)."""
    size = span / 2**level
    near, far = F.lit(0.0), F.lit(0.0)
    for a in AXES:
        low = F.col(f"c{a}") * size + origin[a]
        below, above = low - F.col(f"p{a}"), F.col(f"p{a}") - (low + size)
        outside = F.greatest(F.lit(0.0), below, above)
        reach = F.greatest(F.abs(below), F.abs(above))
        near, far = near + outside * outside, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def spots_of(points: DataFrame) -> DataFrame:
    """The distinct places (x, y) of points, each once, with a ``point_id`` of its own."""
    places = points.select("x", "y").filter("x IS NOT NULL AND y IS NOT NULL").distinct()
    return cut_lineage(places.withColumn("point_id", F.monotonically_increasing_id()))


def at_points(points: DataFrame, spots: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers``, one row per spot at most (``point_id`` and more), for every point at the place."""
    told = cut_lineage(answers.join(spots, "point_id").drop("point_id"))
    return points.join(broadcast_if_small(told), ["x", "y"]).drop("x", "y")


def nearest_k(
    points: DataFrame,
    sites: DataFrame,
    k: int,
    sphere: bool = False,
    skip_self: bool = False,
    within: float | None = None,
) -> DataFrame:
    """(point_id, site_id, distance, rank) of the k nearest sites, ties by site id.

    ``points`` has point_id, x, y and ``sites`` site_id, x, y (degrees when ``sphere``). Points of one place have one
    answer: the search runs once per place, however many points share it. With ``skip_self`` one more is searched for,
    and each point drops its own site.
    """
    spots = spots_of(points)
    found = _nearest(spots, sites, k + 1 if skip_self else k, sphere, within)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "site_id", "distance"))).alias("_near")
    each = at_points(points.select("point_id", "x", "y"), spots, found.groupBy("point_id").agg(ranked))
    near = F.col("_near")
    if skip_self:
        near = F.slice(F.filter(near, lambda s: s["site_id"] != F.col("point_id")), 1, k)
    rows = each.select("point_id", F.posexplode(near).alias("_at", "_s"))
    return rows.select("point_id", "_s.site_id", "_s.distance", (F.col("_at") + 1).alias("rank"))


def _nearest(points: DataFrame, sites: DataFrame, k: int, sphere: bool, within: float | None) -> DataFrame:
    """The search of ``nearest_k`` for points that do not share places.

    All points descend together from one cell: each kept (point, cell) pair opens the cell's
    occupied children, the k-th smallest farthest-possible distance bounds the answer, and
    cells that begin beyond the bound go. Only then do the few cells left meet their sites, so
    a point far from a dense cluster never meets all of it. Sites beyond the first k of one
    exact coordinate cannot rank and are dropped first. The cells of all levels are counted in
    one aggregate; the descent, whose length depends on the sites alone, is then one plan.
    """
    first = top_per_key(sites.select("site_id", "x", "y"), ["x", "y"], [F.col("site_id")], k, F.col("site_id"))
    placed = cut_lineage(_place(first.drop("rank"), sphere))
    box = placed.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    # dealt by point before cells multiply the rows: what follows per point needs no further exchange of them, and by
    # number, as the few bytes of a point would otherwise be merged into one task
    dealt = points.select("point_id", "x", "y").repartition(points.count() // POINTS_PER_TASK + 1, "point_id")
    asked = _place(dealt, sphere).select(
        "point_id", *[F.col(a).alias(f"p{a}") for a in AXES], F.col("lon").alias("plon"), F.col("lat").alias("plat")
    )
    if box["lox"] is None:
        nothing = asked.select("point_id", F.lit(None).cast(sites.schema["site_id"].dataType).alias("site_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        return nothing.filter(F.lit(False))
    origin = {a: box[f"lo{a}"] for a in AXES}
    span = max(box[f"hi{a}"] - origin[a] for a in AXES) * (1 + 1e-9) + 1e-12
    counts = cut_lineage(_counts(placed, origin, span))
    told = counts.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("crowd"))
    sizes = {r["level"]: (r["cells"], r["crowd"]) for r in told.collect()}  # one row per level
    last = next((lv for lv in sorted(sizes) if sizes[lv][1] <= max(CROWD, 2 * k)), MAX_LEVEL)
    first_level = max([lv for lv in sizes if lv <= last and sizes[lv][0] <= ROOTS], default=min(sizes))
    keys = [f"c{a}" for a in AXES]
    held = None
    for level in range(first_level, last + 1, STRIDE):
        children = counts.filter(F.col("level") == level).select(*keys, "n")
        opened = _open_root(asked, children) if held is None else _open(held, children, sizes[level][0])
        held = _prune(opened, level, origin, span, k, None if sphere else within)
    return _rank(held, placed, last, origin, span, k, sphere, within)


def _counts(placed: DataFrame, origin: dict[str, float], span: float) -> DataFrame:
    """Sites per occupied cell of every level, in one aggregate."""
    levels = F.explode(F.array(*[F.lit(lv) for lv in range(STRIDE, MAX_LEVEL + 1, STRIDE)])).alias("level")
    size = F.lit(float(span)) / F.pow(F.lit(2.0), F.col("level"))
    at = [F.floor((F.col(a) - origin[a]) / size).cast("long").alias(f"c{a}") for a in AXES]
    return placed.select(*AXES, levels).groupBy("level", *at).agg(F.count(F.lit(1)).alias("n"))


def _open_root(asked: DataFrame, children: DataFrame) -> DataFrame:
    """The first cells, few enough to stand in the plan, next to every point."""
    cells = [F.struct(*[F.lit(r[c]).cast("long").alias(c) for c in children.columns]) for r in children.collect()]
    return asked.withColumn("_c", F.explode(F.array(*cells))).select(*asked.columns, "_c.*")


def _open(held: DataFrame, children: DataFrame, cells: int) -> DataFrame:
    """The occupied children of the kept cells; ``cells`` is their counted number."""
    ratio, keys = 2**STRIDE, [f"c{a}" for a in AXES]
    parents = children.select(*[F.floor(F.col(c) / ratio).cast("long").alias(f"up_{c}") for c in keys], *keys, "n")
    above = held.select(*[c for c in held.columns if c not in keys], *[F.col(c).alias(f"up_{c}") for c in keys])
    met = F.broadcast(parents) if cells <= SHARED else parents
    return above.join(met, [f"up_{c}" for c in keys]).drop(*[f"up_{c}" for c in keys])


def _prune(opened, level, origin, span, keep, within) -> DataFrame:
    """Drop the cells that begin beyond the bound set by the others."""
    near, far = _bounds(level, origin, span)
    sized = opened.withColumns({"near": near, "far": far})
    # rows of one point only: its kept cells and their children
    inward = Window.partitionBy("point_id").orderBy("far")
    sized = sized.withColumn("upto", F.sum("n").over(inward))
    bound = F.min(F.when(F.col("upto") >= keep, F.col("far"))).over(Window.partitionBy("point_id"))
    limit = F.coalesce(bound, F.lit(float("inf")))
    if within is not None:
        limit = F.least(limit, F.lit(float(within)))
    kept = sized.withColumn("limit", limit).filter(F.col("near") <= F.col("limit") * (1 + SLACK) + SLACK)
    return kept.drop("n", "near", "far", "upto", "limit")


def _rank(held, placed, level, origin, span, k, sphere, within) -> DataFrame:
    """Exact distances to the sites of the cells that are left."""
    keys = [f"c{a}" for a in AXES]
    offered = placed.select(*_cell(level, origin, span), "site_id", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    pairs = held.join(offered, keys)
    if sphere:
        distance = haversine_km(F.col("plon"), F.col("plat"), F.col("slon"), F.col("slat"))
    else:
        dx, dy = F.col("plon") - F.col("slon"), F.col("plat") - F.col("slat")
        distance = F.sqrt(dx * dx + dy * dy)
    pairs = pairs.select("point_id", "site_id", distance.alias("distance"))
    if within is not None:
        pairs = pairs.filter(F.col("distance") <= within)
    order = Window.partitionBy("point_id").orderBy("distance", "site_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
