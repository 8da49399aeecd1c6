"""Flow arrows: which cells carry one, their geometry, interpolation in time and space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.columns import finite, speed, wet
from tarnfield.functions.geo import unproject_points
from tarnfield.operators.grid import GridSpec, block
from tarnfield.operators.nearest import at_points, nearest_k, spots_of
from tarnfield.operators.ordered import exact_quantiles
from tarnfield.runtime import cut_lineage

HEAD_ANGLE = math.radians(30)


def flowing(frames: DataFrame, min_speed: float = 0.0) -> DataFrame:
    """Wet active cells (``mask`` above 0) with a usable velocity, and their speed."""
    clean = frames.withColumns({"h": finite("h"), "u": finite("u"), "v": finite("v")}).withColumn("speed", speed())
    usable = wet("h", inclusive=True) & (F.col("speed") >= min_speed) & F.col("speed").isNotNull()
    return clean.filter((F.col("mask") > 0) & usable)


def _best(df: DataFrame, keys: list[Column], rank: Column, rest: list[str]) -> DataFrame:
    """The lowest-ranked row per key; a plain aggregate, so map tasks already reduce it."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select([c for c in best.columns if c != "_b"] + ["_b.*"])


def arrow_stride(grid: GridSpec, max_arrows: int) -> int:
    return max(4, math.ceil(math.sqrt(grid.height * grid.width / max_arrows)))


def fastest_per_block(frames: DataFrame, grid: GridSpec, max_arrows: int, min_speed: float = 0.0) -> DataFrame:
    """Fastest wet cell per stride block, row-major on ties; ``span_m`` is the block's short side."""
    stride = arrow_stride(grid, max_arrows)
    keys = [block("row", stride).alias("brow"), block("col", stride).alias("bcol")]
    rank = F.struct(-F.col("speed"), F.col("row"), F.col("col"))
    best = _best(flowing(frames, min_speed), keys, rank, ["row", "col", "h", "u", "v", "speed"])
    rows = F.least(F.lit(stride), F.lit(grid.height) - F.col("brow") * stride) * grid.dy
    cols = F.least(F.lit(stride), F.lit(grid.width) - F.col("bcol") * stride) * grid.dx
    return best.withColumn("span_m", F.least(rows, cols).cast("double"))


def face_sampling(
    face_frames: DataFrame, grid: GridSpec, max_arrows: int, min_speed: float = 0.0, binned: bool = True
) -> DataFrame:
    """The fastest flowing face per coverage bin, or with ``binned=False`` all flowing faces, at any row count.

    Bins use the face centre in cells (index times size plus half).
    """
    candidates = flowing(face_frames, min_speed)
    if not binned:
        return candidates.select("face_id", "size", "frow", "fcol", "h", "u", "v", "speed")
    bins = max(1, int(math.sqrt(max_arrows)))

    def bin_of(index: str, extent: int) -> Column:
        centre = (F.col(index) + 0.5) * F.col("size")
        return F.least(F.lit(bins - 1), F.floor(centre * bins / max(1, extent)))

    keys = [bin_of("frow", grid.height).alias("rbin"), bin_of("fcol", grid.width).alias("cbin")]
    rank = F.struct(-F.col("speed"), F.col("face_id"))
    best = _best(candidates, keys, rank, ["face_id", "size", "frow", "fcol", "h", "u", "v", "speed"])
    return best.drop("rbin", "cbin")


def nearest_to_bin_centre(
    frames: DataFrame,
    grid: GridSpec,
    spacing_m: float,
    rows: tuple[int, int],
    cols: tuple[int, int],
    min_speed: float = 0.0,
) -> DataFrame:
    """Viewport arrows: per bin the flowing cell closest to the centre of the bin's visible part.

    Bins are anchored at the grid origin, so panning does not move them.
    """
    stride = max(1, round(spacing_m / min(grid.dx, grid.dy)))
    r0, r1 = max(0, rows[0]), min(grid.height, rows[1])
    c0, c1 = max(0, cols[0]), min(grid.width, cols[1])
    view = frames.filter(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))

    def offset(name: str, low: int, high: int) -> Column:
        first = F.floor(F.col(name) / stride) * stride
        start, end = F.greatest(first, F.lit(low)), F.least(first + stride, F.lit(high))
        return F.col(name) - (start + end - 1) / 2.0

    d2 = F.pow(offset("row", r0, r1), F.lit(2)) + F.pow(offset("col", c0, c1), F.lit(2))
    keys = [block("row", stride).alias("brow"), block("col", stride).alias("bcol")]
    best = _best(
        flowing(view, min_speed), keys, F.struct(d2, F.col("row"), F.col("col")), ["row", "col", "h", "u", "v", "speed"]
    )
    return best.withColumn("span_m", F.lit(float(spacing_m)))


def arrow_lines(arrows: DataFrame, grid: GridSpec) -> DataFrame:
    """Three segments per arrow in local metres: shaft, left and right head."""
    length = 0.8 * F.col("span_m")
    dx, dy = F.col("u") / F.col("speed"), F.col("v") / F.col("speed")
    x, y = grid.x_of(F.col("col")), grid.y_of(F.col("row"))
    tail = (x - dx * length * 0.42, y - dy * length * 0.42)
    tip = (x + dx * length * 0.58, y + dy * length * 0.58)
    cos_a, sin_a, head = math.cos(HEAD_ANGLE), math.sin(HEAD_ANGLE), length * 0.28
    left = (tip[0] + (-dx * cos_a + dy * sin_a) * head, tip[1] + (-dx * sin_a - dy * cos_a) * head)
    right = (tip[0] + (-dx * cos_a - dy * sin_a) * head, tip[1] + (dx * sin_a - dy * cos_a) * head)

    def point(p: tuple[Column, Column]) -> Column:
        return F.struct(p[0].alias("x"), p[1].alias("y"))

    lines = F.array(*[F.array(point(a), point(b)) for a, b in ((tail, tip), (tip, left), (tip, right))])
    return arrows.filter("speed > 0").withColumns({"lines": lines, "length_m": length})


def arrow_segments(with_lines: DataFrame) -> DataFrame:
    """One row per segment."""
    return with_lines.select("row", "col", F.posexplode("lines").alias("part", "line")).select(
        "row",
        "col",
        "part",
        F.col("line")[0]["x"].alias("x0"),
        F.col("line")[0]["y"].alias("y0"),
        F.col("line")[1]["x"].alias("x1"),
        F.col("line")[1]["y"].alias("y1"),
    )


def geojson_features(with_lines: DataFrame, grid: GridSpec, t: int) -> DataFrame:
    """One GeoJSON feature text per arrow."""

    def lonlat(line: Column) -> Column:
        return F.transform(unproject_points(line, grid.lon0, grid.lat0), lambda p: F.array(p["lon"], p["lat"]))

    coordinates = F.transform("lines", lonlat)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiLineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("speed").alias("speed_mps"),
            F.col("u").alias("u_mps"),
            F.col("v").alias("v_mps"),
            F.lit(t).alias("time_index"),
            F.col("row"),
            F.col("col").alias("column"),
            F.lit(float(min(grid.dx, grid.dy))).alias("grid_resolution_m"),
        ).alias("properties"),
    )
    return with_lines.select("row", "col", F.to_json(feature).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """Feature texts, one per line."""
    features.select("value").write.mode("overwrite").text(path)


def interpolate_arrows(a: DataFrame, b: DataFrame, fraction: float) -> DataFrame:
    """Arrows of frame a moved towards their twins of frame b; those without one stay."""
    twin = b.select("row", "col", *[F.col(n).alias(f"_{n}") for n in ("u", "v", "speed", "lines")])

    def mix(left: Column, right: Column) -> Column:
        return left + (F.coalesce(right, left) - left) * fraction

    lines = F.zip_with(
        "lines",
        F.coalesce("_lines", "lines"),
        lambda p, q: F.zip_with(
            p, q, lambda s, t: F.struct(mix(s["x"], t["x"]).alias("x"), mix(s["y"], t["y"]).alias("y"))
        ),
    )
    joined = a.join(twin, ["row", "col"], "left")
    mixed = {n: mix(F.col(n), F.col(f"_{n}")) for n in ("u", "v", "speed")}
    return joined.withColumns({**mixed, "lines": lines}).drop("_u", "_v", "_speed", "_lines")


def vector_spacing(nodes: DataFrame) -> DataFrame:
    """One row ``spacing``: median nearest-neighbour distance of the nodes, at least 8; 24 when there are too few."""
    points = nodes.select(F.col("node_id").alias("point_id"), "x", "y")
    sites = nodes.select(F.col("node_id").alias("site_id"), "x", "y")
    near = cut_lineage(nearest_k(points, sites, 1, skip_self=True).select("distance"))
    median = exact_quantiles(near, "distance", {"m": 0.5})
    return median.select(F.when(F.col("m").isNull(), 24.0).otherwise(F.greatest(F.lit(8.0), F.col("m"))).alias("spacing"))


def sample_field(points: DataFrame, nodes: DataFrame, spacing: DataFrame) -> DataFrame:
    """Inverse-distance blend of the 8 nearest nodes within 3 spacings; direction normalised.

    ``spacing`` is one row, as ``vector_spacing`` gives it.

    Points without a node in reach, or whose directions cancel, give no row. Points of one place share one blend.
    """
    spots = spots_of(points)
    near = nearest_k(spots, nodes.select(F.col("node_id").alias("site_id"), "x", "y"), 8)
    near = near.withColumn("spacing", spacing.select("spacing").scalar()).filter("distance <= 3 * spacing")
    scaled = F.col("distance") / F.col("spacing")
    weight = 1 / (0.15 + scaled * scaled)
    joined = near.join(nodes.select(F.col("node_id").alias("site_id"), "dx", "dy", "speed"), "site_id")
    blend = joined.withColumn("w", weight).groupBy("point_id").agg(
        F.sum(F.col("dx") * F.col("w")).alias("sx"),
        F.sum(F.col("dy") * F.col("w")).alias("sy"),
        (F.sum(F.col("speed") * F.col("w")) / F.sum("w")).alias("speed"),
    )
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    usable = blend.withColumn("_s", size).filter("_s > 1e-6").select(
        "point_id", (F.col("sx") / F.col("_s")).alias("dx"), (F.col("sy") / F.col("_s")).alias("dy"), "speed"
    )
    return at_points(points.select("point_id", "x", "y"), spots, usable)

