"""Face tables: lookup, footprints, coverage, field aggregation, face cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.functions.columns import finite
from tarnfield.operators.grid import GridSpec

SIZES = [1, 2, 4, 8, 16, 32]


def locate(points: DataFrame, faces: DataFrame, point_key: str = "point_id") -> DataFrame:
    """The face holding each (row, col); ``matches`` other than 1 is an error.

    A range join turned into an equi join: a point offers one key per possible face size.
    """
    size = F.explode(F.array(*[F.lit(s) for s in SIZES])).alias("size")
    keyed = points.select(point_key, "row", "col", size).select(
        point_key,
        "row",
        "col",
        "size",
        F.floor(F.col("row") / F.col("size")).cast("int").alias("frow"),
        F.floor(F.col("col") / F.col("size")).cast("int").alias("fcol"),
    )
    hits = keyed.join(faces.select("size", "frow", "fcol", "face_id"), ["size", "frow", "fcol"], "left")
    return hits.groupBy(point_key, "row", "col").agg(
        F.min("face_id").alias("face_id"), F.count("face_id").alias("matches")
    )


def footprint(faces: DataFrame, grid: GridSpec) -> DataFrame:
    """Every source cell of every face, clipped to the grid; a face has at most 32 x 32."""

    def span(first, limit):
        start = F.col(first) * F.col("size")
        end = F.least(start + F.col("size"), F.lit(limit)) - 1
        return F.when(start <= end, F.sequence(start, end))

    rows = faces.withColumn("row", F.explode(span("frow", grid.height)))
    return rows.withColumn("col", F.explode(span("fcol", grid.width)))


def coverage_violations(faces: DataFrame, grid: GridSpec, cells: DataFrame) -> DataFrame:
    """Cells not covered exactly once, with how often they are."""
    counts = footprint(faces, grid).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    both = cells.select("row", "col").join(counts, ["row", "col"], "full_outer")
    covered = F.coalesce(F.col("n"), F.lit(0))
    return both.filter(covered != 1).select("row", "col", covered.alias("n"))


def layout_violations(faces: DataFrame) -> DataFrame:
    """Faces whose own fields are impossible."""
    rules = {
        "size": ~F.col("size").isin(SIZES),
        "index": (F.col("frow") < 0) | (F.col("fcol") < 0),
        "overlap": (F.col("overlap_m2") < 0) | (F.col("overlap_m2") > F.col("size") * F.col("size")),
        "missing": F.col("size").isNull() | F.col("frow").isNull() | F.col("fcol").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return faces.select("face_id", F.explode(broken).alias("rule"))


def aggregate_fields(cells: DataFrame) -> DataFrame:
    """Face fields from the source cells: mask, roughness, rain, overlap.

    The cell's own resolution gives its face key, so no join is needed.
    """
    size = F.col("resolution_m")
    active = F.col("mask") != 0
    per_face = cells.groupBy(
        size.alias("size"),
        F.floor(F.col("row") / size).cast("int").alias("frow"),
        F.floor(F.col("col") / size).cast("int").alias("fcol"),
    ).agg(
        F.count_if(active).alias("active_count"),
        F.when(F.count_if(F.col("mask") == 3) > 0, 3).when(F.count_if(active) > 0, 1).otherwise(0).alias("mask"),
        F.coalesce(F.avg(F.when(active, F.col("manning_n"))), F.lit(config.MANNING_GROUND)).alias("manning_n"),
        F.sum("rain_weight").alias("_rain"),
        F.count(F.lit(1)).cast("double").alias("overlap_m2"),
    )
    area = F.col("size") * F.col("size")
    return per_face.withColumn("rain_weight", F.col("_rain") / area).drop("_rain")


def rain_conserved(cells: DataFrame, fields: DataFrame, tolerance: float = 1e-9) -> bool:
    """Face rain times face area against the rain of the cells."""
    source = cells.agg(F.sum("rain_weight")).first()[0] or 0.0
    carried = fields.agg(F.sum(F.col("rain_weight") * F.col("size") * F.col("size"))).first()[0] or 0.0
    return abs(source - carried) <= max(tolerance, abs(source) * tolerance)


def read_face_cube(face_frames: DataFrame, faces: DataFrame) -> DataFrame:
    """Face frames with their layout; missing or negative active depth counts as dry."""
    h = finite("h")
    active = F.col("mask") == 1
    depth = F.when(active, F.greatest(F.coalesce(h, F.lit(0.0)), F.lit(0.0)))
    return face_frames.join(faces, "face_id").withColumns(
        {"depth": depth, "filled": active & h.isNull(), "clipped": active & F.coalesce(h < 0, F.lit(False))}
    )


def face_maximum(cube: DataFrame) -> DataFrame:
    """Maximum per active face; the stored one where present, else rebuilt from clipped depth."""
    return (
        cube.filter("mask = 1")
        .groupBy("face_id")
        .agg(
            F.coalesce(F.max(finite("hmax")), F.max("depth")).alias("max_depth"),
            F.max(finite("hmax")).isNull().alias("reconstructed"),
            F.count_if("filled").alias("filled"),
            F.count_if("clipped").alias("clipped"),
        )
    )


def to_source_grid(values: DataFrame, faces: DataFrame, grid: GridSpec) -> DataFrame:
    """Per-face values on the source cells."""
    return footprint(faces.join(values, "face_id"), grid)
