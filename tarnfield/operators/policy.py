"""No-data, wet/dry, mask and roughness rules on cell and frame tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.functions.columns import finite, speed
from tarnfield.operators.grid import GridSpec, others, own, scatter, stencil


def clean(df: DataFrame, *names: str) -> DataFrame:
    """NaN and infinity become NULL in the named columns."""
    return df.withColumns({name: finite(name) for name in names})


def split_active(cells: DataFrame, rule: str = "strict") -> DataFrame:
    """``strict``: mask 1 only; ``positive``: any mask above zero. Masks 2, 3 and 6 are boundaries."""
    active = F.col("mask") == 1 if rule == "strict" else F.col("mask") > 0
    return cells.withColumns({"active": active, "boundary": F.col("mask").isin(2, 3, 6)})


def normalise_depth(frames: DataFrame, active: Column | None = None) -> DataFrame:
    """Missing depth of active cells is dry and negative depth is clipped; both stay visible as flags.

    Cells that are not active have no depth and no flags.
    """
    h, on = finite("h"), F.lit(True) if active is None else active
    return frames.withColumns(
        {
            "h": F.when(on, F.greatest(F.coalesce(h, F.lit(0.0)), F.lit(0.0))),
            "filled": F.when(on, h.isNull()),
            "clipped": F.when(on, h < 0),
        }
    )


def depth_report(frames: DataFrame, active: Column | None = None) -> DataFrame:
    """Counts of filled and clipped depths of active cells and their raw minimum, in one pass."""
    h, on = finite("h"), F.lit(True) if active is None else active
    return frames.agg(
        F.count_if(on).alias("n"),
        F.count_if(on & h.isNull()).alias("dry_filled"),
        F.count_if(on & (h < 0)).alias("negative_clipped"),
        F.least(F.min(F.when(on, h)), F.lit(0.0)).alias("raw_min"),
    )


def refused_depths(frames: DataFrame, active: Column) -> DataFrame:
    """The refusing form: active cells whose depth is not a number, which the regular reader does not accept."""
    return frames.filter(active & finite("h").isNull())


def normalise_velocity(frames: DataFrame) -> DataFrame:
    """Velocity is zero where dry and missing where inactive."""
    rule = {
        name: F.when(F.col("active"), F.when(F.col("h") > 0, finite(name)).otherwise(0.0)) for name in ("u", "v")
    }
    return frames.withColumns(rule)


def with_flow(frames: DataFrame) -> DataFrame:
    """Speed and unit direction; still water has no direction."""
    s = speed()
    return frames.withColumns(
        {
            "speed": s,
            "dir_x": F.when(s > 0, F.col("u") / s),
            "dir_y": F.when(s > 0, F.col("v") / s),
        }
    )


def velocity_stride(grid: GridSpec, budget: int = 1_000_000) -> int:
    return max(1, math.ceil(math.sqrt(grid.height * grid.width / budget)))


def decimate(frames: DataFrame, stride: int) -> DataFrame:
    return frames.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0))


CORNER_STEPS = [(0, 0), (0, -1), (-1, 0), (-1, -1)]


def corners_to_centres(corners: DataFrame) -> DataFrame:
    """Corner nodes to cells: elevation is the mean of the four, ``uncovered`` needs all four."""
    return (
        scatter(corners, CORNER_STEPS, ["z", "uncovered"])
        .groupBy("row", "col")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.when(F.count("z") == 4, F.avg("z")).alias("z"),
            F.bool_and("uncovered").alias("uncovered"),
        )
        .filter("n = 4")
        .drop("n")
    )


def surface_rules(cells: DataFrame) -> DataFrame:
    """Everything the roughness and mask rules need from the neighbours, in one exchange.

    Adds ``beside_building`` (any of 8 neighbours) and ``beside_water`` (any of 4).
    """
    orthogonal = (F.col("dr") == 0) | (F.col("dc") == 0)
    return stencil(
        cells,
        [
            own("building"),
            own("road"),
            own("water"),
            F.coalesce(others(F.max, F.col("building")), F.lit(False)).alias("beside_building"),
            F.coalesce(others(F.max, F.col("water") & orthogonal), F.lit(False)).alias("beside_water"),
        ],
        ["building", "road", "water"],
        eight=True,
    )


def roughness(
    ground: float = config.MANNING_GROUND,
    road: float = config.MANNING_ROAD,
    perimeter: float = config.MANNING_PERIMETER,
) -> Column:
    """Building perimeter on land wins over road, road over ground."""
    land = ~F.col("water")
    return (
        F.when(F.col("beside_building") & ~F.col("building") & land, F.lit(perimeter))
        .when(F.col("road") & ~F.col("building"), F.lit(road))
        .otherwise(F.lit(ground))
    )


def hydraulic_mask(grid: GridSpec) -> Column:
    """Land 1, land beside water 3, buildings and water 0; the rectangle's edge is closed (1)."""
    land = ~F.col("water") & ~F.col("building")
    edge = grid.edge(F.col("row"), F.col("col"))
    return F.when(~land, 0).when(edge, 1).when(F.col("beside_water"), 3).otherwise(1)
