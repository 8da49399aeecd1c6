"""Reductions of a time x cell cube: maxima, their times, ranges, block sums, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.functions.columns import finite, speed, wet
from tarnfield.operators.grid import GridSpec, block

CELL = ("row", "col")


def max_depth(frames: DataFrame, stored: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """Maximum depth per cell; a stored maximum wins and is rebuilt from frames where missing.

    ``stored`` holds one row per (cell, maximum frame) with column ``hmax``.
    """
    keys = [*by, *CELL]
    depth = F.greatest(finite("h"), F.lit(0.0))
    part = frames.select(*keys, depth.alias("h"), F.lit(None).cast("double").alias("hmax"))
    if stored is not None:
        part = part.unionByName(stored.select(*keys, F.lit(None).cast("double").alias("h"), finite("hmax").alias("hmax")))
    return part.groupBy(*keys).agg(
        F.coalesce(F.max("hmax"), F.max("h")).alias("max_depth"),
        F.max("hmax").isNull().alias("reconstructed"),
    )


def first_max_time() -> Column:
    """Time index of the largest depth; the earliest of equal ones."""
    return F.max(F.struct(F.col("h"), -F.col("t")))["col2"] * -1


def peak_wet_speed(threshold: float = config.DISPLAY_DRY_M, inclusive: bool = False) -> Column:
    return F.max(F.when(wet("h", threshold, inclusive), speed()))


def cell_summary(frames: DataFrame, cells: DataFrame, by: tuple = ()) -> DataFrame:
    """Maximum depth, its first time, peak wet speed, terrain and activity per cell.

    One aggregate over the cube; the static cells join afterwards, when one row per cell is
    left. The aggregate and the join share the cell key, so the cube is exchanged once.
    """
    keys = [*by, *CELL]
    clean = frames.select(*keys, "t", finite("h").alias("h"), finite("u").alias("u"), finite("v").alias("v"))
    peaks = clean.groupBy(*keys).agg(
        F.max(F.struct("h", (-F.col("t")).alias("nt"))).alias("top"), peak_wet_speed().alias("peak")
    )
    active = F.col("mask") > 0
    return cells.join(peaks, keys, "left").select(
        *keys,
        "elevation_m",
        active.alias("active"),
        F.when(active, F.col("top.h")).alias("max_depth"),
        F.when(active & F.col("top.h").isNotNull(), -F.col("top.nt")).alias("max_time"),
        F.when(active, F.col("peak")).alias("peak_speed"),
    )


def diagnostics(summary: DataFrame) -> DataFrame:
    """One row about a cell summary: activity, maxima, terrain range and rule violations."""
    active, h, z = F.col("active"), F.col("max_depth"), finite("elevation_m")
    visible = F.when(active & (h >= config.DISPLAY_DRY_M), h)
    return summary.agg(
        F.count_if(active).alias("active_cells"),
        F.count_if(active & h.isNotNull()).alias("finite_max"),
        F.max(F.when(active, h)).alias("global_max"),
        F.coalesce(F.min(visible), F.lit(config.DISPLAY_DRY_M)).alias("min_visible"),
        F.min(F.when(active, z)).alias("terrain_min"),
        F.max(F.when(active, z)).alias("terrain_max"),
        F.count_if(active & z.isNull()).alias("bad_terrain"),
        F.count_if(active & (h < 0)).alias("negative_max"),
    )


def deepest_cell(summary: DataFrame, grid: GridSpec) -> DataFrame:
    """Cell of the global maximum, first in row-major order, with its centre."""
    key = F.struct(F.col("max_depth").alias("h"), (-F.col("row")).alias("nr"), (-F.col("col")).alias("nc"))
    return (
        summary.filter(F.col("active") & F.col("max_depth").isNotNull())
        .agg(F.max(key).alias("k"))
        .filter(F.col("k").isNotNull())
        .select(
            (-F.col("k.nr")).alias("row"),
            (-F.col("k.nc")).alias("col"),
            F.col("k.h").alias("max_depth"),
            grid.x_of(-F.col("k.nc")).alias("x_m"),
            grid.y_of(-F.col("k.nr")).alias("y_m"),
        )
    )


def value_range(df: DataFrame, value: Column, keep: Column, default: float = 0.0) -> DataFrame:
    picked = F.when(keep, value)
    return df.agg(
        F.coalesce(F.min(picked), F.lit(default)).alias("low"),
        F.coalesce(F.max(picked), F.lit(default)).alias("high"),
    )


def value_histogram(df: DataFrame, value: Column, area: Column) -> DataFrame:
    """Area per distinct value; what every area-weighted quantile starts from."""
    return (
        df.select(finite(value).alias("value"), area.cast("double").alias("area"))
        .filter("value IS NOT NULL AND area > 0")
        .groupBy("value")
        .agg(F.sum("area").alias("area"))
    )


def block_sums(df: DataFrame, stride: int, value: Column) -> DataFrame:
    return df.groupBy(block("row", stride).alias("brow"), block("col", stride).alias("bcol")).agg(
        F.sum(value).alias("area")
    )


def block_minimum(df: DataFrame, size: int, value: str) -> DataFrame:
    """Aligned block minimum; cells past the grid's edge count as ``size`` itself."""
    return df.groupBy(block("row", size).alias("brow"), block("col", size).alias("bcol")).agg(
        F.when(F.count(F.lit(1)) < size * size, F.least(F.min(value), F.lit(size)))
        .otherwise(F.min(value))
        .alias("block_min")
    )


def final_storage(frames: DataFrame, value: str = "h", by: tuple = ()) -> DataFrame:
    """Sum over the last frame, missing values left out.

    The sum per frame comes first, so only one row per frame reaches the choice of the last.
    """
    per_frame = frames.groupBy(*by, "t").agg(F.sum(finite(value)).alias("s"))
    return per_frame.groupBy(*by).agg(F.max_by("s", "t").alias("volume"), F.max("t").alias("last_t"))


def input_summary(cells: DataFrame) -> DataFrame:
    z = finite("elevation_m")
    return cells.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(z.isNotNull()).alias("finite_z"),
        F.min(z).alias("z_min"),
        F.max(z).alias("z_max"),
        F.avg(F.col("building").cast("double")).alias("building_fraction"),
        F.avg(F.col("road").cast("double")).alias("road_fraction"),
        F.sum("rain_weight").alias("rain_sum"),
    )


def overview(cells: DataFrame, grid: GridSpec, value: str, max_px: int) -> DataFrame:
    """Nearest-cell thumbnail of class values with its longer side at most ``max_px`` (256..4096).

    Output pixel (i, j) shows the source cell under its centre, so the reduction is a filter.
    """
    limit = min(4096, max(256, max_px))
    longest = max(grid.width, grid.height)
    if longest <= limit:
        return cells.select("row", "col", value)
    out_h = max(1, round(grid.height * limit / longest))
    out_w = max(1, round(grid.width * limit / longest))

    def pixel(name: str, size: int, out: int) -> tuple[Column, Column]:
        index = F.floor(F.col(name) * out / size)
        nearby = F.array(index, index + 1)
        hit = F.filter(nearby, lambda i: (i < out) & (F.floor((i + 0.5) * size / out) == F.col(name)))
        return F.try_element_at(hit, F.lit(1)).cast("int"), F.size(hit) > 0

    prow, row_hit = pixel("row", grid.height, out_h)
    pcol, col_hit = pixel("col", grid.width, out_w)
    return cells.filter(row_hit & col_hit).select(prow.alias("row"), pcol.alias("col"), value)
