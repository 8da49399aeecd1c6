"""Cube tables on disk: write once in tile order, read windows, points and whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators.grid import GridSpec, block

# Values are stored as 32-bit floats; sums and comparisons widen them.
FRAME_SCHEMA = "run_id STRING, t INT, row INT, col INT, h FLOAT, u FLOAT, v FLOAT"
STORED_COLUMNS = ["run_id", "t", "trow", "tcol", "row", "col", "h", "u", "v"]


# Bytes of a row group: a few tiles, so that windows skip most of a file.
ROW_GROUP = 16 << 20


def tile_curve(trow: Column, tcol: Column, bits: int = 16) -> Column:
    """Position of a tile on the Z curve; tiles that are near each other in the grid are near on it."""
    place = F.lit(0).cast("long")
    for i in range(bits):
        for k, axis in enumerate((tcol, trow)):
            bit = F.shiftright(axis, i).bitwiseAND(F.lit(1)).cast("long")
            place = place.bitwiseOR(F.shiftleft(bit, 2 * i + k))
    return place


class EmptyWindow(ValueError):
    """The requested window does not meet the grid."""


def write_cube(
    frames: DataFrame, path: str, tile: int = config.TILE, layout: str = "frame", files: int | None = None
) -> None:
    """Store a cube clustered by tile, for one of two ways of reading.

    ``frame`` puts each (run, t) into its own folder, in ranges along a curve through the tiles: windows of
    one frame read few row groups of few files. ``tile``
    puts each tile's whole time line together, so per-cell reductions over time fold inside
    the scan tasks before anything is exchanged, and point series read one folder. Either
    way the exchange key holds the tile, so one hot run or frame spreads over many tasks.
    """
    if layout not in ("frame", "tile"):
        raise ValueError("layout is frame or tile")
    stored = {name: F.col(name).cast("float") for name in ("h", "u", "v")}
    tiled = frames.withColumns({"trow": block("row", tile), "tcol": block("col", tile), **stored})
    folders = ["run_id", "t"] if layout == "frame" else ["run_id", "trow", "tcol"]
    if layout == "frame":
        curved = tiled.withColumn("_curve", tile_curve(F.col("trow"), F.col("tcol")))
        keys = ["run_id", "t", "_curve"]
        placed = curved.repartitionByRange(files, *keys) if files else curved.repartitionByRange(*keys)
        ordered = placed.sortWithinPartitions(*keys, "row", "col")
    else:
        keys = [*folders, F.floor(F.col("row") * 8 / tile)]
        placed = tiled.repartition(files, *keys) if files else tiled.repartition(*keys)
        ordered = placed.sortWithinPartitions(*folders, "row", "col", "t")
    writer = ordered.select(*STORED_COLUMNS).write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
    writer.partitionBy(*folders).parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{FRAME_SCHEMA}, trow INT, tcol INT").parquet(path)


def check_cube(frames: DataFrame) -> DataFrame:
    """The contract of a cube: u and v come together, keys are whole."""
    names = set(frames.columns)
    missing = {"t", "row", "col", "h"} - names
    if missing:
        raise ValueError(f"cube lacks {sorted(missing)}")
    if ("u" in names) != ("v" in names):
        raise ValueError("velocity needs both u and v")
    return frames


def read_window(
    frames: DataFrame,
    grid: GridSpec,
    t: int,
    rows: tuple[int, int],
    cols: tuple[int, int],
    tile: int | None = None,
) -> DataFrame:
    """One frame, half-open row and column ranges clamped to the grid; all filters reach the scan.

    Along an axis where the window ends on tile borders the tile filter says it all, and the
    cell index is not even read unless it is selected.
    """
    r0, r1 = max(0, rows[0]), min(grid.height, rows[1])
    c0, c1 = max(0, cols[0]), min(grid.width, cols[1])
    if t < 0 or r0 >= r1 or c0 >= c1:
        raise EmptyWindow(f"t={t} rows={rows} cols={cols}")
    window = F.col("t") == t
    for axis, low, high, size in (("row", r0, r1, grid.height), ("col", c0, c1, grid.width)):
        whole_tiles = False
        if tile:
            window &= F.col(f"t{axis}").between(low // tile, (high - 1) // tile)
            whole_tiles = low % tile == 0 and (high % tile == 0 or high == size)
        if not whole_tiles:
            window &= (F.col(axis) >= low) & (F.col(axis) < high)
    return frames.filter(window)


def point_series(frames: DataFrame, row: int, col: int) -> DataFrame:
    return frames.filter((F.col("row") == row) & (F.col("col") == col)).select("t", "h").orderBy("t")


def inspect_points(points: DataFrame, summary: DataFrame, grid: GridSpec) -> DataFrame:
    """Batch point lookup: local metres to the cell on the half-open box, then its summary."""
    x, y = F.col("x"), F.col("y")
    half_w, half_h = grid.width_m / 2, grid.height_m / 2
    inside = (x >= -half_w) & (x < half_w) & (y >= -half_h) & (y < half_h)
    located = points.withColumns(
        {
            "outside": ~inside,
            "row": F.when(inside, F.floor((y + half_h) * grid.height / grid.height_m).cast("int")),
            "col": F.when(inside, F.floor((x + half_w) * grid.width / grid.width_m).cast("int")),
        }
    )
    found = located.join(summary, ["row", "col"], "left")
    return found.withColumn("has_data", ~F.col("outside") & F.coalesce(F.col("active"), F.lit(False)))
