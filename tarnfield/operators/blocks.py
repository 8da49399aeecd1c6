"""Multi-resolution block map: terrain evidence, ceilings, coarsening, balance, faces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators.components import component_report, components
from tarnfield.operators.grid import GridSpec, at, disc_offsets, ring_offsets, stencil
from tarnfield.operators.tiles import Dense, shift, split_blocks, spread_blocks, tile_columns, tile_map


class InvalidPolicy(ValueError):
    """Levels, radii or limits that contradict each other."""


def check_policy(levels: list[int], limits: dict[int, tuple], core_m: float, mid_m: float, mid_ceiling: int) -> None:
    doubling = all(b == 2 * a for a, b in zip(levels, levels[1:]))
    if not levels or levels[0] != 1 or not doubling or levels[-1] > 32:
        raise InvalidPolicy(f"levels {levels} are not 1, 2, 4, ... up to 32")
    if mid_ceiling not in levels:
        raise InvalidPolicy("the mid-zone ceiling is not an active level")
    if not (0 <= core_m <= mid_m < math.inf):
        raise InvalidPolicy("radii must be finite with core <= mid")
    for size in levels[1:]:
        values = limits.get(size)
        if values is None or not all(math.isfinite(v) and v >= 0 for v in values):
            raise InvalidPolicy(f"limits for {size} m are missing or not finite")


def plane_metrics(z: np.ndarray) -> dict[str, np.ndarray]:
    """Least-squares plane evidence for a stack of square blocks shaped (..., s, s)."""
    s = z.shape[-1]
    axis = np.arange(s) - (s - 1) / 2
    spread = s * (axis**2).sum()
    zc = z - z.mean(axis=(-2, -1), keepdims=True)
    slope_x = (zc * axis).sum(axis=(-2, -1)) / spread
    slope_y = (zc * axis[:, None]).sum(axis=(-2, -1)) / spread
    residual = zc - slope_x[..., None, None] * axis - slope_y[..., None, None] * axis[:, None]
    out = {
        "rmse": np.sqrt((residual**2).mean(axis=(-2, -1))),
        "max_abs_residual": np.abs(residual).max(axis=(-2, -1)),
        "elevation_range": np.ptp(z, axis=(-2, -1)),
        "elevation_std": z.std(axis=(-2, -1)),
        "relief": np.ptp(residual, axis=(-2, -1)),
        "curvature": np.zeros(z.shape[:-2]),
        "connectivity": np.zeros(z.shape[:-2], dtype=bool),
    }
    if s >= 3:
        bends = [np.diff(z, n=2, axis=a) for a in (-2, -1)]
        squares = sum((b**2).sum(axis=(-2, -1)) for b in bends)
        out["curvature"] = np.sqrt(squares / (2 * s * (s - 2)))
        centre = z[..., 1:-1, 1:-1]
        around = [
            z[..., 1 + r : s - 1 + r, 1 + c : s - 1 + c] for r, c in ring_offsets(True, centre=False)
        ]
        pit = np.logical_and.reduce([centre < n for n in around])
        peak = np.logical_and.reduce([centre > n for n in around])
        out["connectivity"] = (pit | peak).any(axis=(-2, -1))
    return out


def is_safe(m: dict, limits: tuple, relief_limit: float = config.CONNECTIVITY_RELIEF_M):
    """Works on numpy arrays and on Spark columns alike."""
    rmse, residual, curvature, relief = limits
    return (
        (m["rmse"] <= rmse)
        & (m["max_abs_residual"] <= residual)
        & (m["curvature"] <= curvature)
        & (m["relief"] <= relief)
        & ~(m["connectivity"] & (m["relief"] >= relief_limit))
    )


METRIC_SCHEMA = (
    "brow int, bcol int, rmse double, max_abs_residual double, elevation_range double, "
    "elevation_std double, relief double, curvature double, connectivity boolean"
)


def block_metrics(cells: DataFrame, size: int, tile: int = config.TILE) -> DataFrame:
    """Plane-fit evidence of every complete aligned block."""

    def kernel(d: Dense):
        z = split_blocks(d.get("elevation_m", np.nan), size)
        whole = split_blocks(d.present, size).all(axis=(-2, -1))
        r, c = np.nonzero(whole)
        found = {k: v for k, v in plane_metrics(z[r, c]).items()}
        return pd.DataFrame({"brow": r + d.row0 // size, "bcol": c + d.col0 // size, **found})

    return tile_map(cells.select("row", "col", "elevation_m"), kernel, METRIC_SCHEMA, tile=tile)


def safe_blocks(metrics: DataFrame, size: int) -> DataFrame:
    named = {k: F.col(k) for k in ("rmse", "max_abs_residual", "curvature", "relief", "connectivity")}
    return metrics.withColumn("safe", is_safe(named, config.BLOCK_LIMITS[size]))


def zone_boundary(cells: DataFrame, value: str) -> DataFrame:
    """Cells with a 4-neighbour of another value."""
    joined = stencil(
        cells,
        [
            F.max(F.when(F.col("own"), F.col(value))).alias("mine"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        ],
        [value],
    )
    return joined.select("row", "col", ((F.col("low") != F.col("mine")) | (F.col("high") != F.col("mine"))).alias("boundary"))


def structure_mask(
    cells: DataFrame,
    grid: GridSpec,
    curvature_m: float = config.STRUCTURE_CURVATURE_M,
    relief_m: float = config.STRUCTURE_RELIEF_M,
) -> DataFrame:
    """Bends and strict extrema of the terrain; the grid's edge is never evidence."""
    z = "elevation_m"
    around = F.when(~F.col("own"), F.col(z))
    seen = stencil(
        cells,
        [
            at(0, 0, z).alias("c"),
            at(0, -1, z).alias("w"),
            at(0, 1, z).alias("e"),
            at(-1, 0, z).alias("s"),
            at(1, 0, z).alias("n"),
            F.min(around).alias("low"),
            F.max(around).alias("high"),
        ],
        [z],
        eight=True,
    )
    c = F.col("c")
    bend = F.greatest(F.abs(F.col("w") - 2 * c + F.col("e")), F.abs(F.col("n") - 2 * c + F.col("s")))
    extremum = (c < F.col("low")) | (c > F.col("high"))
    delta = F.greatest(F.abs(F.col("low") - c), F.abs(F.col("high") - c))
    structure = (bend >= curvature_m) | (extremum & (delta >= relief_m))
    inner = ~edge_rule(grid)
    return seen.select("row", "col", F.coalesce(inner & structure, F.lit(False)).alias("structure"))


def edge_rule(grid: GridSpec) -> Column:
    """Edge cells along axes longer than one cell."""
    rule = F.lit(False)
    if grid.height > 1:
        rule = rule | (F.col("row") == 0) | (F.col("row") == grid.height - 1)
    if grid.width > 1:
        rule = rule | (F.col("col") == 0) | (F.col("col") == grid.width - 1)
    return rule


def dilate(mask: np.ndarray, distance_m: float, dx: float, dy: float) -> np.ndarray:
    """Cells whose closed footprint lies within the distance of a marked footprint."""
    out = mask.copy()
    for dr, dc in disc_offsets(distance_m, dx, dy):
        out |= shift(mask, dr, dc, False)
    return out


def reach_of(distance_m: float, dx: float, dy: float) -> int:
    return max(max(abs(r), abs(c)) for r, c in disc_offsets(distance_m, dx, dy))


def within_distance(
    cells: DataFrame, mask: str, distance_m: float, grid: GridSpec, tile: int = config.TILE
) -> DataFrame:
    """Metric buffer around marked cells as one tile pass; only border cells are copied."""

    def kernel(d: Dense):
        return d.rows(near=dilate(d.get(mask, False), distance_m, grid.dx, grid.dy))

    halo = reach_of(distance_m, grid.dx, grid.dy)
    return tile_map(cells.select("row", "col", mask), kernel, "row int, col int, near boolean", halo, tile)


def _fold_ceiling(start: Column, rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """A rule writes its label only where it lowers the ceiling."""
    steps = F.array(
        *[
            F.struct(
                F.coalesce(mask, F.lit(False)).alias("hit"), F.lit(limit).alias("limit"), F.lit(label).alias("label")
            )
            for mask, limit, label in rules
        ]
    )
    seed = F.struct(start.cast("int").alias("ceiling"), F.lit("terrain_pending").alias("reason"))
    folded = F.aggregate(
        steps,
        seed,
        lambda acc, s: F.when(
            s["hit"] & (acc["ceiling"] > s["limit"]),
            F.struct(s["limit"].alias("ceiling"), s["label"].alias("reason")),
        ).otherwise(acc),
    )
    return folded["ceiling"], folded["reason"]


def ceilings(
    cells: DataFrame,
    grid: GridSpec,
    levels: list[int] | None = None,
    structure_m: float = config.STRUCTURE_BUFFER_M,
    inner_m: float = config.TERRAIN_INNER_M,
    outer_m: float = config.TERRAIN_OUTER_M,
    core_m: float = config.TARGET_CORE_M,
    mid_m: float = config.TARGET_MID_M,
    mid_ceiling: int = config.TARGET_MID_CEILING,
    tile: int = config.TILE,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Coarsest permitted block size and the rule that set it.

    One tile pass with a halo computes all masks (structure, buffers, boundaries); the ordered
    rules then fold as a column expression. Input: elevation_m, building, road, native, mask,
    zone and optionally ceiling_m.
    """
    levels = levels or config.LEVELS_M
    top = levels[-1]
    check_policy(levels, config.BLOCK_LIMITS, core_m, mid_m, mid_ceiling)
    dx, dy, height, width = grid.dx, grid.dy, grid.height, grid.width
    curvature_m, relief_m = config.STRUCTURE_CURVATURE_M, config.STRUCTURE_RELIEF_M

    def kernel(d: Dense):
        z = d.get("elevation_m", np.nan)
        building = d.get("building", False)
        direct = building | d.get("road", False) | d.get("native", False)
        # Outside the grid is no edge: only a present neighbour without a building counts.
        sides = [shift(building | ~d.present, r, c, True) for r, c in ring_offsets(False, False)]
        edge = building & ~np.logical_and.reduce(sides)
        interior = building & ~edge & (d.get("mask", 1) == 0)
        around = [shift(z, r, c, np.nan) for r, c in ring_offsets(True, False)]
        west, east = shift(z, 0, -1, np.nan), shift(z, 0, 1, np.nan)
        north, south = shift(z, 1, 0, np.nan), shift(z, -1, 0, np.nan)
        bend = np.fmax(np.abs(west - 2 * z + east), np.abs(north - 2 * z + south))
        strict = np.logical_and.reduce([z < n for n in around]) | np.logical_and.reduce([z > n for n in around])
        delta = np.max([np.abs(n - z) for n in around], axis=0)
        rows = np.arange(d.side)[:, None] + d.row0
        cols = np.arange(d.side)[None, :] + d.col0
        rim = np.zeros_like(building)
        if height > 1:
            rim |= (rows == 0) | (rows == height - 1)
        if width > 1:
            rim |= (cols == 0) | (cols == width - 1)
        structure = ((bend >= curvature_m) | (strict & (delta >= relief_m))) & ~rim & ~interior
        return d.rows(
            near_structure=dilate(direct, structure_m, dx, dy) & ~direct,
            building_edge=edge,
            interior=interior,
            structure=structure,
            inner=dilate(structure, inner_m, dx, dy) & ~interior,
            outer=dilate(structure, outer_m, dx, dy) & ~interior,
        )

    halo = 1 + max(reach_of(m, dx, dy) for m in (structure_m, inner_m, outer_m))
    flags = (
        "near_structure boolean, building_edge boolean, interior boolean, structure boolean, inner boolean, outer boolean"
    )
    flagged = tile_columns(cells, kernel, flags, halo, tile, by)
    radius = F.hypot(F.col("col") + 0.5 - width / 2.0, F.col("row") + 0.5 - height / 2.0)
    core = (radius <= core_m) if core_m > 0 else F.lit(False)
    mid = ((radius <= mid_m) & ~core) if mid_m > 0 else F.lit(False)
    start = F.least(F.lit(top), F.col("ceiling_m")) if "ceiling_m" in cells.columns else F.lit(top)
    ceiling, reason = _fold_ceiling(
        start,
        [
            (F.col("near_structure"), 2, "near_hard_structure"),
            (F.col("native"), 1, "native_structure"),
            (F.col("road"), 1, "road"),
            (F.col("building_edge"), 1, "building_boundary"),
            (F.col("outer"), min(4, top), "terrain_buffer"),
            (F.col("inner"), min(2, top), "terrain_near"),
            (F.col("structure"), 1, "terrain_structure"),
            (mid, mid_ceiling, "target_mid"),
            (core, 1, "target_core"),
        ],
    )
    return flagged.withColumns({"ceiling_m": ceiling, "reason": reason})


def coarsen(
    cells: DataFrame, levels: list[int] | None = None, tile: int = config.TILE, by: tuple[str, ...] = ()
) -> DataFrame:
    """Merge 1 m cells level by level into the largest safe aligned blocks.

    All candidate blocks of a cell nest inside one aligned block of the top level, and tiles
    are whole multiples of that, so every level runs inside one tile pass: a single exchange
    however many levels there are. Input: elevation_m, ceiling_m, zone, interior, reason.
    """
    levels = levels or config.LEVELS_M
    limits = config.BLOCK_LIMITS
    if tile % levels[-1]:
        raise InvalidPolicy("the tile must be a multiple of the top level")

    def kernel(d: Dense):
        z, zone = d.get("elevation_m", 0.0), d.get("zone", 0)
        ceiling, interior = d.get("ceiling_m", 0), d.get("interior", False)
        resolution = np.where(d.present, 1, 0)
        for size in levels[1:]:
            zones = split_blocks(zone, size)
            allowed = (
                (split_blocks(resolution, size) == size // 2).all(axis=(-2, -1))
                & (split_blocks(ceiling, size) >= size).all(axis=(-2, -1))
                & (zones == zones[..., :1, :1]).all(axis=(-2, -1))
            )
            r, c = np.nonzero(allowed)
            inside = split_blocks(interior, size)[r, c].all(axis=(-2, -1))
            good = inside | is_safe(plane_metrics(split_blocks(z, size)[r, c]), limits[size])
            merge = np.zeros(allowed.shape, dtype=bool)
            merge[r[good], c[good]] = True
            resolution = np.where(spread_blocks(merge, size), size, resolution)
        return d.rows(resolution_m=resolution, merged=resolution > 1)

    mapped = tile_columns(cells, kernel, "resolution_m int, merged boolean", tile=tile, by=by)
    reason = F.when(F.col("merged"), F.lit("terrain_coarsened")).otherwise(F.col("reason"))
    return mapped.withColumn("reason", reason).drop("merged")


def balance(
    cells: DataFrame, levels: list[int] | None = None, tile: int = config.TILE, by: tuple[str, ...] = ()
) -> DataFrame:
    """Halve blocks until no edge neighbour is more than twice as fine.

    A halving is caused only through a chain of ever finer blocks, at most one per level and
    none wider than the top level. A halo of (levels - 1) top-level blocks therefore holds
    every cause, and one tile pass gives the global fixpoint.
    """
    levels = levels or config.LEVELS_M
    top = levels[-1]
    halo = max(1, len(levels) - 1) * top
    tile = max(tile, halo)

    def kernel(d: Dense):
        resolution = d.get("resolution_m", 0)
        start = resolution.copy()
        far = 10 * top
        while True:
            known = np.where(d.present, resolution, far)
            lowest = np.min([shift(known, r, c, far) for r, c in ring_offsets(False, False)], axis=0)
            too_big = d.present & (resolution > 2 * lowest)
            if not too_big.any():
                break
            for size in levels[1:]:
                hit = split_blocks(too_big & (resolution == size), size).any(axis=(-2, -1))
                whole = (split_blocks(resolution, size) == size).all(axis=(-2, -1))
                resolution = np.where(spread_blocks(hit & whole, size), size // 2, resolution)
        return d.rows(balanced=resolution, changed=resolution != start)

    mapped = tile_columns(cells, kernel, "balanced int, changed boolean", halo, tile, by)
    changed = {"resolution_m": F.col("balanced")}
    if "reason" in cells.columns:
        changed["reason"] = F.when(F.col("changed"), F.lit("balanced_transition")).otherwise(F.col("reason"))
    return mapped.withColumns(changed).drop("balanced", "changed")


def with_level(cells: DataFrame) -> DataFrame:
    return cells.withColumn("level", F.rint(F.log2(F.col("resolution_m").cast("double"))).cast("int"))


def level_counts(cells: DataFrame) -> DataFrame:
    """Blocks per level; the area divided by the block area."""
    size = F.col("resolution_m")
    return cells.groupBy("resolution_m").agg(F.count(F.lit(1)).alias("cells")).withColumn(
        "blocks", F.floor(F.col("cells") / (size * size))
    )


def reduction(cells: DataFrame) -> DataFrame:
    """Total blocks against the cells they replace."""
    counts = level_counts(cells)
    return counts.agg(F.sum("blocks").alias("blocks"), F.sum("cells").alias("cells")).withColumn(
        "ratio", F.col("blocks") / F.col("cells")
    )


def reason_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("reason").agg(
        F.count(F.lit(1)).alias("cells"),
        F.min("resolution_m").alias("min_resolution"),
        F.max("resolution_m").alias("max_resolution"),
    )


def faces(cells: DataFrame) -> DataFrame:
    """One row per block: size and block indices, and how much of the grid it covers."""
    size = F.col("resolution_m")
    return (
        cells.groupBy(
            size.alias("size"),
            F.floor(F.col("row") / size).cast("int").alias("frow"),
            F.floor(F.col("col") / size).cast("int").alias("fcol"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("overlap_m2"))
        .withColumn("face_id", face_id())
    )


def face_id() -> Column:
    """A stable key from what identifies a face."""
    return F.concat_ws(":", "size", "frow", "fcol")


def map_violations(cells: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Broken rules of a resolution map as (rule, cells): level, ceiling, alignment, zone, 2:1."""
    levels = levels or config.LEVELS_M
    size = F.col("resolution_m")
    per_face = cells.groupBy(
        size.alias("size"), F.floor(F.col("row") / size).alias("frow"), F.floor(F.col("col") / size).alias("fcol")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~size.isin(levels)).alias("level"),
        F.count_if(size > F.col("ceiling_m")).alias("ceiling"),
        F.min("zone").alias("z0"),
        F.max("zone").alias("z1"),
    )
    one = per_face.agg(
        F.coalesce(F.sum("level"), F.lit(0)).alias("level"),
        F.coalesce(F.sum("ceiling"), F.lit(0)).alias("ceiling"),
        F.coalesce(F.sum(F.when(F.col("n") != F.col("size") * F.col("size"), F.col("n"))), F.lit(0)).alias("alignment"),
        F.coalesce(F.sum(F.when(F.col("z0") != F.col("z1"), F.col("n"))), F.lit(0)).alias("zone"),
    )
    near = stencil(
        cells,
        [at(0, 0, "resolution_m").alias("mine"), F.min("resolution_m").alias("low")],
        ["resolution_m"],
    )
    balance_rule = near.agg(F.count_if(F.col("mine") > 2 * F.col("low")).alias("balance"))
    rules = ["level", "ceiling", "alignment", "zone"]
    listed = one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("cells")) for r in rules])))
    return listed.unionByName(balance_rule.select(F.lit("balance").alias("rule"), F.col("balance").alias("cells")))


def level_regions(cells: DataFrame, grid: GridSpec, levels: list[int] | None = None, tile: int = config.TILE) -> DataFrame:
    """Connected regions of equal block size: count, bounding box, area."""
    parts = None
    for size in levels or config.LEVELS_M:
        labelled = components(cells.filter(F.col("resolution_m") == size), grid, tile)
        part = component_report(labelled.withColumn("size", F.lit(size)), ("size",))
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("area_m2", F.col("cells") * grid.dx * grid.dy)


def flow_concentration(cells: DataFrame, size: int, tile: int = config.TILE) -> DataFrame:
    """Largest share of a block that drains through one of its cells (D8 inside the block)."""

    def kernel(d: Dense):
        z = split_blocks(d.get("elevation_m", np.nan), size)
        r, c = np.nonzero(split_blocks(d.present, size).all(axis=(-2, -1)))
        stack = z[r, c]
        n = size * size
        flat = stack.reshape(len(r), n)
        low, target = flat.copy(), np.full(flat.shape, -1)
        for dr, dc in ring_offsets(True, False):
            near = np.stack([shift(b, dr, dc, np.inf) for b in stack]).reshape(flat.shape) if len(r) else flat
            better = near < low
            low, target = np.where(better, near, low), np.where(better, np.arange(n) + dr * size + dc, target)
        total, each = np.ones(flat.shape), np.arange(len(r))
        for rank in np.argsort(-flat, axis=1, kind="stable").T:
            to = target[each, rank]
            moves = to >= 0
            np.add.at(total, (each[moves], to[moves]), total[each[moves], rank[moves]])
        share = total.max(axis=1) / n if len(r) else np.zeros(0)
        return pd.DataFrame({"brow": r + d.row0 // size, "bcol": c + d.col0 // size, "concentration": share})

    return tile_map(
        cells.select("row", "col", "elevation_m"), kernel, "brow int, bcol int, concentration double", tile=tile
    )
