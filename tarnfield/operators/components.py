"""Connected components, coastal gaps, nearest-valid fill and roof-rain redistribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators.envelope import fill_nearest
from tarnfield.operators.grid import GridSpec, block, ring_offsets, scatter, square_offsets
from tarnfield.operators.tiles import Dense, tile_map
from tarnfield.runtime import cut_lineage

HALF_STEPS = [(0, 1), (1, -1), (1, 0), (1, 1)]


class NoGroundRecipient(ValueError):
    """A building component has no eligible ground within reach."""


class InteriorGap(ValueError):
    """More interior elevation is missing than the coverage rule allows."""


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Label the 8-connected cells of one tile; at most TILE x TILE rows arrive here."""
    rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    r, c = rows - rows.min(), cols - cols.min()
    slot = np.full((r.max() + 2, c.max() + 3), -1, dtype=np.int64)
    slot[r, c + 1] = np.arange(len(r))
    pairs = []
    for dr, dc in HALF_STEPS:
        other = slot[r + dr, c + 1 + dc]
        hit = np.flatnonzero(other >= 0)
        pairs.append(np.stack([hit, other[hit]]))
    a, b = np.concatenate(pairs, axis=1)
    parent = np.arange(len(r))
    while True:
        low = np.minimum(parent[a], parent[b])
        hooked = parent.copy()
        np.minimum.at(hooked, parent[a], low)
        np.minimum.at(hooked, parent[b], low)
        hooked = hooked[hooked]
        if np.array_equal(hooked, parent):
            break
        parent = hooked
    keys = pdf["key"].to_numpy()
    smallest = np.full(len(r), np.iinfo(np.int64).max)
    np.minimum.at(smallest, parent, keys)
    return pdf.assign(label=smallest[parent])[["row", "col", "key", "label"]]


def _merge_labels(pairs: DataFrame) -> DataFrame:
    """Smallest label reachable over (a, b) equivalences.

    A tile component touches a bounded number of others, so no node of this graph is hot.
    Each round takes the neighbours' minimum and then jumps to the label's own label; the
    state is checkpointed, and the loop ends when a round changes nothing.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut_lineage(both)
    state = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    state = cut_lineage(state)
    while True:
        near = (
            edges.join(state.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = state.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = hooked.join(jump, "label", "left").select(
            "node", "old", F.least("label", "next").alias("label")
        )
        stepped = cut_lineage(stepped)
        state = stepped.select("node", "label")
        if stepped.filter("label <> old").isEmpty():
            return state


def components(cells: DataFrame, grid: GridSpec, tile: int = config.TILE) -> DataFrame:
    """8-connected components of the given cells: (row, col, label).

    ``label`` is the smallest row-major index in the component. Tiles are labelled locally,
    then only the cells on tile borders are compared across tiles.
    """
    key = F.col("row").cast("long") * grid.width + F.col("col")
    tiled = cells.select("row", "col", key.alias("key"), block("row", tile).alias("tr"), block("col", tile).alias("tc"))
    local = tiled.groupBy("tr", "tc").applyInPandas(
        lambda pdf: _label_tile(pdf), "row int, col int, key long, label long"
    )
    if grid.width <= tile and grid.height <= tile:
        return local.select("row", "col", "label")
    local = cut_lineage(local)
    border = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    rim = local.filter(border)
    sent = scatter(rim.withColumnRenamed("label", "a"), HALF_STEPS, ["a"]).select("row", "col", "a")
    pairs = sent.join(rim.select("row", "col", F.col("label").alias("b")), ["row", "col"]).filter("a <> b")
    pairs = pairs.select("a", "b").distinct()
    if pairs.isEmpty():
        return local.select("row", "col", "label")
    merged = _merge_labels(pairs)
    renamed = merged.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    joined = local.join(renamed, "label", "left")
    return joined.select("row", "col", F.coalesce("merged", "label").alias("label"))


def component_report(labelled: DataFrame, by: tuple = ()) -> DataFrame:
    """Size and bounding box of every component."""
    return labelled.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("cells"),
        F.min("row").alias("row0"),
        F.max("row").alias("row1"),
        F.min("col").alias("col0"),
        F.max("col").alias("col1"),
    )


def coastal_gaps(cells: DataFrame, grid: GridSpec, tile: int = config.TILE) -> DataFrame:
    """Missing cells with ``coastal``: their component reaches the grid's edge."""
    missing = cells.filter(F.col("z").isNull())
    labelled = cut_lineage(components(missing, grid, tile))
    touching = labelled.groupBy("label").agg(
        F.bool_or(grid.edge(F.col("row"), F.col("col"))).alias("coastal")
    )
    return labelled.join(touching, "label").select("row", "col", "coastal")


def gap_report(cells: DataFrame, gaps: DataFrame) -> DataFrame:
    """Counts and shares of missing, interior-missing and coastal cells."""
    coastal = F.col("coastal")
    one = cells.join(gaps, ["row", "col"], "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("z").isNull()).alias("missing"),
        F.count_if(coastal).alias("coastal"),
        F.count_if(~coastal).alias("interior"),
    )
    return one.withColumns(
        {
            "missing_fraction": F.col("missing") / F.col("n"),
            "interior_fraction": F.col("interior") / F.col("n"),
            "coastal_fraction": F.col("coastal") / F.col("n"),
            "covered": F.col("interior") / F.col("n") <= config.MAX_INTERIOR_MISSING,
        }
    )


def fill_elevation(cells: DataFrame, grid: GridSpec, tile: int = config.TILE) -> DataFrame:
    """Nearest fill behind the coverage rule: too much interior loss is an error."""
    gaps = coastal_gaps(cells, grid, tile)
    report = gap_report(cells, gaps).first()
    if not report["covered"]:
        raise InteriorGap(f"interior missing share {report['interior_fraction']:.4f}")
    return fill_nearest(cells, tile)


def _first_rings(reach: int):
    """Kernel: ground cells of a tile with each label within ``reach`` whose nearest such cells, in this tile, they are."""

    def kernel(d: Dense) -> pd.DataFrame:
        label = d.get("label", np.int64(-1)).astype(np.int64)
        ground = d.get("ground", False)
        inner = slice(d.halo, d.side - d.halo)
        r, c = np.nonzero(ground[inner, inner])
        r, c = r + d.halo, c + d.halo
        cells, labels, far = [], [], []
        for distance in range(1, reach + 1):
            for dr, dc in square_offsets(distance):
                if max(abs(dr), abs(dc)) != distance:
                    continue
                seen = label[r + dr, c + dc]
                hit = np.flatnonzero(seen >= 0)
                cells.append(hit)
                labels.append(seen[hit])
                far.append(np.full(len(hit), distance))
        cells, labels, far = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (cells, labels, far))
        names, which = np.unique(labels, return_inverse=True)
        least = np.full(len(names), reach + 1)
        np.minimum.at(least, which, far)
        kept = np.flatnonzero(far == least[which])  # a farther cell of this tile cannot be in the first ring
        _, once = np.unique(np.stack([cells[kept], labels[kept]]), axis=1, return_index=True)
        kept = kept[once]
        return pd.DataFrame({
            "label": labels[kept], "row": r[cells[kept]] + d.row0, "col": c[cells[kept]] + d.col0, "ring": far[kept],
        })

    return kernel


def roof_recipients(
    labelled: DataFrame, ground: DataFrame, reach: int = 5, strict: bool = True, tile: int = config.TILE
) -> DataFrame:
    """(label, row, col) of the first Chebyshev ring of each component that holds ground.

    One pass over tiles with a halo of ``reach``: each ground cell tells the ring in which it lies around each
    label. The smallest ring per label is one aggregate.
    """
    none = F.lit(None).cast("long")
    cells = labelled.select("row", "col", F.col("label").cast("long").alias("label"), F.lit(False).alias("ground")).unionByName(
        ground.select("row", "col", none.alias("label"), F.lit(True).alias("ground"))
    )
    cells = cells.withColumn("label", F.coalesce("label", F.lit(-1)))
    rings = tile_map(cells, _first_rings(reach), "label long, row int, col int, ring int", halo=reach, tile=max(tile, reach))
    rings = cut_lineage(rings)
    first = rings.groupBy("label").agg(F.min("ring").alias("first"))
    if strict:
        lost = labelled.select("label").distinct().join(first, "label", "left_anti").agg(F.min("label")).first()[0]
        if lost is not None:
            raise NoGroundRecipient(f"component {lost} has no ground within {reach} cells")
    return rings.join(first, "label").filter("ring = first").select("label", "row", "col")


def _weights(cells: DataFrame, extra: DataFrame) -> DataFrame:
    base = F.when(F.col("active") & ~F.col("building"), 1.0).otherwise(0.0)
    return cells.join(extra, ["row", "col"], "left").select(
        "row", "col", "building", "active", (base + F.coalesce("extra", F.lit(0.0))).alias("rain_weight")
    )


def allocate_roof_rain(
    cells: DataFrame, grid: GridSpec, reach: int = 5, tile: int = config.TILE, strict: bool = True
) -> DataFrame:
    """Rain weight per cell with every roof's rain moved to its nearest ring of ground."""
    roofs = cells.filter("building")
    labelled = cut_lineage(components(roofs, grid, tile))
    ground = cells.filter(F.col("active") & ~F.col("building"))
    recipients = roof_recipients(labelled, ground, reach, strict, tile)
    supply = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("roof"))
    demand = recipients.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = supply.join(demand, "label").select("label", (F.col("roof") / F.col("n")).alias("share"))
    extra = recipients.join(share, "label").groupBy("row", "col").agg(F.sum("share").alias("extra"))
    return _weights(cells, extra)


def perimeter_roof_rain(cells: DataFrame, grid: GridSpec, tile: int = config.TILE) -> DataFrame:
    """Older rule: each exposed 4-edge of a component gets an equal part of its roof area.

    A component without an exposed edge loses its rain, as in the rule it restates.
    """
    roofs = cells.filter("building")
    labelled = cut_lineage(components(roofs, grid, tile))
    ground = cells.filter(~F.col("building")).select("row", "col")
    edges = scatter(labelled, ring_offsets(False, centre=False), ["label"]).join(ground, ["row", "col"])
    per_cell = cut_lineage(edges.groupBy("label", "row", "col").agg(F.count(F.lit(1)).alias("edges")))
    supply = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("roof"))
    demand = per_cell.groupBy("label").agg(F.sum("edges").alias("n"))
    share = supply.join(demand, "label").select("label", (F.col("roof") / F.col("n")).alias("share"))
    extra = (
        per_cell.join(share, "label")
        .groupBy("row", "col")
        .agg(F.sum(F.col("share") * F.col("edges")).alias("extra"))
    )
    return _weights(cells.withColumn("active", F.lit(True)), extra)


def mass_balance(weights: DataFrame, cell_area: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """Rain that fell on active area against rain that the weights carry."""
    fell, carried = F.col("active_area"), F.col("weighted_area")
    return weights.agg(
        (F.count_if("active") * cell_area).alias("active_area"),
        (F.sum("rain_weight") * cell_area).alias("weighted_area"),
    ).withColumns(
        {"relative_error": F.abs(carried - fell) / fell, "conserved": F.abs(carried - fell) / fell <= tolerance}
    )


PART = 100_000  # cells whose messages one task sorts
SIDE = 64  # of the squares that stay together, so that most messages fold inside a task


def downstream(cells: DataFrame, size: int | None = None) -> DataFrame:
    """D8 pointer: the lowest strictly lower neighbour, smallest row-major index on ties.

    With ``size`` the flow stays inside aligned blocks. Cells are dealt in squares to parts of about ``PART``, as the
    lowest neighbour is told by sorting all messages of a task, however few files the cells come from.
    """
    parts = max(1, -(-cells.count() // PART))
    cells = cells.select("row", "col", "elevation_m").repartition(parts, block("row", SIDE), block("col", SIDE))
    sent = scatter(cells, ring_offsets(True), ["elevation_m"])
    if size:
        same = (block("row", size) == F.floor((F.col("row") + F.col("dr")) / size)) & (
            block("col", size) == F.floor((F.col("col") + F.col("dc")) / size)
        )
        sent = sent.filter(same)
    rank = F.struct(
        F.col("elevation_m").alias("z"), (F.col("row") + F.col("dr")).alias("r"), (F.col("col") + F.col("dc")).alias("c")
    )
    per_cell = sent.groupBy("row", "col").agg(
        F.max(F.when(F.col("own"), F.col("elevation_m"))).alias("z"), F.min(F.when(~F.col("own"), rank)).alias("low")
    )
    lower = F.col("low.z") < F.col("z")
    return per_cell.filter(F.col("z").isNotNull()).select(
        "row", "col", F.when(lower, F.col("low.r")).alias("drow"), F.when(lower, F.col("low.c")).alias("dcol")
    )


class _TileFlow:
    """Pointers of one tile: the next cell inside it, or that the path ends or leaves here."""

    def __init__(self, pdf: pd.DataFrame, width: int):
        own = pdf[pdf["inflow"].isna()]
        self.id = own["id"].to_numpy(dtype=np.int64)
        order = np.argsort(self.id)
        self.id, jump = self.id[order], own["jump"].to_numpy(dtype=float)[order]
        self.moves = ~np.isnan(jump)
        self.target = np.where(self.moves, jump, -1).astype(np.int64)
        at = np.minimum(np.searchsorted(self.id, self.target), len(self.id) - 1)
        self.inside = self.moves & (self.id[at] == self.target)
        self.next = np.where(self.inside, at, np.arange(len(self.id)))
        self.leaves = self.moves & ~self.inside

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Weight of all cells upstream inside the tile, own included; heads first, level by level."""
        total = weight.copy()
        waiting = np.bincount(self.next[self.inside], minlength=len(total))
        ready = np.flatnonzero(waiting == 0)
        while len(ready):
            ready = ready[self.inside[ready]]
            to = self.next[ready]
            np.add.at(total, to, total[ready])
            np.subtract.at(waiting, to, 1)
            to = np.unique(to)
            ready = to[waiting[to] == 0]
        return total

    def ends(self) -> np.ndarray:
        """Last cell inside the tile of each cell's path."""
        ahead = self.next
        while True:
            further = ahead[ahead]
            if (further == ahead).all():
                return ahead
            ahead = further


def _tile_exits(pdf: pd.DataFrame, width: int, tile: int) -> pd.DataFrame:
    """Exits of a tile (id, the cell they lead to, cells drained) and, for its border cells, the exit of their path."""
    flow = _TileFlow(pdf, width)
    total, ends = flow.sums(np.ones(len(flow.id), dtype=np.int64)), flow.ends()
    out = np.flatnonzero(flow.leaves)
    row, col = flow.id // width % tile, flow.id % width % tile
    border = np.flatnonzero((row == 0) | (row == tile - 1) | (col == 0) | (col == tile - 1))
    border = border[flow.leaves[ends[border]]]
    return pd.DataFrame({
        "is_exit": np.r_[np.ones(len(out), bool), np.zeros(len(border), bool)],
        "id": np.r_[flow.id[out], flow.id[border]],
        "other": np.r_[flow.target[out], flow.id[ends[border]]],
        "acc": np.r_[total[out], np.zeros(len(border), np.int64)],
    })


def _tile_totals(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    flow = _TileFlow(pdf, width)
    weight = np.ones(len(flow.id), dtype=np.int64)
    given = pdf[pdf["inflow"].notna()]
    at = np.searchsorted(flow.id, given["id"].to_numpy(dtype=np.int64))
    np.add.at(weight, at, given["inflow"].to_numpy(dtype=np.int64))
    return pd.DataFrame({"row": flow.id // width, "col": flow.id % width, "acc": flow.sums(weight)})


def _path_sums(state: DataFrame) -> DataFrame:
    """Weights of all nodes upstream, own included, for (id, jump, acc): path doubling.

    After k rounds ``acc`` holds what lies within 2^k - 1 steps and ``jump`` points 2^k steps on. Nodes at the
    end of their path join by a key of their own, so that they do not meet in one task.
    """
    while not state.filter(F.col("jump").isNotNull()).isEmpty():
        inflow = state.filter(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("id")).agg(F.sum("acc").alias("more"))
        ahead = state.select(F.col("id").alias("target"), F.col("jump").alias("jump2"))
        target = F.coalesce(F.col("jump"), -1 - F.col("id"))
        state = cut_lineage(
            state.join(inflow, "id", "left")
            .withColumn("target", target)
            .join(ahead, "target", "left")
            .select("id", F.col("jump2").alias("jump"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"))
        )
    return state


def accumulate_flow(pointers: DataFrame, width: int, tile: int = config.TILE) -> DataFrame:
    """Cells draining through each cell, itself included, for pointers to one of the eight neighbours.

    Tiles sum their own paths. What leaves them forms a graph of exit cells only: an exit leads to a border cell
    of the next tile, whose path has an exit again. Sums over that graph give what flows into each border cell,
    and a second pass over the tiles adds it. So rounds of joins meet rows in proportion to the tiles' borders.
    """
    key = F.col("row").cast("long") * width + F.col("col")
    jump = F.col("drow").cast("long") * width + F.col("dcol")
    cells = pointers.select(
        block("row", tile).alias("tr"), block("col", tile).alias("tc"), key.alias("id"), jump.alias("jump"), F.lit(None).cast("long").alias("inflow")
    )
    cells = cut_lineage(cells)
    met = cells.groupBy("tr", "tc").applyInPandas(
        lambda pdf: _tile_exits(pdf, width, tile), "is_exit boolean, id long, other long, acc long"
    )
    met = cut_lineage(met)
    exits = met.filter("is_exit").select("id", F.col("other").alias("entry"), "acc")
    onward = met.filter("NOT is_exit").select(F.col("id").alias("entry"), F.col("other").alias("jump"))
    sums = _path_sums(cut_lineage(exits.join(onward, "entry", "left").select("id", "jump", "acc")))
    into = sums.join(exits.select("id", "entry"), "id").groupBy("entry").agg(F.sum("acc").alias("inflow"))
    place = {"tr": F.floor(F.floor(F.col("entry") / width) / tile).cast("int"), "tc": F.floor(F.col("entry") % width / tile).cast("int")}
    into = into.withColumns(place).select("tr", "tc", F.col("entry").alias("id"), F.lit(None).cast("long").alias("jump"), "inflow")
    return cells.unionByName(into).groupBy("tr", "tc").applyInPandas(
        lambda pdf: _tile_totals(pdf, width), "row int, col int, acc long"
    )
