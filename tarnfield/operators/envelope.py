"""Exact nearest-valid fill by lower envelopes of parabolas, tile by tile.

For a cell at column x the squared distance to the nearest valid cell of column c is (x - c)^2 + g^2, where g is
the distance within column c. As functions of x these are parabolas of one shape, so along a row each is best
on one interval at most and the lower envelope is a stack: linear in the cells, without a search per gap.

Only bounded pieces travel. Tiles report the lowest and highest valid row of each of their columns; a window
over those (one row per tile and column) carries the nearest valid rows below and above into each tile. Tiles
then report the parabolas of their own envelope that reach over their left or right edge; per strip of rows these
are merged from left to right and back, and every tile gets the few that are best somewhere in it. No task
ever holds a whole row or column of the grid.

Ties go to the smaller row, then the smaller column; intervals are whole numbers, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators.grid import block

FAR = np.int64(1) << 40  # past every column


class Envelope:
    """Lower envelopes of many rows at once; parabolas are pushed in the order of their columns.

    ``start`` is the first whole place from which a parabola beats all pushed before it. With ``mirrored``
    places run from right to left (columns are given negated), so of two in one row the later pushed has the
    smaller column and wins a tie.
    """

    def __init__(self, rows: int, capacity: int, mirrored: bool = False):
        self.mirrored, self.size = mirrored, np.zeros(rows, dtype=np.int64)
        self.col, self.src, self.gap2, self.start = (np.zeros((rows, capacity), dtype=np.int64) for _ in range(4))
        self.z = np.zeros((rows, capacity))
        self.each = np.arange(rows)

    def push(self, given: np.ndarray, col, src, gap2, z) -> None:
        """One parabola for each row where ``given``."""
        at = self.each[given]
        col, src, gap2, z = (np.broadcast_to(v, given.shape)[given] for v in (col, src, gap2, z))
        start = np.full(len(at), -FAR)
        open_ = np.arange(len(at))
        while len(open_):
            rows = at[open_]
            open_ = open_[self.size[rows] > 0]
            rows = at[open_]
            top = self.size[rows] - 1
            c, g, s = self.col[rows, top], self.gap2[rows, top], self.src[rows, top]
            num = col[open_] ** 2 + gap2[open_] - c**2 - g
            den = 2 * (col[open_] - c)
            even = num % den == 0
            wins = (src[open_] < s) | ((src[open_] == s) & self.mirrored)
            first = num // den + np.where(even & wins, 0, 1)
            start[open_] = first
            beaten = first <= self.start[rows, top]
            self.size[rows[beaten]] -= 1
            start[open_[beaten]] = -FAR
            open_ = open_[beaten]
        n = self.size[at]
        for name, value in (("col", col), ("src", src), ("gap2", gap2), ("z", z), ("start", start)):
            getattr(self, name)[at, n] = value
        self.size[at] += 1

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Which entries are in use, and the place after the last at which each is best."""
        width = self.col.shape[1]
        used = np.arange(width)[None, :] < self.size[:, None]
        after = np.full(self.start.shape, FAR)
        after[:, :-1] = np.where(used[:, 1:], self.start[:, 1:], FAR)
        return used, after

    def reaching(self, first: int, last: int) -> np.ndarray:
        """Entries that are best somewhere in the places from ``first`` to ``last``."""
        used, after = self.ends()
        return used & (self.start <= last) & (after > first)

    def best(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best entry at each of ``count`` places, and whether a row has any."""
        index = np.zeros((len(self.size), count), dtype=np.int64)
        used, after = self.ends()
        meets = used & (self.start < first + count) & (after > first)
        r, k = np.nonzero(meets)
        np.maximum.at(index, (r, np.maximum(self.start[r, k] - first, 0)), k)
        return np.maximum.accumulate(index, axis=1), self.size > 0


def _carried(cells: DataFrame, tile: int) -> DataFrame:
    """Per tile row and column: the nearest valid row (and its value) below and above the tile."""
    valid = F.when(F.col("z").isNotNull(), F.struct("row", "z"))
    ends = cells.groupBy(block("row", tile).alias("tr"), "col").agg(F.min(valid).alias("low"), F.max(valid).alias("high"))
    order = Window.partitionBy("col").orderBy("tr")
    below = F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return ends.select("tr", block("col", tile).alias("tc"), "col", below.alias("below"), above.alias("above"))


def _with_carries(cells: DataFrame, carried: DataFrame, tile: int) -> DataFrame:
    own = cells.select(
        block("row", tile).alias("tr"), block("col", tile).alias("tc"), F.lit(0).alias("kind"), "row", "col", "z",
        F.lit(None).cast("int").alias("src"),
    )
    sides = []
    for kind, name in ((1, "below"), (2, "above")):
        sides.append(
            carried.filter(F.col(name).isNotNull()).select(
                "tr", "tc", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("row"), "col", F.col(f"{name}.z").alias("z"),
                F.col(f"{name}.row").alias("src"),
            )
        )
    return own.unionByName(sides[0]).unionByName(sides[1])


class _Columns:
    """One tile's cells with, for each, the nearest valid row of its column."""

    def __init__(self, pdf: pd.DataFrame, tile: int):
        kind = pdf["kind"].to_numpy()
        own = pdf[kind == 0]
        self.row0, self.col0 = int(pdf["tr"].iloc[0]) * tile, int(pdf["tc"].iloc[0]) * tile
        self.r, self.c = (own[n].to_numpy(dtype=np.int64) - o for n, o in (("row", self.row0), ("col", self.col0)))
        self.z = np.full((tile, tile), np.nan)
        self.z[self.r, self.c] = own["z"].to_numpy(dtype=float)
        low, high = np.full((2, tile), -1.0), np.full((2, tile), -1.0)
        for k, store in ((1, low), (2, high)):
            side = pdf[kind == k]
            at = side["col"].to_numpy() - self.col0
            store[0, at], store[1, at] = side["src"].to_numpy(dtype=float), side["z"].to_numpy(dtype=float)
        known = np.where(np.isnan(self.z), -1, np.arange(tile)[:, None] + self.row0)
        padded = np.vstack([low[0].astype(np.int64), known])
        below = np.maximum.accumulate(padded, axis=0)[1:]
        turned = np.where(known[::-1] < 0, FAR, known[::-1])
        above_in = np.where(high[0] < 0, FAR, high[0].astype(np.int64))
        above = np.minimum.accumulate(np.vstack([above_in, turned]), axis=0)[1:][::-1]
        here = np.arange(tile)[:, None] + self.row0
        down = np.where(below < 0, FAR, here - below)
        up = np.where(above >= FAR, FAR, above - here)
        self.src = np.where(down <= up, below, above)
        self.gap = np.minimum(down, up)
        self.any = self.gap < FAR
        inside = np.clip(self.src - self.row0, 0, tile - 1)
        value = self.z[inside, np.arange(tile)[None, :]]
        value = np.where(self.src < self.row0, low[1][None, :], value)
        self.value = np.where(self.src >= self.row0 + tile, high[1][None, :], value)

    def push(self, envelope: Envelope, mirrored: bool = False) -> None:
        width = self.z.shape[1]
        for c in range(width - 1, -1, -1) if mirrored else range(width):
            place = -(self.col0 + c) if mirrored else self.col0 + c
            gap = np.where(self.any[:, c], self.gap[:, c], 0)
            envelope.push(self.any[:, c], np.int64(place), self.src[:, c], gap * gap, self.value[:, c])


TAILS = "row int, tc int, side int, col int, src int, z double"


def _tails(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Parabolas of a tile's own envelope that are best beyond its right (side 1) or left (side -1) edge."""
    tile_ = _Columns(pdf, tile)
    parts = []
    for side in (1, -1):
        mirrored = side < 0
        envelope = Envelope(tile, tile, mirrored)
        tile_.push(envelope, mirrored)
        edge = -(tile_.col0 - 1) if mirrored else tile_.col0 + tile
        r, k = np.nonzero(envelope.reaching(edge, FAR))
        present = np.isin(r, tile_.r)  # rows past the grid hold nothing
        r, k = r[present], k[present]
        parts.append(pd.DataFrame({
            "row": r + tile_.row0, "tc": int(pdf["tc"].iloc[0]), "side": side, "col": side * envelope.col[r, k],
            "src": envelope.src[r, k], "z": envelope.z[r, k],
        }))
    return pd.concat(parts)


def _merged(pdf: pd.DataFrame, tile: int, tiles: tuple[int, int]) -> pd.DataFrame:
    """For each tile of a strip of rows, the parabolas from either side that are best somewhere in it."""
    rows = np.unique(pdf["row"].to_numpy())
    parts = []
    for side in (1, -1):
        some = pdf[pdf["side"] == side].sort_values(["tc", "col"], ascending=side > 0)
        place = np.searchsorted(rows, some["row"].to_numpy())
        tc, col = some["tc"].to_numpy(), some["col"].to_numpy().astype(np.int64) * side
        src, z = some["src"].to_numpy().astype(np.int64), some["z"].to_numpy()
        gap2 = (src - some["row"].to_numpy()) ** 2
        envelope = Envelope(len(rows), int(np.bincount(place, minlength=1).max(initial=0)) + 1, side < 0)
        # The n-th parabola of a row in its tile is pushed with the n-th of the other rows.
        nth = some.groupby(["row", "tc"]).cumcount().to_numpy()
        order = np.lexsort([nth, tc * side])
        steps = np.flatnonzero(np.r_[True, (np.diff(tc[order]) != 0) | (np.diff(nth[order]) != 0)]) if len(order) else []
        groups = np.split(order, steps[1:]) if len(order) else []
        at = 0
        for t in range(tiles[0], tiles[1] + 1) if side > 0 else range(tiles[1], tiles[0] - 1, -1):
            first = t * tile if side > 0 else -(t * tile + tile - 1)
            r, k = np.nonzero(envelope.reaching(first, first + tile - 1))
            parts.append(pd.DataFrame({
                "row": rows[r], "tc": t, "side": side, "col": side * envelope.col[r, k], "src": envelope.src[r, k], "z": envelope.z[r, k],
            }))
            while at < len(groups) and tc[groups[at][0]] == t:
                g = groups[at]
                given = np.zeros(len(rows), dtype=bool)
                given[place[g]] = True
                full = [np.zeros(len(rows), dtype=v.dtype) for v in (col, src, gap2, z)]
                for out, v in zip(full, (col, src, gap2, z)):
                    out[place[g]] = v[g]
                envelope.push(given, *full)
                at += 1
    return pd.concat(parts)


def _filled(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """A tile's cells with their gaps filled, from its own columns and the parabolas that reach in."""
    kind = pdf["kind"].to_numpy()
    tile_ = _Columns(pdf[kind < 3], tile)
    gaps = np.isnan(tile_.z[tile_.r, tile_.c])
    z, filled = tile_.z[tile_.r, tile_.c], np.zeros(len(tile_.r), dtype=bool)
    if gaps.any():
        incoming = pdf[kind >= 3].sort_values("col")
        counts = np.bincount(incoming["row"].to_numpy(dtype=np.int64) - tile_.row0, minlength=tile) if len(incoming) else np.zeros(1, int)
        envelope = Envelope(tile, tile + int(counts.max()) + 1)

        def push(side: pd.DataFrame) -> None:
            nth = side.groupby("row").cumcount().to_numpy()
            row, col, src = (side[n].to_numpy(dtype=np.int64) for n in ("row", "col", "src"))
            for n in range(int(nth.max(initial=-1)) + 1):
                g = np.flatnonzero(nth == n)
                given = np.zeros(tile, dtype=bool)
                given[row[g] - tile_.row0] = True
                full = [np.zeros(tile, dtype=np.int64) for _ in range(3)] + [np.zeros(tile)]
                for out, v in zip(full, (col, src, (src - row) ** 2, side["z"].to_numpy(dtype=float))):
                    out[row[g] - tile_.row0] = v[g]
                envelope.push(given, *full)

        push(incoming[incoming["col"] < tile_.col0])
        tile_.push(envelope)
        push(incoming[incoming["col"] >= tile_.col0 + tile])
        index, any_ = envelope.best(tile_.col0, tile)
        value = np.take_along_axis(envelope.z, index, axis=1)
        filled = gaps & any_[tile_.r]
        z = np.where(filled, value[tile_.r, tile_.c], z)
    return pd.DataFrame({"row": tile_.r + tile_.row0, "col": tile_.c + tile_.col0, "z": z, "filled": filled})


STRIP = 16  # rows whose parabolas are merged by one task


def fill_nearest(cells: DataFrame, tile: int = config.TILE, strip: int = STRIP) -> DataFrame:
    """``row, col, z, filled``: every missing ``z`` from the nearest cell that has one; ties go to the smaller row, then column."""
    given = cells.select("row", "col", F.col("z").cast("double").alias("z"))
    carried = _carried(given, tile)
    sent = _with_carries(given, carried, tile)
    tails = sent.groupBy("tr", "tc").applyInPandas(lambda pdf: _tails(pdf, tile), TAILS)
    span = given.agg(F.min(block("col", tile)), F.max(block("col", tile))).first()
    if span[0] is None:
        return given.withColumn("filled", F.lit(False))
    merged = tails.groupBy(block("row", strip)).applyInPandas(lambda pdf: _merged(pdf, tile, tuple(span)), TAILS)
    gaps = given.filter("z IS NULL").select(block("row", tile).alias("tr"), block("col", tile).alias("tc")).distinct()
    reach = merged.select(
        block("row", tile).alias("tr"), "tc", F.lit(3).alias("kind"), "row", "col", "z", "src"
    ).join(gaps, ["tr", "tc"], "left_semi")
    whole = sent.unionByName(reach)
    return whole.groupBy("tr", "tc").applyInPandas(lambda pdf: _filled(pdf, tile), "row int, col int, z double, filled boolean")
