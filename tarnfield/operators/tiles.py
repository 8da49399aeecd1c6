"""Tile kernels: dense numpy blocks of bounded size, one exchange, halo cells copied."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnfield import config


def with_halo(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Give each cell the tiles that need it: its own, and those whose halo it lies in."""

    def homes(name: str):
        place, inner = F.floor(F.col(name) / tile).cast("int"), F.col(name) % tile
        options = F.array(
            place,
            F.when(inner < halo, place - 1),
            F.when(inner >= tile - halo, place + 1),
        )
        return F.array_compact(options)

    if halo == 0:
        return cells.withColumns(
            {n: F.floor(F.col(c) / tile).cast("int") for n, c in (("tr", "row"), ("tc", "col"))}
        )
    if halo > tile:
        raise ValueError("halo must not exceed the tile")
    return cells.withColumn("tr", F.explode(homes("row"))).withColumn("tc", F.explode(homes("col")))


class Dense:
    """The cells of one tile (and halo) as arrays; absent cells carry each column's fill value."""

    def __init__(self, pdf: pd.DataFrame, tile: int, halo: int):
        self.pdf, self.halo = pdf, halo
        self.row0 = int(pdf["tr"].iloc[0]) * tile - halo
        self.col0 = int(pdf["tc"].iloc[0]) * tile - halo
        self.side = tile + 2 * halo
        self.r = pdf["row"].to_numpy() - self.row0
        self.c = pdf["col"].to_numpy() - self.col0
        self.present = self.get(None, False, True)

    def get(self, name: str | None, fill, value=None) -> np.ndarray:
        values = value if name is None else self.pdf[name].to_numpy()
        dtype = np.asarray(values).dtype if name is None else values.dtype
        out = np.full((self.side, self.side), fill, dtype=np.result_type(dtype, type(fill)))
        out[self.r, self.c] = values
        return out

    def rows(self, **columns: np.ndarray) -> pd.DataFrame:
        """The tile's own cells with the given arrays as columns."""
        inner = slice(self.halo, self.side - self.halo)
        r, c = np.nonzero(self.present[inner, inner])
        data = {"row": r + self.row0 + self.halo, "col": c + self.col0 + self.halo}
        data.update({k: v[inner, inner][r, c] for k, v in columns.items()})
        return pd.DataFrame(data)


def tile_map(
    cells: DataFrame,
    kernel: Callable[[Dense], pd.DataFrame],
    schema: str,
    halo: int = 0,
    tile: int = config.TILE,
) -> DataFrame:
    """Run a numpy kernel per tile; a group never exceeds (tile + 2 halo) squared cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(Dense(pdf, tile, halo))

    return with_halo(cells, tile, halo).groupBy("tr", "tc").applyInPandas(run, schema)


def tile_columns(
    cells: DataFrame,
    kernel: Callable[[Dense], pd.DataFrame],
    added: str,
    halo: int = 0,
    tile: int = config.TILE,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``cells`` with the kernel's columns; all others travel through it, so the table is exchanged once, never joined.

    ``by`` names the columns that tell several grids in one table apart.
    """
    more = StructType.fromDDL(added)
    kept = [f for f in cells.schema.fields if f.name not in more.names]
    names = [f.name for f in kept]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])]
        return own[names].merge(kernel(Dense(pdf, tile, halo)), on=["row", "col"])

    sent = with_halo(cells.select(*names), tile, halo)
    return sent.groupBy(*by, "tr", "tc").applyInPandas(run, StructType([*kept, *more.fields]))


def split_blocks(values: np.ndarray, size: int) -> np.ndarray:
    """(side, side) to (blocks, blocks, size, size)."""
    n = values.shape[0] // size
    return values[: n * size, : n * size].reshape(n, size, n, size).transpose(0, 2, 1, 3)


def spread_blocks(values: np.ndarray, size: int) -> np.ndarray:
    """One value per block back to its cells."""
    return np.repeat(np.repeat(values, size, axis=0), size, axis=1)


def shift(values: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """Value of the neighbour at (dr, dc)."""
    out = np.full_like(values, fill)
    h, w = values.shape
    to_r, to_c = slice(max(0, -dr), min(h, h - dr)), slice(max(0, -dc), min(w, w - dc))
    from_r, from_c = slice(max(0, dr), min(h, h + dr)), slice(max(0, dc), min(w, w + dc))
    out[to_r, to_c] = values[from_r, from_c]
    return out
