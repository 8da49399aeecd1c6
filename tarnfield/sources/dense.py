"""Dense cubes on disk: one row per (run, time, tile) with packed arrays, published by a manifest.

A tile row holds, for each variable, the tile's values as one binary of little-endian floats in row order (NaN
where there is none), and one bit per cell that says whether the cell was given at all. Column pruning picks
variables, the manifest picks files by time and tile range, row-group statistics pick tiles, and windows are
cut out of the arrays; no cell index is stored or filtered.

Face results use the same form with one row of faces (``row`` 0, ``col`` the face's number); they are never
expanded to cells.

A write puts data and manifest into folders of a new generation and publishes it last, by one small file. What
was not published is not read. Of several generations of one run the latest counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tarnfield import config
from tarnfield.operators.grid import GridSpec
from tarnfield.sources.cube import EmptyWindow

VARIABLES = ("h", "u", "v")
GROUP = 8  # tiles along each side of the square of tiles that one task packs into one file
TIMES = 64  # times of a tile that one task packs, where a tile's whole time line lies together
SPANS = {"frame": (GROUP, 1), "series": (1, TIMES)}
ROW_GROUP = 16 << 20
MANIFEST = "path string, run_id string, t_min int, t_max int, trow_min int, trow_max int, tcol_min int, tcol_max int, tiles long, cells long"
HEAD = "run_id string, t int, trow int, tcol int, cells int, present binary"
HEAD_NAMES = ("run_id", "t", "trow", "tcol", "cells", "present")
FOLDERS = ("p_run", "p_times", "p_grow", "p_gcol")  # of a file: one square of tiles of one time span


def _relative() -> Column:
    """Path of a row's file below the cube's data folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/data/(gen=\d{6}-[0-9a-f]{8}/.*)$", 1)


class BrokenCube(ValueError):
    """Cells given twice, a folder without a published generation, or files that differ from the manifest."""


def _sides(tile: int | tuple[int, int]) -> tuple[int, int]:
    return tile if isinstance(tile, tuple) else (tile, tile)


def _fragments(frames: DataFrame, variables: tuple[str, ...], tile: tuple[int, int], span: tuple[int, int], dtype: str) -> DataFrame:
    """Cells of each input batch packed by (run, time span, square of tiles): few rows leave the map side."""
    high, wide = tile
    side, times = span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0).dictionary_encode()
            t, row, col = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
            if min(t.min(), row.min(), col.min()) < 0:
                raise BrokenCube("negative time, row or column")
            trow, tcol = row // high, col // wide
            keys = np.stack([runs.indices.to_numpy().astype(np.int64), t // times, trow // side, tcol // side])
            inner = ((t % times * side + trow % side) * side + tcol % side) * (high * wide) + row % high * wide + col % wide
            order = np.lexsort(keys[::-1])
            keys, inner = keys[:, order], inner[order]
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            ends = np.r_[starts[1:], len(inner)]
            packed = {"at": inner.astype(np.int64)}
            for k, name in enumerate(variables):
                packed[name] = batch.column(4 + k).to_numpy(zero_copy_only=False).astype(dtype)[order]
            data = {"run_id": runs.dictionary.take(pa.array(keys[0, starts]))}
            data |= {n: pa.array(keys[k, starts].astype(np.int32)) for k, n in ((1, "times"), (2, "grow"), (3, "gcol"))}
            data |= {n: pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for n, v in packed.items()}
            yield pa.RecordBatch.from_pydict(data)

    chosen = frames.select(
        F.col("run_id").cast("string"),
        *[F.col(k).cast("int") for k in ("t", "row", "col")],
        *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in variables],
    )
    arrays = ", ".join(f"{v} binary" for v in ("at", *variables))
    return chosen.mapInArrow(run, f"run_id string, times int, grow int, gcol int, {arrays}")


def _tiles(fragments: DataFrame, variables: tuple[str, ...], tile: tuple[int, int], span: tuple[int, int], grid: GridSpec, dtype: str) -> DataFrame:
    """Tile rows out of fragments; a group holds at most ``side * side * times`` tiles."""
    high, wide = tile
    side, times = span

    def pack(rows: pa.Table) -> pa.Table:
        run_id, first, grow, gcol = (rows.column(k)[0].as_py() for k in range(4))
        joined = {n: b"".join(rows.column(n).to_pylist()) for n in ("at", *variables)}
        at = np.frombuffer(joined["at"], np.int64)
        which, cell = at // (high * wide), at % (high * wide)
        order = np.argsort(which, kind="stable")
        which, cell = which[order], cell[order]
        values = {n: np.frombuffer(joined[n], dtype)[order] for n in variables}
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        out: dict[str, list] = {n: [] for n in ("run_id", "t", "trow", "tcol", "cells", "present", *variables)}
        for a, b in zip(starts, np.r_[starts[1:], len(which)]):
            number = int(which[a])
            t = first * times + number // (side * side)
            trow, tcol = grow * side + number // side % side, gcol * side + number % side
            rows_here, cols_here = min(high, grid.height - trow * high), min(wide, grid.width - tcol * wide)
            if rows_here <= 0 or cols_here <= 0:
                raise BrokenCube(f"cells of tile {trow}, {tcol} lie outside the grid")
            there = np.zeros(high * wide, dtype=bool)
            there[cell[a:b]] = True
            cut = there.reshape(high, wide)[:rows_here, :cols_here]
            if there.sum() != b - a or cut.sum() != b - a:
                raise BrokenCube(f"run {run_id}, time {t}, tile {trow}, {tcol}: a cell comes twice or lies outside the grid")
            for name in variables:
                array = np.full(high * wide, np.nan, dtype)
                array[cell[a:b]] = values[name][a:b]
                out[name].append(array.reshape(high, wide)[:rows_here, :cols_here].tobytes())
            for name, value in (("run_id", run_id), ("t", t), ("trow", trow), ("tcol", tcol), ("cells", int(b - a))):
                out[name].append(value)
            out["present"].append(np.packbits(cut.ravel()).tobytes())
        return pa.table(out, schema=pa.schema(
            [("run_id", pa.string()), *[(n, pa.int32()) for n in ("t", "trow", "tcol", "cells")], ("present", pa.binary())]
            + [(n, pa.binary()) for n in variables]
        ))

    schema = f"{HEAD}, {', '.join(f'{v} binary' for v in variables)}"
    return fragments.groupBy("run_id", "times", "grow", "gcol").applyInArrow(pack, schema)


def packed_tiles(
    frames: DataFrame, variables: tuple[str, ...], tile: int | tuple[int, int], grid: GridSpec, dtype: str, layout: str = "frame"
) -> DataFrame:
    """Tile rows of a cell table (``run_id, t, row, col`` and variables), not yet stored."""
    sides, span = _sides(tile), SPANS[layout]
    return _tiles(_fragments(frames, variables, sides, span, dtype), variables, sides, span, grid, dtype)


class DenseCube:
    """A published cube: its document, its manifest, and reads of windows, points and whole tiles."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            published = spark.read.schema("generation string, number long, document string").parquet(f"{self.path}/published")
            rows = published.orderBy("number").collect()  # one row per write
        except AnalysisException:
            rows = []
        if not rows:
            raise BrokenCube(f"nothing is published in {path}")
        self.document = json.loads(rows[-1]["document"])
        self.tile = tuple(self.document["tile"])
        self.grid = GridSpec(self.document["width"], self.document["height"])
        self.variables = tuple(self.document["variables"])
        self.dtype = np.dtype(self.document["dtype"])
        listed = spark.read.schema(f"{MANIFEST}, number long").parquet(*[f"{self.path}/manifest/{r['generation']}" for r in rows])
        if len(rows) > 1:
            latest = listed.groupBy("run_id").agg(F.max("number").alias("number"))
            listed = listed.join(latest, ["run_id", "number"])
        self.manifest = listed

    @property
    def schema(self) -> str:
        return f"{HEAD}, {', '.join(f'{v} binary' for v in self.variables)}"

    def _ranges(self, rows: tuple[int, int], cols: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Tile ranges, ends included, of half-open ranges clamped to the grid."""
        (r0, r1), (c0, c1) = self._clamped(rows, cols)
        return (r0 // self.tile[0], (r1 - 1) // self.tile[0]), (c0 // self.tile[1], (c1 - 1) // self.tile[1])

    def _clamped(self, rows: tuple[int, int], cols: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        r0, r1 = max(0, rows[0]), min(self.grid.height, rows[1])
        c0, c1 = max(0, cols[0]), min(self.grid.width, cols[1])
        if r0 >= r1 or c0 >= c1:
            raise EmptyWindow(f"rows={rows} cols={cols}")
        return (r0, r1), (c0, c1)

    def tiles(self, t: int | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, run_id: str | None = None) -> DataFrame:
        """Tile rows that meet the window; only files whose ranges meet it are opened."""
        files, wanted = F.lit(True), F.lit(True)
        if run_id is not None:
            files &= F.col("run_id") == run_id
            wanted &= F.col("run_id") == run_id
        if t is not None:
            if t < 0:
                raise EmptyWindow(f"t={t}")
            files &= F.lit(t).between(F.col("t_min"), F.col("t_max"))
            wanted &= F.col("t") == t
        whole = (0, self.grid.height), (0, self.grid.width)
        for name, (low, high) in zip(("trow", "tcol"), self._ranges(rows or whole[0], cols or whole[1])):
            files &= (F.col(f"{name}_max") >= low) & (F.col(f"{name}_min") <= high)
            wanted &= F.col(name).between(low, high)
        if t is None and rows is None and cols is None and run_id is None:
            # No window: the folders of the published generations, without a list of files on the driver.
            whose = self.manifest.select("run_id", "number").distinct()
            found = self._generations()
            if not found:
                return self.spark.createDataFrame([], self.schema)
            stored = self._stored(found)
            if len(found) > 1:  # of a run that was written again, only its latest generation
                stored = stored.withColumn("number", F.substring("gen", 1, 6).cast("long")).join(whose, ["run_id", "number"])
            return stored.select(*HEAD_NAMES, *self.variables)
        names = [r[0] for r in self.manifest.filter(files).select("path").collect()]  # as many as the window needs
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names]).filter(wanted)

    def _generations(self) -> list[str]:
        """Folders of the manifest's files, one per write."""
        return [r[0] for r in self.manifest.select(F.substring_index("path", "/", 1)).distinct().collect()]

    def _stored(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{g}" for g in folders])

    def cells(self, tiles: DataFrame, variables: tuple[str, ...] | None = None, rows=None, cols=None) -> DataFrame:
        """Given cells of tile rows as ``run_id, t, row, col`` and values, cut to the window."""
        names = variables or self.variables
        high, wide = self.tile
        grid, dtype = self.grid, self.dtype
        (r0, r1), (c0, c1) = self._clamped(rows or (0, grid.height), cols or (0, grid.width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    t, trow, tcol = (batch.column(n)[k].as_py() for n in ("t", "trow", "tcol"))
                    shape = min(high, grid.height - trow * high), min(wide, grid.width - tcol * wide)
                    bits = np.frombuffer(batch.column("present")[k].as_buffer(), np.uint8)
                    there = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool)
                    a, b = max(0, r0 - trow * high), max(0, c0 - tcol * wide)
                    cut = (slice(a, min(shape[0], r1 - trow * high)), slice(b, min(shape[1], c1 - tcol * wide)))
                    r, c = np.nonzero(there[cut])
                    data = {
                        "run_id": pa.array([batch.column("run_id")[k].as_py()] * len(r), pa.string()),
                        "t": pa.array(np.full(len(r), t, np.int32)),
                        "row": pa.array((r + a + trow * high).astype(np.int32)),
                        "col": pa.array((c + b + tcol * wide).astype(np.int32)),
                    }
                    for name in names:
                        values = np.frombuffer(batch.column(name)[k].as_buffer(), dtype).reshape(shape)[cut][r, c]
                        data[name] = pa.array(values, mask=np.isnan(values))
                    yield pa.RecordBatch.from_pydict(data)

        kind = "float" if dtype == np.float32 else "double"
        schema = "run_id string, t int, row int, col int, " + ", ".join(f"{n} {kind}" for n in names)
        return tiles.select("run_id", "t", "trow", "tcol", "present", *names).mapInArrow(run, schema)

    def window(self, t: int, rows: tuple[int, int], cols: tuple[int, int], variables=None, run_id: str | None = None) -> DataFrame:
        """One frame, half-open ranges clamped to the grid, as cell rows."""
        return self.cells(self.tiles(t, rows, cols, run_id), variables, rows, cols)

    def window_arrays(self, t: int, rows: tuple[int, int], cols: tuple[int, int], variables=None, run_id: str | None = None) -> dict[str, np.ndarray]:
        """One frame's window as arrays in hand, one per variable; NaN where nothing was given."""
        names = variables or self.variables
        (r0, r1), (c0, c1) = self._clamped(rows, cols)
        high, wide = self.tile
        out = {n: np.full((r1 - r0, c1 - c0), np.nan, self.dtype) for n in names}
        found = self.tiles(t, rows, cols, run_id).select("trow", "tcol", *names).toArrow()
        for k in range(found.num_rows):
            trow, tcol = found.column("trow")[k].as_py(), found.column("tcol")[k].as_py()
            top, left = trow * high, tcol * wide
            shape = min(high, self.grid.height - top), min(wide, self.grid.width - left)
            a, b = slice(max(0, r0 - top), min(shape[0], r1 - top)), slice(max(0, c0 - left), min(shape[1], c1 - left))
            to = slice(top + a.start - r0, top + a.stop - r0), slice(left + b.start - c0, left + b.stop - c0)
            for name in names:
                values = np.frombuffer(found.column(name)[k].as_buffer(), self.dtype).reshape(shape)
                out[name][to] = values[a, b]
        return out

    def point_series(self, row: int, col: int, variables: tuple[str, ...] = ("h",), run_id: str | None = None) -> DataFrame:
        """All times at one cell, in order."""
        if not (0 <= row < self.grid.height and 0 <= col < self.grid.width):
            raise EmptyWindow(f"row={row} col={col}")
        one = (row, row + 1), (col, col + 1)
        return self.cells(self.tiles(None, *one, run_id), variables, *one).select("run_id", "t", *variables).orderBy("run_id", "t")

    def totals(self) -> DataFrame:
        """Per run and time: tiles, given cells, finite values and sums, folded inside the scan tasks without cell rows."""
        names, dtype = self.variables, self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data: dict[str, list] = {n: [] for n in ("run_id", "t", "tiles", "cells")}
                for name in names:
                    data |= {f"{name}_n": [], f"{name}_sum": [], f"{name}_max": []}
                for k in range(batch.num_rows):
                    for n in ("run_id", "t", "cells"):
                        data[n].append(batch.column(n)[k].as_py())
                    data["tiles"].append(1)
                    for name in names:
                        values = np.frombuffer(batch.column(name)[k].as_buffer(), dtype)
                        values = values[~np.isnan(values)]
                        data[f"{name}_n"].append(len(values))
                        data[f"{name}_sum"].append(float(values.sum(dtype=np.float64)))
                        data[f"{name}_max"].append(float(values.max()) if len(values) else None)
                types = {"run_id": pa.string(), "t": pa.int32()}
                kinds = {n: types.get(n, pa.float64() if n.endswith(("_sum", "_max")) else pa.int64()) for n in data}
                yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in data.items()})

        schema = "run_id string, t int, tiles long, cells long"
        for name in names:
            schema += f", {name}_n long, {name}_sum double, {name}_max double"
        made = self.tiles().select("run_id", "t", "cells", *names).mapInArrow(run, schema)
        sums = [F.sum(c).alias(c) for c in ("tiles", "cells", *[f"{n}{k}" for n in names for k in ("_n", "_sum")])]
        return made.groupBy("run_id", "t").agg(*sums, *[F.max(f"{n}_max").alias(f"{n}_max") for n in names])

    def verify(self) -> DataFrame:
        """Per manifest file, what its rows hold against what the manifest says: ``path``, ``listed``, ``found``, ``whole``."""
        stored = self._stored(self._generations()).groupBy(_relative().alias("path")).agg(F.sum("cells").alias("found"))
        met = self.manifest.select("path", F.col("cells").alias("listed")).join(stored, "path", "left")
        return met.withColumn("whole", F.coalesce(F.col("listed") == F.col("found"), F.lit(False)))


def write_dense(
    frames: DataFrame,
    path: str,
    grid: GridSpec,
    tile: int | tuple[int, int] = config.TILE,
    variables: tuple[str, ...] = VARIABLES,
    dtype: str = "float32",
    layout: str = "frame",
    document: dict | None = None,
) -> DenseCube:
    """Store ``run_id, t, row, col`` and variables as dense tiles and publish them.

    ``frame`` keeps a frame's neighbouring tiles in one file, for windows; ``series`` keeps a tile's times
    together, for points. Either way one task packs a bounded square of tiles.
    """
    if layout not in SPANS:
        raise ValueError("layout is frame or series")
    spark, path = frames.sparkSession, path.rstrip("/")
    span, sides = SPANS[layout], _sides(tile)
    try:
        number = 1 + spark.read.schema("number long").parquet(f"{path}/published").agg(F.max("number")).first()[0]
    except AnalysisException:
        number = 0
    generation = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    packed = packed_tiles(frames, variables, tile, grid, dtype, layout)
    folder = f"{path}/data/gen={generation}"
    places = dict(zip(FOLDERS, (
        F.hex(F.xxhash64("run_id")),
        F.floor(F.col("t") / span[1]),
        F.floor(F.col("trow") / span[0]),
        F.floor(F.col("tcol") / span[0]),
    )))
    writer = packed.withColumns(places).write.partitionBy(*FOLDERS).option("parquet.block.size", ROW_GROUP)
    writer.option("parquet.enable.dictionary", "false").parquet(folder)  # arrays do not repeat
    stored = spark.read.schema(f"{HEAD}, {', '.join(f'{v} binary' for v in variables)}").parquet(folder)
    ends = [f(F.col(c)).alias(f"{c}_{n}") for c in ("t", "trow", "tcol") for n, f in (("min", F.min), ("max", F.max))]
    listed = stored.groupBy(_relative().alias("path"), "run_id").agg(
        *ends, F.count(F.lit(1)).alias("tiles"), F.sum("cells").cast("long").alias("cells")
    )
    listed.withColumn("number", F.lit(number).cast("long")).write.parquet(f"{path}/manifest/{generation}")
    described = {
        "schema_version": "1", "tile": list(sides), "width": grid.width, "height": grid.height,
        "variables": list(variables), "dtype": dtype, "layout": layout, **(document or {}),
    }
    row = [(generation, number, json.dumps(described, sort_keys=True))]
    spark.createDataFrame(row, "generation string, number long, document string").coalesce(1).write.mode("append").parquet(f"{path}/published")
    return DenseCube(spark, path)


def write_faces(frames: DataFrame, path: str, faces: DataFrame, block: int = 65_536, document: dict | None = None, **more) -> DenseCube:
    """Store ``run_id, t, face`` and variables in blocks of faces, with the static face table beside them."""
    count = faces.agg(F.max("face")).first()[0] + 1
    beside = f"{path.rstrip('/')}/faces/{uuid.uuid4().hex[:8]}"
    faces.write.parquet(beside)
    rows = frames.withColumns({"row": F.lit(0), "col": F.col("face")})
    told = {"storage_kind": "face", "faces": count, "face_table": beside.rsplit("/", 1)[1], **(document or {})}
    return write_dense(rows, path, GridSpec(count, 1), (1, block), document=told, **more)


def face_cells(cube: DenseCube, t: int | None = None, faces: tuple[int, int] | None = None, variables=None) -> DataFrame:
    """``run_id, t, face`` and values of a face cube, cut to a half-open range of faces."""
    found = cube.cells(cube.tiles(t, None, faces), variables, None, faces)
    return found.drop("row").withColumnRenamed("col", "face")
