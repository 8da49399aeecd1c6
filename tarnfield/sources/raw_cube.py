"""``raw_cube``: a data source over raw float32 cubes, for reading and writing.

Two forms are read. *Flat*: one file per variable, an array (time, row, col), with the option ``shape``.
*Chunked*, which is also what is written: each task appends its chunks to one file and lists beside it where each
chunk lies and which values it holds; the commit moves the files into place and publishes their names last. A job
that fails leaves nothing that is read. A reading task takes many small chunks, some megabytes together.

Comparisons on the axes become chunk and byte ranges; those on a value skip chunks whose range cannot meet
them. Bytes are read by offset from any file system that Arrow opens by its address (local, HDFS, S3); nothing
is mapped into memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tarnfield import config
from tarnfield.operators.grid import GridSpec
from tarnfield.sources import dense

AXES = ("t", "row", "col")
INDEX = "chunks.json"
PENDING = "_pending-"
LIST = ".chunks"  # ending of the list of a file's chunks, an Arrow file
RANGES = ("t_from", "t_to", "row_from", "row_to", "col_from", "col_to")
TOLD = ("offset", "min", "max", "count")  # of each variable of a chunk
LEAST_PARTS = 64  # fewer chunks than this are read by a task each
PART_BYTES = 32 << 20
BATCH_ROWS = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; ``file:/x`` and plain paths are local."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def listed_names(options) -> list[str]:
    names = [n.strip() for n in options.get("variables", "h").split(",")]
    if ("u" in names) != ("v" in names):
        raise ValueError("velocity needs both u and v")
    return names


@dataclass
class Chunks(InputPartition):
    """Stored chunks that one task reads: half-open index ranges along time, rows and columns, and where the bytes are.

    ``whole`` has a row of six numbers per chunk (t, row and col, each from and to), ``cut`` the same within the
    window; ``files`` are the files of a variable by number, ``at`` the file number and offset of each chunk in them.
    """

    whole: np.ndarray
    cut: np.ndarray
    files: dict[str, list[str]]
    at: dict[str, np.ndarray]


class RawCubeReader(DataSourceReader):
    """Input partitions of some megabytes out of the chunks that meet the filters."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.names = listed_names(options)
        files, root = opened(self.path)
        self.listed, self.files = None, []
        self.stored = "shape" not in options
        if self.stored:
            with files.open_input_stream(f"{root}/{INDEX}") as f:
                index = json.loads(f.read())
            lacking = set(self.names) - set(index["variables"])
            if lacking:
                raise ValueError(f"the cube holds no {sorted(lacking)}")
            self.shape = tuple(index["shape"])
            self.files = index["files"]
            self.listed = self._lists(files, root)
        else:
            self.shape = tuple(int(v) for v in options["shape"].split(","))
            self.chunk = tuple(int(v) for v in options.get("chunk", "1,256,256").split(","))
            expected = int(np.prod(self.shape)) * 4
            for name in self.names:
                size = files.get_file_info(f"{root}/{name}.f32").size
                if size != expected:
                    raise ValueError(f"{name}: {size} bytes, expected {expected} for shape {self.shape}")
        self.window = [[0, n] for n in self.shape]
        self.values: dict[str, list[float]] = {}  # variable to (at least, at most)

    def __getstate__(self) -> dict:
        """Tasks get the chunks that they read with their partition; the lists stay behind."""
        return {**self.__dict__, "listed": None, "files": []}

    def _lists(self, files: fs.FileSystem, root: str) -> dict[str, np.ndarray]:
        """The chunk lists of all files as one array per column, with the number of the file."""
        wanted = [*RANGES, *[f"{n}_{k}" for n in self.names for k in TOLD]]
        found = {c: [] for c in ("file", *wanted)}
        for number, name in enumerate(self.files):
            with files.open_input_file(f"{root}/{name}{LIST}") as f:
                told = pa.ipc.open_file(f).read_all()
            found["file"].append(np.full(told.num_rows, number, np.int64))
            for c in wanted:
                found[c].append(told.column(c).to_numpy())
        return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons on the axes shrink the window; those on values choose chunks and go back to Spark too."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            known = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None
            if name in AXES and known:
                low, high = self.window[AXES.index(name)]
                least = {EqualTo: f.value, GreaterThanOrEqual: f.value, GreaterThan: f.value + 1}.get(type(f), low)
                most = {EqualTo: f.value + 1, LessThan: f.value, LessThanOrEqual: f.value + 1}.get(type(f), high)
                self.window[AXES.index(name)] = [max(low, least), min(high, most)]
                continue
            if name in self.names and known:
                bounds = self.values.setdefault(name, [-np.inf, np.inf])
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    bounds[0] = max(bounds[0], f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    bounds[1] = min(bounds[1], f.value)
            yield f

    def partitions(self) -> list[Chunks]:
        found = self._stored() if self.stored else self._flat()
        low, high = found.cut[:, 0::2], found.cut[:, 1::2]
        met = np.flatnonzero((low < high).all(axis=1))
        sizes = np.prod(np.maximum(high - low, 0), axis=1)[met] * 4 * len(self.names)
        if not self.stored:  # the caller sized these
            parts = [met[k : k + 1] for k in range(len(met))]
        else:
            wanted = max(min(len(met), LEAST_PARTS), int(sizes.sum() // PART_BYTES))
            upto = np.cumsum(sizes) - sizes  # files are read from front to back
            number = upto * wanted // max(1, int(sizes.sum()))
            parts = np.split(met, np.flatnonzero(np.diff(number)) + 1) if len(met) else []
        return [self._part(found, p) for p in parts]

    def _part(self, found: Chunks, chosen: np.ndarray) -> Chunks:
        """Some of the chunks, with the names of their own files only."""
        files, at = {}, {}
        for name in self.names:
            numbers, own = np.unique(found.at[name][chosen, 0], return_inverse=True)
            files[name] = [found.files[name][n] for n in numbers]
            at[name] = np.stack([own, found.at[name][chosen, 1]], axis=1)
        return Chunks(found.whole[chosen], found.cut[chosen], files, at)

    def _cut(self, whole: np.ndarray) -> np.ndarray:
        low, high = np.array(self.window, dtype=np.int64).T
        cut = whole.copy()
        cut[:, 0::2] = np.maximum(whole[:, 0::2], low)
        cut[:, 1::2] = np.minimum(whole[:, 1::2], high)
        return cut

    def _flat(self) -> Chunks:
        spans = [
            [(a, min(n, a + step)) for a in range(low // step * step, high, step)]
            for (low, high), step, n in zip(self.window, self.chunk, self.shape)
        ]
        ranges = np.array([(*t, *r, *c) for t in spans[0] for r in spans[1] for c in spans[2]], dtype=np.int64).reshape(-1, 6)
        whole = np.tile(np.array([v for n in self.shape for v in (0, n)], dtype=np.int64), (len(ranges), 1))
        at = {n: np.zeros((len(ranges), 2), dtype=np.int64) for n in self.names}
        return Chunks(whole, self._cut(ranges), {n: [f"{n}.f32"] for n in self.names}, at)

    def _stored(self) -> Chunks:
        told, may = self.listed, np.ones(len(self.listed["file"]), dtype=bool)
        for name, (low, high) in self.values.items():
            may &= (told[f"{name}_max"] >= low) & (told[f"{name}_min"] <= high)  # NaN where there is no value
        whole = np.stack([told[c] for c in RANGES], axis=1).astype(np.int64)[may]
        at = {n: np.stack([told["file"], told[f"{n}_offset"]], axis=1).astype(np.int64)[may] for n in self.names}
        return Chunks(whole, self._cut(whole), dict.fromkeys(self.names, self.files), at)

    def read(self, part: Chunks | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there are no partitions
            return
        files, root = opened(self.path)
        held: dict[str, tuple[str, pa.NativeFile]] = {}  # the open file of each variable
        rows: list[dict[str, np.ndarray]] = []
        count = 0

        def data(name: str, at: np.ndarray, offset: int, size: int) -> bytes:
            path = f"{root}/{part.files[name][at[0]]}"
            if name not in held or held[name][0] != path:
                if name in held:
                    held[name][1].close()
                held[name] = path, files.open_input_file(path)
            return held[name][1].read_at(size, int(at[1]) + offset)

        try:
            for k in range(len(part.whole)):
                first, _, r0, r1, c0, c1 = part.whole[k].tolist()
                t0, t1, low_r, high_r, low_c, high_c = part.cut[k].tolist()
                width = c1 - c0
                for t in range(t0, t1):
                    columns, kept = {}, np.zeros((high_r - low_r, high_c - low_c), dtype=bool)
                    # whole rows of the stored array are one byte range
                    start = ((t - first) * (r1 - r0) + low_r - r0) * width
                    for name in self.names:
                        found = data(name, part.at[name][k], start * 4, (high_r - low_r) * width * 4)
                        columns[name] = np.frombuffer(found, "<f4").reshape(-1, width)[:, low_c - c0 : high_c - c0]
                        kept |= ~np.isnan(columns[name])
                    if not self.stored:
                        kept[:] = True
                    r, c = np.nonzero(kept)
                    axes = {"t": np.full(len(r), t, np.int32), "row": (r + low_r).astype(np.int32), "col": (c + low_c).astype(np.int32)}
                    rows.append({**axes, **{n: a[r, c] for n, a in columns.items()}})
                    count += len(r)
                    if count >= BATCH_ROWS:
                        yield self._batch(rows)
                        rows, count = [], 0
            if count:
                yield self._batch(rows)
        finally:
            for _, file in held.values():
                file.close()

    def _batch(self, rows: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        joined = {n: np.concatenate([r[n] for r in rows]) for n in rows[0]}
        absent = {n: np.isnan(joined[n]) if self.stored and n in self.names else None for n in joined}
        return pa.RecordBatch.from_pydict({n: pa.array(v, mask=absent[n]) for n, v in joined.items()})


@dataclass
class Written(WriterCommitMessage):
    """File of one task and how many chunks it holds; their list lies beside it."""

    file: str
    chunks: int


class RawCubeWriter(DataSourceArrowWriter):
    """Rows are packed chunks (``t, trow, tcol`` and one binary per variable), as ``write_raw`` makes them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.names = options["path"].rstrip("/"), listed_names(options)
        self.shape = [int(v) for v in options["shape"].split(",")]
        self.tile = [int(v) for v in options["tile"].split(",")]
        self.job, self.overwrite = uuid.uuid4().hex[:12], overwrite
        files, root = opened(self.path)
        if not overwrite and files.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a cube already")

    def _list_schema(self) -> pa.Schema:
        kinds = {"offset": pa.int64(), "min": pa.float64(), "max": pa.float64(), "count": pa.int64()}
        return pa.schema([(c, pa.int32()) for c in RANGES] + [(f"{n}_{k}", kinds[k]) for n in self.names for k in TOLD])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        folder, schema = f"{root}/{PENDING}{self.job}", self._list_schema()
        files.create_dir(folder, recursive=True)
        name, chunks, at = f"{uuid.uuid4().hex}.f32", 0, 0
        with files.open_output_stream(f"{folder}/{name}") as out, files.open_output_stream(f"{folder}/{name}{LIST}") as listing:
            with pa.ipc.new_file(listing, schema) as told:
                for batch in iterator:
                    lines = []
                    heads = zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("t", "trow", "tcol")])
                    arrays = {n: batch.column(batch.schema.get_field_index(n)) for n in self.names}
                    for k, (t, trow, tcol) in enumerate(heads):
                        ends = [(i * s, min(n, (i + 1) * s)) for i, s, n in zip((trow, tcol), self.tile, self.shape[1:])]
                        line = [t, t + 1, *ends[0], *ends[1]]
                        for variable in self.names:
                            data = arrays[variable][k].as_py()
                            values = np.frombuffer(data, "<f4")
                            real = values[~np.isnan(values)]
                            span = (float(real.min()), float(real.max())) if len(real) else (float("nan"),) * 2
                            line += [at, *span, len(real)]
                            out.write(data)
                            at += len(data)
                        lines.append(line)
                    if lines:
                        columns = [pa.array(c, f.type) for c, f in zip(zip(*lines), schema)]
                        told.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
                        chunks += len(lines)
        return Written(name, chunks)

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of the tasks that count into place, then publish their names by one rename."""
        files, root = opened(self.path)
        data = f"data-{self.job}"
        files.create_dir(f"{root}/{data}", recursive=True)
        kept = sorted(m.file for m in messages if m is not None and m.chunks)
        for name in kept:
            for ending in ("", LIST):
                files.move(f"{root}/{PENDING}{self.job}/{name}{ending}", f"{root}/{data}/{name}{ending}")
        told = {"shape": self.shape, "variables": self.names, "files": [f"{data}/{name}" for name in kept]}
        with files.open_output_stream(f"{root}/{INDEX}.{self.job}") as out:
            out.write(json.dumps(told).encode())
        files.move(f"{root}/{INDEX}.{self.job}", f"{root}/{INDEX}")
        self._leave(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._leave(*opened(self.path))

    def _leave(self, files: fs.FileSystem, root: str) -> None:
        """Drop what tasks of this job left behind, those that failed or ran twice included."""
        folder = f"{root}/{PENDING}{self.job}"
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class RawCube(DataSource):
    """``spark.read.format("raw_cube")`` with options path and variables (and shape, chunk for the flat form)."""

    @classmethod
    def name(cls) -> str:
        return "raw_cube"

    def schema(self) -> str:
        return "t int, row int, col int, " + ", ".join(f"{n} float" for n in listed_names(self.options))

    def reader(self, schema) -> RawCubeReader:
        return RawCubeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawCubeWriter:
        return RawCubeWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """Make the format known; filters on the axes then prune chunks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawCube)


def write_raw(
    frames: DataFrame, path: str, grid: GridSpec, times: int, tile: int = config.TILE, variables: tuple[str, ...] = ("h", "u", "v"), mode: str = "error"
) -> None:
    """Store ``t, row, col`` and variables as a raw cube; cells that are absent, and null values, become NaN."""
    register(frames.sparkSession)
    one = frames.withColumns({"run_id": F.lit("")})
    packed = dense.packed_tiles(one, variables, tile, grid, "float32").select("t", "trow", "tcol", *variables)
    options = {"path": path, "variables": ",".join(variables), "shape": f"{times},{grid.height},{grid.width}", "tile": f"{tile},{tile}"}
    writer = packed.write.format("raw_cube").options(**options)
    writer.mode("overwrite" if mode == "overwrite" else "append").save()
