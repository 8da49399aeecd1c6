"""Helpers shared by the pipeline operators: tables in the shared folder, splits, global ranks, components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.runtime import scratch_path

ROWS_PER_BUCKET = 2_000
BATCH = 4 << 20  # bytes of rows that a Python worker is sent at once where texts are long
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(module: str) -> None:
    """Send functions of ``module`` to the executors by value, so that they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; lost executors cost no recomputation of it.

    With ``batch``, Python workers of this write get batches of about so many bytes instead of a whole file split.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    conf.set(BATCH_BYTES, str(batch or before))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, also where a name holds a dot or a backtick."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def apart(docs: DataFrame, used: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on documents whose columns besides ``used`` have names that no operator uses.

    The given names and order come back, followed by the columns that the step adds; a given column of the
    name of an added one is replaced by it, and columns that the step drops are gone.
    """
    names = [c if c in used else f"given {i}" for i, c in enumerate(docs.columns)]
    out = step(docs.toDF(*names))
    added = [c for c in out.columns if c not in names]
    kept = [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns) if n in out.columns and c not in added]
    return out.select(*kept, *quoted(added))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def over_batches(df: DataFrame, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """``mapInArrow`` where ``start()`` runs once per task and gives a function from a batch to a dict of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            yield pa.RecordBatch.from_pydict(step(batch))

    return df.mapInArrow(run, schema)


def over_parts(df: DataFrame, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Like ``over_batches``, for functions that give several dicts of arrays for a batch, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in step(batch):
                yield pa.RecordBatch.from_pydict(part)

    return df.mapInArrow(run, schema)


def raw(batch: pa.RecordBatch, name: str) -> list:
    """A text column as UTF-8 bytes (or None), without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def numbered(
    df: DataFrame, place: Column, order: list[Column], out: str, rows: int, within: list[str] | None = None
) -> DataFrame:
    """Gapless ``out`` from 0 in the order (``place``, ``order``), for ``place`` spread evenly over [0, 1).

    The unit interval is cut into buckets that grow in number with the rows. Each bucket is ranked by
    itself and shifted by the rows of the buckets before it, so no window holds a whole key or table;
    ``within`` restarts the numbers per key. The table of bucket sizes has rows / 2000 entries per key.
    """
    keys = within or []
    buckets = max(1, rows // ROWS_PER_BUCKET)
    cut = df.withColumn("_bucket", F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("long"))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_bucket")
    else:
        before = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(place, *order)) - 1)
    on = F.lit(True)
    renamed = shifts.select(*[F.col(k).alias(f"_{i}_key") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_shift")
    for i, k in enumerate(keys):
        on = on & local[k].eqNullSafe(renamed[f"_{i}_key"])
    joined = local.join(renamed, on & (local["_bucket"] == renamed["_b"]))
    return joined.withColumn(out, (F.col(out) + F.col("_shift")).cast("long")).select(*quoted(df.columns), out)


def connected(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (a, b): ``id``, ``component`` (smallest id), for ids that have an edge.

    Alternates two star steps on min aggregates and joins, each written to the shared folder: every
    larger neighbour hangs on the smallest neighbour of its centre, then every smaller one does.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, seen = table(both, "links"), None
    while True:
        mirrored = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = mirrored.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        links = table(small.select("e.*").filter("u <> v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    leaves = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def appended(df: DataFrame, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """``df`` with further columns made from whole batches; earlier columns of those names are replaced.

    ``start()`` runs once per task and gives a function from a batch to the new arrays, in schema order.
    """
    added = df.sparkSession.createDataFrame([], schema).schema
    kept = df.select(*quoted([c for c in df.columns if c not in added.names]))
    whole = type(added)([*kept.schema.fields, *added.fields])
    plain = kept.toDF(*[f"_{i}" if "." in c or "`" in c else c for i, c in enumerate(kept.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            new = step(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=whole.names)

    return plain.mapInArrow(run, whole)


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them picked by a hash of ``key`` where there are more."""
    rows = df.count()
    if rows <= most:
        return df
    share = int(0.99 * most / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share).limit(most)


def slices(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[slice]:
    """Consecutive slices of whole texts with about ``most`` bytes each; one empty slice for an empty list."""
    at = 0
    while at < len(texts) or at == 0:
        end, size = at, 0
        while end < len(texts) and (end == at or size < most):
            size += len(texts[end] or b"")
            end += 1
        yield slice(at, end)
        if end == at:
            break
        at = end
