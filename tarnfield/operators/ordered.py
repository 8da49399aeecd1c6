"""Ordered computations that never put one key, or the whole table, into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.runtime import cut_lineage

ROWS_PER_SLICE = 500_000


def slice_by_value(df: DataFrame, order: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_slice``: consecutive value ranges of roughly equal row counts.

    The bounds are quantiles held as literals, so a recomputed task slices the same way.
    """
    rows = df.count() if rows is None else rows
    wanted = max(1, rows // ROWS_PER_SLICE)
    if wanted == 1:
        return df.withColumn("_slice", F.lit(0.0)), 1
    cuts = df.approxQuantile(order, [i / wanted for i in range(1, wanted)], 0.2 / wanted)
    bounds = [-float("inf"), *sorted(set(cuts)), float("inf")]
    sliced = Bucketizer(splits=bounds, inputCol=order, outputCol="_slice").transform(df)
    return sliced, len(bounds) - 1


def running_total(df: DataFrame, order: str, amount: str, out: str, rows: int | None = None) -> DataFrame:
    """Inclusive running sum of ``amount`` over distinct ascending ``order`` values.

    Slices are summed first; each slice then adds the total of the slices before it. The table
    of slice totals has one row of two numbers per 500 000 rows (1 MB at 3e10 rows), which bounds the broadcast.
    """
    keyed = df.withColumn("_order", F.col(order).cast("double"))
    sliced, n = slice_by_value(keyed, "_order", rows)
    within = Window.partitionBy("_slice").orderBy("_order")
    local = sliced.withColumn("_local", F.sum(amount).over(within))
    if n == 1:
        return local.withColumn(out, F.col("_local")).drop("_local", "_slice", "_order")
    totals = sliced.groupBy("_slice").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = local.join(F.broadcast(offsets), "_slice")
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_slice", "_order")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row with the columns of all; no join."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


BUCKETS = 1 << 16
ROUNDS = 2  # the second looks at the chosen parts by their own range


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles as one row; a lazy plan without a job of its own. NULL where df is empty.

    Selection by digits: values are counted in ``BUCKETS`` equal parts of their range, the parts that hold the order
    statistics around every position are looked at again in parts of their own range, and so on for ``ROUNDS``
    rounds. A round is one aggregate of bounded size over rows of the chosen parts only, all positions together.
    What is left of a part after the last round are values that agree in 2^-16 of their part's own range, ranked among
    themselves. Give a table that is cheap to read; it is read once per round.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("part", F.when(F.col("v").isNull(), 1).otherwise(0).cast("long"))  # 0, but a key that joins by hash
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    names = list(probabilities)
    asked = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(float(p)).alias("at")) for i, p in enumerate(probabilities.values())])
    place = total.filter("total > 0").select("total", F.explode(asked).alias("a")).select("a.p", (F.col("a.at") * (F.col("total") - 1)).alias("place"), "total")
    low = F.floor("place").cast("long")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), low.alias("rank")), F.struct(F.lit(1).alias("side"), F.least(low + 1, F.col("total") - 1).alias("rank"))
    )
    # ``rank`` counts from 0 inside the part that a position has come down to
    wanted = place.select("p", (F.col("place") - low).alias("weight"), F.explode(sides).alias("s"), F.when(F.col("total") < 0, 1).otherwise(0).cast("long").alias("in_part"))
    wanted = wanted.select("p", "weight", "s.side", "s.rank", "in_part")
    hit = (F.col("in_part") == F.col("part")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))

    def summed(counted: DataFrame, order: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("part").orderBy(order))
        return counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))

    for _ in range(ROUNDS):
        ends = rows.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0).cast("int")
        rows = rows.join(F.broadcast(ends), "part").withColumn("slot", slot).select("part", "slot", "v")
        counted = summed(rows.groupBy("part", "slot").agg(F.count(F.lit(1)).alias("n")), "slot")
        inner = (F.col("part") * BUCKETS + F.col("slot")).alias("in_part")
        wanted = counted.join(F.broadcast(wanted), hit).select("p", "weight", "side", (F.col("rank") - F.col("before")).alias("rank"), inner)
        chosen = wanted.select(F.col("in_part").alias("part")).distinct()
        rows = rows.select((F.col("part") * BUCKETS + F.col("slot")).alias("part"), "v").join(F.broadcast(chosen), "part", "left_semi")
    ties = summed(rows.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")), "v")
    found = ties.join(F.broadcast(wanted), hit).select("p", "weight", "side", "v")
    picks = []
    for i, name in enumerate(names):
        a, b = (F.max(F.when((F.col("p") == i) & (F.col("side") == k), F.col("v"))) for k in (0, 1))
        weight = F.max(F.when(F.col("p") == i, F.col("weight")))
        picks.append((a + (b - a) * weight).alias(name))
    return found.agg(*picks)


def previous_in_key(
    df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: Column, prefix: str = "prev_"
) -> DataFrame:
    """``lag(1)`` of columns within a key whose rows may be most of the table.

    ``chunk`` must not decrease with ``order``. The window runs per (key, chunk); the first row
    of a chunk takes its value from the last row of the key's chunk before it.
    """
    parts = [*keys, "_chunk"]
    cut = df.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*parts).orderBy(order)
    lagged = cut.withColumns(
        {f"{prefix}{c}": F.lag(c).over(inner) for c in columns} | {"_first": F.row_number().over(inner) == 1}
    )
    tail = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(c) for c in columns]))
    tails = cut.groupBy(*parts).agg(tail.alias("_tail"))
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*parts, F.lag("_tail").over(chunks).alias("_carry"))
    joined = lagged.join(carried, parts, "left")
    return joined.withColumns(
        {
            f"{prefix}{c}": F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"{prefix}{c}"))
            for c in columns
        }
    ).drop("_chunk", "_first", "_carry")


def next_in_key(df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: Column) -> DataFrame:
    """``lead(1)`` over a numeric order, by the same construction on its negative."""
    mirrored = df.withColumn("_rev", -F.col(order))
    out = previous_in_key(mirrored, keys, "_rev", columns, -chunk, prefix="next_")
    return out.drop("_rev")


def global_row_number(df: DataFrame, order: list[Column], slice_on: str, out: str) -> DataFrame:
    """Row numbers over a total order, by value slices of its leading numeric column."""
    keyed = df.withColumn("_lead", F.col(slice_on).cast("double"))
    filled = keyed.withColumn("_lead", F.coalesce("_lead", F.lit(float("inf")).cast("double")))
    sliced, n = slice_by_value(filled, "_lead")
    local = sliced.withColumn("_local", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
    if n == 1:
        return local.withColumn(out, F.col("_local").cast("long")).drop("_local", "_slice", "_lead")
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_sum"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = local.join(F.broadcast(offsets), "_slice")
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_slice", "_lead")


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column | None = None, splits: int | None = None
) -> DataFrame:
    """First ``k`` rows per key; a hot key is cut by ``spread`` hash first, k survivors per part.

    The number of parts grows with the rows, so that a key that holds them all still gives parts of bounded size.
    """
    if spread is not None:
        splits = splits or max(32, df.count() // ROWS_PER_SLICE)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(splits)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
