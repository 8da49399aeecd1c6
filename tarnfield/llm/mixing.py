"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r gets a Poisson(r) number of copies, by inverting the
distribution at a number in [0, 1) hashed from its id and the seed. Rates over 16 are drawn as sums of equal
smaller parts, each with a hash of its own. The copies are then put into one global random order.

Without given weights the target share of a source is proportional to its row count to the power 1/2. A null
source is a source of its own. Rows without id draw by an empty id; repeated rows draw the same count. Sources
absent from given weights get none, as asked. An empty table gives an empty result. ``copy``, ``copies`` and
``position`` columns that come with the documents are replaced, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import numbered, quoted, table
from tarnfield.llm.sharding import unit
from tarnfield.runtime import broadcast_if_small

PART = 16.0  # largest rate inverted in one piece
TERMS = 81  # Poisson(16) exceeds 80 with probability below 1e-25
ADDED = ("copy", "copies", "position")


def rates(docs: DataFrame, weights: dict[str, float] | None, size: float, power: float) -> DataFrame:
    """Per source: ``_of``, ``_rate`` (mean repetition rate), so that ``size`` x rows are expected in all."""
    counts = table(docs.groupBy(F.col("source").cast("string").alias("_of")).agg(F.count(F.lit(1)).alias("_n")), "sources")
    if weights is None:
        shares = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_name string, _w double")
        shares = counts.join(given, F.col("_of").eqNullSafe(F.col("_name")), "left").fillna(0.0, ["_w"])
    whole = shares.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n")).first()
    if not whole["w"]:
        return shares.select("_of", F.lit(0.0).alias("_rate"))
    rate = F.col("_w") / F.lit(whole["w"]) * F.lit(whole["n"]) * size / F.col("_n")
    return shares.select("_of", rate.alias("_rate"))


def drawn(doc_id: Column, rate: Column, cumulative: Column, seed: int) -> Column:
    """Number of copies: for each part, how many values of the cumulative distribution lie at or below the hash."""
    stem = F.coalesce(doc_id.cast("string"), F.lit(""))

    def one(part: Column) -> Column:
        u = unit(F.concat_ws("/", stem, part.cast("string"), F.lit(f"poisson{seed}")))
        return F.size(F.filter(cumulative, lambda c: c <= u))

    parts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int"))
    return F.aggregate(parts, F.lit(0), lambda total, part: total + one(part))


def poisson_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, power: float = 0.5, seed: int = 17
) -> DataFrame:
    """``docs`` with ``copies`` (of its row), ``copy`` (1 .. copies) and ``position`` (from 0, a global random order)."""
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(TERMS)])
    mean = F.col("_rate") / F.greatest(F.lit(1.0), F.ceil(F.col("_rate") / PART))
    mass = F.zip_with(
        F.sequence(F.lit(0), F.lit(TERMS - 1)),
        logs,
        lambda k, log: F.when(F.col("_mean") > 0, F.exp(k * F.ln("_mean") - F.col("_mean") - log)).otherwise(
            F.when(k == 0, 1.0).otherwise(0.0)
        ),
    )
    running = F.aggregate(
        F.col("_mass"),
        F.array().cast("array<double>"),
        lambda sums, m: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0)) + m)),
    )
    # A hash is at most 1 - 2^-52, so values above that never count.
    running = F.filter(running, lambda c: c <= 1 - 2.0**-52)
    known = rates(docs, weights, size, power).withColumn("_mean", mean).withColumn("_mass", mass)
    known = broadcast_if_small(table(known.select("_of", "_rate", running.alias("_cumulative")), "rates"))
    kept = [c for c in docs.columns if c not in ADDED]
    counted = docs.select(*quoted(kept)).join(known, F.col("source").cast("string").eqNullSafe(F.col("_of")))
    counted = counted.withColumn("copies", drawn(F.col("doc_id"), F.col("_rate"), F.col("_cumulative"), seed))
    copied = counted.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    stem = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = unit(F.concat_ws("/", stem, F.col("copy").cast("string"), F.lit(f"order{seed}")))
    copied = copied.withColumn("_place", place).select(*quoted(kept), "copies", "copy", "_place")
    rows = copied.count()
    return numbered(copied, F.col("_place"), [F.col("doc_id"), F.col("copy")], "position", rows).drop("_place")
