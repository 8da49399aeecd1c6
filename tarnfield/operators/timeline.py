"""Frame selection on the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.ordered import previous_in_key


class MissingFrame(ValueError):
    """No frame lies close enough to a wanted time."""


def nearest_frames(times: DataFrame, interval_s: float, by: list[str]) -> DataFrame:
    """For each k x interval of a run the frame nearest in time, with its distance.

    ``times`` has (run keys, t, elapsed_s). Frames offer themselves to the two targets around
    them, which makes the as-of join an equi join; a target nobody offers to stays with NULL.
    """
    span = times.groupBy(*by).agg(F.max("elapsed_s").alias("_last"))
    steps = F.sequence(F.lit(0), F.floor((F.col("_last") + 0.5 - 1e-9) / interval_s).cast("int"))
    targets = span.select(*by, F.explode(steps).alias("k")).withColumn("target_s", F.col("k") * float(interval_s))
    low = F.floor(F.col("elapsed_s") / interval_s).cast("int")
    offers = times.select(*by, "t", "elapsed_s", F.explode(F.array(low, low + 1)).alias("k"))
    off = F.abs(F.col("elapsed_s") - F.col("k") * float(interval_s))
    best = offers.groupBy(*by, "k").agg(F.min(F.struct(off.alias("off"), "t")).alias("b"))
    return targets.join(best, [*by, "k"], "left").select(
        *by, "k", "target_s", F.col("b.t").alias("t"), F.col("b.off").alias("off_s")
    )


def selected_frames(times: DataFrame, interval_s: float, by: list[str], strict: bool = True) -> DataFrame:
    """Frames of an interval grid without consecutive repeats; a longer tail keeps its last frame."""
    tolerance = max(1.0, interval_s * 0.01)
    near = nearest_frames(times, interval_s, by)
    bad = near.filter(F.col("t").isNull() | (F.col("off_s") > tolerance))
    if strict:
        first = bad.first()
        if first is not None:
            raise MissingFrame(f"no frame at {first['target_s']:g} s")
    else:
        near = near.filter(F.col("t").isNotNull() & (F.col("off_s") <= tolerance))
    # consecutive targets repeat a frame only when they share it, so distinct equals run-length removal
    kept = near.select(*by, "t").distinct()
    last = times.groupBy(*by).agg(F.max(F.struct("elapsed_s", "t")).alias("e"))
    covered = near.groupBy(*by).agg(F.max("target_s").alias("_end"))
    tail = last.join(covered, by).filter(F.col("e.elapsed_s") - F.col("_end") > tolerance)
    return kept.unionByName(tail.select(*by, F.col("e.t").alias("t"))).distinct()


def not_increasing(series: DataFrame, key: str, order: str, value: str, chunk: int = 65536) -> DataFrame:
    """Rows whose value does not exceed the one before them."""
    parts = F.floor(F.col(order) / chunk)
    seen = previous_in_key(series, [key], order, [value], parts)
    return seen.filter(F.col(value) <= F.col(f"prev_{value}")).select(key, order, value, f"prev_{value}")
