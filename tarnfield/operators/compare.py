"""Accuracy gates between two cubes or between a cube and a face cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators.ordered import exact_quantiles, side_by_side
from tarnfield.runtime import cut_lineage

CELL = ["row", "col"]


def align(full: DataFrame, candidate: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Outer alignment of two tables; value columns become full_x and cand_x."""
    left = full.select(*keys, *[F.col(v).alias(f"full_{v}") for v in values])
    right = candidate.select(*keys, *[F.col(v).alias(f"cand_{v}") for v in values])
    return left.join(right, keys, "full_outer")


def flooded(value: Column, threshold: float = config.FLOODED_M) -> Column:
    return F.coalesce(value >= threshold, F.lit(False))


def accuracy_gate(
    full: DataFrame, candidate: DataFrame, volumes: DataFrame | None = None, connectivity: bool | None = None
) -> DataFrame:
    """One row of metrics and three-valued criteria; an unproven criterion (NULL) does not pass.

    ``full`` and ``candidate`` carry max_depth per cell; ``volumes`` is one row of ``full_volume`` and
    ``candidate_volume``. The aligned cells are held once; all else is one plan of aggregates.
    """
    pairs = cut_lineage(align(full, candidate, CELL, ["max_depth"]))
    a, b = flooded(F.col("full_max_depth")), flooded(F.col("cand_max_depth"))
    both = pairs.filter(a & b).select(F.abs(F.col("full_max_depth") - F.col("cand_max_depth")).alias("d"))
    q = exact_quantiles(both, "d", {"median": 0.5, "p95": 0.95})
    one = pairs.agg(F.count_if(a | b).alias("union_cells"), F.count_if(a & b).alias("common_cells"))
    if volumes is None:
        met = side_by_side(one, q).withColumn("volume_rel_diff", F.lit(None).cast("double"))
    else:
        met = side_by_side(one, q, relative_difference(volumes))
    nothing = (F.col("union_cells") == 0) & (F.col("common_cells") == 0)
    met = met.select(
        "union_cells",
        "common_cells",
        F.when(F.col("union_cells") == 0, 1.0).otherwise(F.col("common_cells") / F.col("union_cells")).alias("iou"),
        F.when(nothing, 0.0).otherwise(F.col("median")).alias("median_diff"),
        F.when(nothing, 0.0).otherwise(F.col("p95")).alias("p95_diff"),
        "volume_rel_diff",
    )
    criteria = {
        "flooded_area_iou": F.col("iou") >= config.MIN_IOU,
        "median_abs_max_depth_difference": F.col("median_diff") <= config.MAX_MEDIAN_DIFF_M,
        "p95_abs_max_depth_difference": F.col("p95_diff") <= config.MAX_P95_DIFF_M,
        "accounted_final_surface_water_volume": F.col("volume_rel_diff") <= config.MAX_VOLUME_REL_DIFF,
        "important_flow_path_connectivity": F.lit(connectivity).cast("boolean"),
    }
    told = F.create_map(*[x for name, ok in criteria.items() for x in (F.lit(name), ok)])
    passed = F.forall(F.array(*criteria.values()), lambda ok: F.coalesce(ok, F.lit(False)))
    return met.withColumns({"criteria": told, "passed": passed})


def relative_difference(volumes: DataFrame) -> DataFrame:
    """``volume_rel_diff`` of one row (full_volume, candidate_volume); NULL if one is missing, an error if one is negative."""
    full, candidate = F.col("full_volume").cast("double"), F.col("candidate_volume").cast("double")
    share = F.when(full == 0, F.when(candidate == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.abs(candidate - full) / full)
    checked = F.when((full < 0) | (candidate < 0), F.raise_error(F.lit("volumes must not be negative")).cast("double"))
    known = full.isNotNull() & candidate.isNotNull()
    return volumes.select(F.when(known, F.coalesce(checked, share)).alias("volume_rel_diff"))


def suite_verdict(reports: DataFrame) -> DataFrame:
    """All cases pass and some open-area case has fewer cells than it replaces."""
    return reports.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"),
        F.coalesce(
            F.bool_or((F.col("benchmark_class") == "open_area") & (F.col("blocks") < F.col("cells"))), F.lit(False)
        ).alias("reduction_proven"),
    ).withColumn("suite_passed", F.col("all_passed") & F.col("reduction_proven"))


def difference_stats(pairs: DataFrame, value: str) -> DataFrame:
    """RMSE and largest absolute difference where both sides are present."""
    d = F.col(f"full_{value}") - F.col(f"cand_{value}")
    return pairs.agg(
        F.count(d).alias("n"),
        F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("max_abs"),
    )


def flooded_counts(pairs: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Cells deeper than each threshold on either side, in one pass."""
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"), F.col(f"f{i}").alias("full"), F.col(f"c{i}").alias("candidate")
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    counts = []
    for i, t in enumerate(thresholds):
        counts += [
            F.count_if(F.col("full_max_depth") > t).alias(f"f{i}"),
            F.count_if(F.col("cand_max_depth") > t).alias(f"c{i}"),
        ]
    return pairs.agg(*counts).select(rows)
