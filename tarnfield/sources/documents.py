"""Documents that travel with results: result metadata, provenance and counts, as one JSON per row.

They are built from tables by aggregates, so a document of a large cube costs one pass and one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.columns import finite
from tarnfield.operators.grid import GridSpec
from tarnfield.operators.ordered import side_by_side

UNITS = {"water_depth": "m", "terrain_elevation": "m", "grid_resolution": "m"}
POLICY = (
    "cells that are inactive or control the boundary hold no depth; negative depths of a frame are dry and count as zero; "
    "a missing stored maximum is rebuilt from the frames"
)


def _texts(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def result_document(frames: DataFrame, cells: DataFrame, grid: GridSpec, stored: DataFrame | None = None, kind: str = "regular") -> DataFrame:
    """One row ``document`` (JSON) about raw frames (``t, row, col, h`` and perhaps ``u, v``) on ``cells`` (mask, elevation).

    Mask 1 is active, 2 and above controls the boundary and is left out. ``stored`` may hold the solver's own
    maxima (``row, col, hmax``), where a cell without one is rebuilt from its frames.
    """
    keys = ["row", "col"]
    flows = {"u", "v"} <= set(frames.columns)
    named = frames.select("t", *keys, finite("h").alias("h"), (finite("u").isNotNull() if flows else F.lit(False)).alias("flow"))
    met = named.join(cells.select(*keys, "mask"), keys)
    active = F.col("mask") == 1
    per_cell = met.groupBy(*keys).agg(
        F.first("mask").alias("mask"),
        F.max(F.when(F.col("h").isNotNull(), F.greatest("h", F.lit(0.0)))).alias("top"),
        F.min("h").alias("low"),
        F.count_if(F.col("h") < 0).alias("negative"),
    )
    per_time = named.groupBy("t").agg(F.max("flow").alias("flow"))
    times = per_time.agg(
        F.array_sort(F.collect_list("t")).alias("available_time_indices"), F.coalesce(F.max("flow"), F.lit(False)).alias("flow_vectors_available")
    )
    maxima = cells.select(*keys, F.col("mask").alias("of"), "elevation_m").join(per_cell, keys, "left")
    if stored is not None:
        given = stored.select(*keys, finite("hmax").alias("hmax"))
        maxima = maxima.join(given.groupBy(*keys).agg(F.max("hmax").alias("hmax")), keys, "left")
    else:
        maxima = maxima.withColumn("hmax", F.lit(None).cast("double"))
    is_active = F.col("of") == 1
    whole = maxima.agg(
        F.struct(
            F.max(F.when(is_active, F.coalesce("hmax", "top"))).alias("global_max_depth_m"),
            F.count_if(is_active & F.col("hmax").isNull() & F.col("top").isNotNull()).alias("hmax_reconstructed_cells"),
            F.coalesce(F.sum(F.when(is_active, F.col("negative"))), F.lit(0)).alias("negative_depth_clipped_values"),
            F.count_if(is_active & (F.col("hmax") < 0)).alias("negative_max_depth_cells"),
            F.min(F.when(is_active, F.col("low"))).alias("min_raw_active_depth_m"),
            F.count_if(F.col("of") > 1).alias("excluded_boundary_cells"),
        ).alias("max_depth_summary"),
        F.struct(
            F.min(F.when(is_active, finite("elevation_m"))).alias("low_m"), F.max(F.when(is_active, finite("elevation_m"))).alias("high_m")
        ).alias("elevation_legend"),
        F.create_map(F.lit(f"{grid.dx:g}m"), F.count_if(is_active)).alias("grid_level_summary"),
    )
    half_w, half_h = grid.width_m / 2, grid.height_m / 2
    bounds = {"west_m": -half_w, "south_m": -half_h, "east_m": half_w, "north_m": half_h}
    told = side_by_side(times, whole).select(
        F.lit("1").alias("schema_version"),
        F.lit(kind).alias("storage_kind"),
        F.struct(*[F.lit(v).alias(k) for k, v in bounds.items()]).alias("bounds"),
        _texts(UNITS).alias("units"),
        "*",
        F.lit(POLICY).alias("no_data_policy"),
    )
    return told.select(F.to_json(F.struct(*told.columns)).alias("document"))


def provenance(counts: DataFrame, provider: str, bounds: dict[str, float], attribution: str, terms: str, at: str, warnings: Column | None = None) -> DataFrame:
    """One document per row of ``counts``: its columns become ``source_details``; ``warnings`` may name conditions."""
    details = F.struct(*[F.col(c) for c in counts.columns])
    told = counts.select(
        F.lit(provider).alias("provider_id"),
        F.struct(*[F.lit(float(v)).alias(k) for k, v in bounds.items()]).alias("requested_bounds"),
        F.lit(at).alias("acquired_at_utc"),
        F.lit(attribution).alias("attribution"),
        F.lit(terms).alias("terms_url"),
        (F.array_compact(warnings) if warnings is not None else F.array().cast("array<string>")).alias("warnings"),
        details.alias("source_details"),
    )
    return told.select(F.to_json(F.struct(*told.columns)).alias("document"))


def elevation_counts(filled: DataFrame) -> DataFrame:
    """Counts of a priority fill (``source_id``, ``z`` before and ``filled`` after the nearest fill), one row.

    ``provider_counts`` maps each provider to the cells it gave.
    """
    per = filled.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("filled"))
    given = F.when(F.col("source_id").isNotNull(), F.struct(F.col("source_id").cast("string"), "n"))
    return per.agg(
        F.map_from_entries(F.array_sort(F.collect_list(given))).alias("provider_counts"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("nearest_filled_cells"),
        (F.coalesce(F.sum(F.when(F.col("source_id").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias(
            "missing_fraction_before_nearest_fill"
        ),
    )


def feature_counts(features: DataFrame, kind: str, parts: str) -> DataFrame:
    """One row: features and polygon parts per kind, features without a part, vertices left after clipping."""
    per = features.groupBy(F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.size(parts)).alias("parts"), F.count_if(F.size(parts) == 0).alias("empty")
    )
    entry = F.struct("kind", F.struct("features", "parts"))
    return per.agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_kind"),
        F.coalesce(F.sum("features"), F.lit(0)).alias("features"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("without_parts"),
    )
