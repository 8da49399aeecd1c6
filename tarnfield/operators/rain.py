"""Rain stations, ranked events, scenarios and forcing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.functions.columns import plain_number, short_id, uniform_intensity
from tarnfield.operators.nearest import nearest_k
from tarnfield.operators.ordered import global_row_number


def nearest_stations(points: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """k nearest rain stations per point by great-circle distance, ties by station id."""
    if not 1 <= k <= 20:
        raise ValueError("k must lie between 1 and 20")
    here = points.select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    there = stations.select(F.col("station_id").alias("site_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return nearest_k(here, there, k, sphere=True).select(
        "point_id", F.col("site_id").alias("station_id"), F.col("distance").alias("distance_km"), "rank"
    )


def event_id() -> Column:
    """Identity of a ranked event from station, duration, total, rank, date and source."""
    return short_id(
        "jma-",
        [
            F.col("station_id"),
            F.col("duration_minutes"),
            plain_number(F.col("total_mm")),
            F.col("rank"),
            F.col("event_date"),
            F.col("source_url"),
        ],
    )


def _text_lead(text: str) -> Column:
    """First characters as a fraction in [0, 1) that grows with the text's order."""
    codes = [F.least(F.ascii(F.substring(text, i, 1)), F.lit(127)) / F.lit(128.0**i) for i in range(1, 8)]
    total = codes[0]
    for code in codes[1:]:
        total = total + code
    return total


def order_events(events: DataFrame) -> DataFrame:
    """Catalogue order (ranked events first, rank, id) as an explicit position.

    The slicing key follows the order into the id's leading characters, so the many unranked
    events still spread over slices.
    """
    rank = F.coalesce(F.col("rank").cast("double"), F.lit(1e6))
    keyed = events.withColumn("_key", rank + _text_lead("event_id"))
    order = [F.col("rank").asc_nulls_last(), F.col("event_id")]
    return global_row_number(keyed, order, "_key", "position").drop("_key")


def referential_errors(events: DataFrame, stations: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Events whose station is unknown, or known under another name or place."""
    known = stations.select(
        "station_id", F.col("name").alias("_name"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")
    )
    joined = events.join(known, "station_id", "left")
    problem = (
        F.when(F.col("_name").isNull(), "unknown_station")
        .when(F.col("station_name") != F.col("_name"), "name_mismatch")
        .when(
            (F.abs(F.col("station_lon") - F.col("_lon")) > tolerance)
            | (F.abs(F.col("station_lat") - F.col("_lat")) > tolerance),
            "place_mismatch",
        )
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("event_id", "problem")


def missing_durations(events: DataFrame) -> DataFrame:
    """Sources lacking one of the required durations; the distinct set per source is tiny."""
    required = F.array(*[F.lit(d) for d in config.REQUIRED_DURATIONS])
    # distinct first: a hot source shrinks to its few durations before the per-source set
    seen = events.select("station_id", "duration_minutes").distinct()
    return (
        seen.groupBy("station_id")
        .agg(F.collect_set("duration_minutes").alias("have"))
        .select("station_id", F.array_sort(F.array_except(required, "have")).alias("missing"))
        .filter(F.size("missing") > 0)
    )


def resolve_scenarios(scenarios: DataFrame, events: DataFrame) -> DataFrame:
    """Scenario kinds to two-sample series (0, rate) and (end, rate), or a typed problem.

    Rates stay within (0, 500] mm/h and durations within 1..10080 minutes.
    """
    chosen = events.select(
        F.col("event_id").alias("_event"),
        F.col("total_mm").alias("_total"),
        F.col("duration_minutes").alias("_minutes"),
    )
    joined = scenarios.join(chosen, scenarios["event_id"] == chosen["_event"], "left")
    kind = F.col("kind")
    minutes = F.when(kind == "constant", F.col("minutes")).otherwise(F.col("_minutes"))
    rate = F.when(kind == "constant", F.col("intensity")).otherwise(uniform_intensity(F.col("_total"), F.col("_minutes")))
    resolved = joined.withColumns({"_d": minutes, "_r": rate})
    problem = (
        F.when(kind == "historical_observed_profile", "profile_unavailable")
        .when(~kind.isin("constant", "historical_uniform"), "unsupported_kind")
        .when((kind == "historical_uniform") & F.col("_event").isNull(), "event_unavailable")
        .when(F.col("_r").isNull() | (F.col("_r") <= 0) | (F.col("_r") > 500), "rate_out_of_range")
        .when(F.col("_d").isNull() | (F.col("_d") < 1) | (F.col("_d") > 10080), "duration_out_of_range")
    )
    samples = F.array(
        F.struct(F.lit(0.0).alias("elapsed_s"), F.col("_r").alias("intensity")),
        F.struct((F.col("_d") * 60.0).alias("elapsed_s"), F.col("_r").alias("intensity")),
    )
    blank = F.array(
        F.struct(F.lit(None).cast("double").alias("elapsed_s"), F.lit(None).cast("double").alias("intensity"))
    )
    return (
        resolved.withColumn("problem", problem)
        .withColumn("s", F.explode(F.when(F.col("problem").isNull(), samples).otherwise(blank)))
        .select("scenario_id", "problem", "s.elapsed_s", "s.intensity")
    )


def distributed_forcing(series: DataFrame, cells: DataFrame) -> DataFrame:
    """rate[t] x weight[cell], joined on the area both belong to.

    The result holds every (time, cell) of an area by nature; cells of an area without series stay, with
    NULL time and rate. A hot area's cells are split by the adaptive skew join.
    """
    samples = series.select("area_id", "elapsed_s", "intensity")
    return cells.join(samples, "area_id", "left").select(
        "area_id", "row", "col", "elapsed_s", (F.col("intensity") * F.col("rain_weight")).alias("rate")
    )
