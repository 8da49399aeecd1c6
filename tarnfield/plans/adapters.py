"""Domain tables derived from the driver's tables by integer arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators.grid import GridSpec
from tarnfield.runtime import scratch_path
from tarnfield.sources import dense


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def int_div(value: Column, by: int) -> Column:
    """Floor division of non-negative keys."""
    return F.floor(value / by)


def _row_col(key: str, width: int) -> list[Column]:
    return [
        int_div(F.col(key), width).cast("int").alias("row"),
        (F.col(key) % width).cast("int").alias("col"),
    ]


def cells(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    grid = part.select(*_row_col("p_partkey", 50), "*")
    dip = F.when(F.col("p_partkey") % 97 == 0, 400).otherwise(0)
    return grid.select(
        "row",
        "col",
        ((F.col("row") * 2 + F.col("col") - dip) / F.lit(1000.0)).alias("elevation_m"),
        (F.col("p_size") <= 8).alias("building"),
        ((F.col("p_brand") == "Brand#1") & (F.col("p_size") > 8)).alias("road"),
        (F.col("p_size") > 46).alias("water"),
        "p_partkey",
    )


def _events_by_cell_day(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return (
        events.withColumn("t", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
        .groupBy("user_id", "t")
        .agg(
            F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.max("event_id").alias("e"),
        )
    )


def _velocity(factor: int) -> Column:
    return ((F.col("e") * factor) % 200 - 100) / F.lit(100.0)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Long depth / velocity cube, one row per (t, row, col)."""
    return _events_by_cell_day(spark, folder).select(
        *_row_col("user_id", 15),
        "t",
        (F.col("s").cast("double") / (F.col("n") * 10000)).alias("h"),
        _velocity(37).alias("u"),
        _velocity(53).alias("v"),
    )


def raw_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The cube before normalisation: NaN depths and negative depths occur."""
    depth = (F.col("s") - F.col("n") * 2000).cast("double") / (F.col("n") * 10000)
    return _events_by_cell_day(spark, folder).select(
        *_row_col("user_id", 15),
        "t",
        F.when(F.col("e") % 11 == 0, F.lit(float("nan"))).otherwise(depth).alias("h"),
        _velocity(37).alias("u"),
        _velocity(53).alias("v"),
    )


def frame_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Static cells of the depth cube: every cell that ever reported."""
    key = F.col("user_id")
    return (
        table(spark, folder, "events")
        .select("user_id")
        .distinct()
        .select(
            *_row_col("user_id", 15),
            F.when(key % 17 == 0, 0).when(key % 13 == 0, 3).otherwise(1).alias("mask"),
            ((int_div(key, 15) * 2 + key % 15) / F.lit(1000.0)).alias("elevation_m"),
        )
    )


def _lonlat(key: str) -> list[Column]:
    return [
        (122 + ((F.col(key) * 7919) % 2400) / F.lit(100.0)).alias("lon"),
        (24 + ((F.col(key) * 104729) % 2100) / F.lit(100.0)).alias("lat"),
    ]


def stations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("station_id"),
        "s_suppkey",
        F.col("s_name").alias("name"),
        *_lonlat("s_suppkey"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("point_id"), *_lonlat("c_custkey"))


def rain_events(spark: SparkSession, folder: str) -> DataFrame:
    n_stations = table(spark, folder, "supplier").count()
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_custkey") % n_stations).cast("string").alias("station_id"),
        F.when(F.col("o_orderkey") % 3 == 0, 10)
        .when(F.col("o_orderkey") % 3 == 1, 60)
        .otherwise(1440)
        .alias("duration_minutes"),
        (F.col("o_totalprice") / 1000).alias("total_mm"),
        F.col("o_orderdate").alias("event_date"),
    )


def elevation(spark: SparkSession, folder: str) -> DataFrame:
    """Elevation offers of five providers; a provider is silent where it has no row."""
    return (
        table(spark, folder, "orders")
        .select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("source_id"),
            *_row_col("o_custkey", 15),
            "o_totalprice",
        )
        .groupBy("source_id", "row", "col")
        .agg(F.min("o_totalprice").alias("z"))
    )


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_run_events(table(spark, folder, "events"))


def shape_run_events(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming events table."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("sequence"),
        "ts",
        F.when(kind == "signup", "CREATED")
        .when(kind == "view", "VALIDATING")
        .when(kind == "click", "ACQUIRING_TERRAIN")
        .when(kind == "purchase", "COMPLETE")
        .otherwise("FAILED")
        .alias("state"),
        ((F.round(F.col("value") * 100).cast("long") % 130 - 10) / F.lit(100.0)).alias("progress"),
    )


def scene(spark: SparkSession, folder: str) -> DataFrame:
    """A calmer terrain with block-shaped buildings, one road and two zones."""
    part = table(spark, folder, "part").select("p_partkey", *_row_col("p_partkey", 50))
    dip = F.when(F.col("p_partkey") % 397 == 0, 400).otherwise(0)
    building = (int_div(F.col("row"), 8) + int_div(F.col("col"), 8) * 3) % 11 == 0
    return part.select(
        "row",
        "col",
        ((F.col("row") * 2 + F.col("col") - dip) / F.lit(1000.0)).alias("elevation_m"),
        building.alias("building"),
        (F.col("col") == 43).alias("road"),
        (F.col("p_partkey") % 613 == 0).alias("native"),
        F.when(building, 0).otherwise(1).alias("mask"),
        int_div(F.col("col"), 24).cast("int").alias("zone"),
    )


_STORED: dict[tuple[str, str], str] = {}


def stored_cube(spark: SparkSession, folder: str) -> dense.DenseCube:
    """The frames of a folder as a dense cube on disk; written once per application, opened again by each query."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = scratch_path(spark, "dense-cube")
        grid = GridSpec.measure(frame_cells(spark, folder))
        dense.write_dense(frames(spark, folder).withColumn("run_id", F.lit("r1")), path, grid, tile=16, dtype="float64")
        _STORED[key] = path
    return dense.DenseCube(spark, _STORED[key])
