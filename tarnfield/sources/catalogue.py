"""Station master files, ranking pages and the event catalogue."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from tarnfield import config
from tarnfield.functions.columns import finite
from tarnfield.operators.rain import event_id

STATION_HEADER = [
    "都府県振興局", "観測所番号", "種類", "観測所名", "カタカナ名", "情報名", "所在地",
    "緯度度", "緯度分", "経度度", "経度分", "標高",
]
# Header cells that must carry these words, by position.
HEADER_CONTRACT = {1: "観測所番号", 2: "種類", 3: "観測所名", 7: "緯度", 9: "経度"}
# Fixed formats of ranking cells: marks of an empty cell, value with flag, date.
BLANK_CELLS = ["", "--", "///", "×", "-"]
VALUE_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*([^\s(]*)"
DATE_PATTERN = r"\((\d{4}/\d{1,2}/\d{1,2}(?:\s+\d{1,2}:\d{2})?)\)"

EVENT_SCHEMA = (
    "event_id STRING, station_id STRING, station_name STRING, station_lon_deg DOUBLE, station_lat_deg DOUBLE, "
    "duration_minutes INT, total_precipitation_mm DOUBLE, rank INT, event_date_or_datetime_metadata STRING, "
    "source_url STRING, catalog_generated_at_utc STRING, data_quality_flags ARRAY<STRING>, "
    "profile_available BOOLEAN, profile_id STRING"
)
STATION_SCHEMA = (
    "station_id STRING, name STRING, prefecture_or_region STRING, lon_deg DOUBLE, lat_deg DOUBLE, "
    "precipitation_capable BOOLEAN, source_url STRING, catalog_generated_at_utc STRING"
)


class CatalogueError(ValueError):
    """A catalogue source breaks its contract."""


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", html.unescape(s)))


def normal_label(text: Column) -> Column:
    """Entities resolved, compatibility form, all blanks gone."""
    return F.regexp_replace(nfkc(text), r"(?U)\s", "")


@F.pandas_udf(T.StringType())
def cp932(raw: pd.Series) -> pd.Series:
    """Text of the older charset; Spark's own decoder needs a session-wide switch for it."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("cp932", "replace"))


def read_station_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows as text columns c0..c11 with their place in the input.

    A file is UTF-8 unless one of its lines is not, then cp932; that is decided inside the job, file by file, on
    the lines as read.
    """
    file = F.col("_metadata.file_path")
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("place"), file.alias("_file"))
    foreign = lines.groupBy("_file").agg(F.max(~F.is_valid_utf8("value")).alias("_foreign"))
    text = F.when(F.col("_foreign"), cp932(F.col("value").cast("binary"))).otherwise(F.col("value"))
    row = F.from_csv(text, ", ".join(f"c{i} STRING" for i in range(12)))
    told = lines.filter(F.octet_length("value") > 0).join(foreign, "_file")
    return told.select(row.alias("row"), "place").select("row.*", "place")


def is_header() -> Column:
    """Rows that fulfil the header contract."""
    ok = F.lit(True)
    for i, word in HEADER_CONTRACT.items():
        ok = ok & F.coalesce(F.contains(F.regexp_replace(f"c{i}", r"[\s　﻿]", ""), F.lit(word)), F.lit(False))
    return ok


def parse_stations(rows: DataFrame) -> DataFrame:
    """Rain-measuring stations: degrees plus minutes, first row per id."""
    kept = rows.filter(~is_header() & F.trim("c2").isin(*config.RAIN_STATION_TYPES) & (F.trim("c1") != ""))
    number = {i: F.trim(f"c{i}").try_cast("double") for i in (7, 8, 9, 10)}
    shaped = kept.select(
        F.trim("c1").alias("station_id"),
        F.trim("c3").alias("name"),
        F.when(F.trim("c0") != "", F.trim("c0")).alias("prefecture_or_region"),
        (number[9] + number[10] / 60).alias("lon_deg"),
        (number[7] + number[8] / 60).alias("lat_deg"),
        "place",
    )
    names = ["name", "prefecture_or_region", "lon_deg", "lat_deg"]
    first = shaped.groupBy("station_id").agg(F.min_by(F.struct(*names), "place").alias("s"))
    return first.select("station_id", "s.*")


def station_problems(stations: DataFrame) -> DataFrame:
    """Stations with a malformed id, no name or impossible coordinates."""
    rules = {
        "id": ~F.col("station_id").rlike(r"^\d{5}$"),
        "name": F.coalesce(F.col("name") == "", F.lit(True)),
        "coordinates": finite("lon_deg").isNull()
        | finite("lat_deg").isNull()
        | (F.abs("lon_deg") > 180)
        | (F.abs("lat_deg") > 90),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return stations.select("station_id", F.explode(broken).alias("problem"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """The station master, complete or refused."""
    rows = read_station_rows(spark, path)
    if rows.filter(is_header()).isEmpty():
        raise CatalogueError("station file header does not match the contract")
    stations = parse_stations(rows)
    bad = station_problems(stations).first()
    if bad is not None:
        raise CatalogueError(f"station {bad['station_id']}: {bad['problem']}")
    return stations


def ranked_cells(rows: DataFrame, cell_pattern: str, first_rank: int = 0) -> DataFrame:
    """Cells of each row with their position as rank; a blank cell still uses up its rank.

    Cells beyond the tenth rank are not rank cells (pages end a row with a period column).
    """
    cells = rows.select(
        *[c for c in rows.columns if c != "row_html"],
        F.posexplode(F.regexp_extract_all("row_html", F.lit(cell_pattern), F.lit(1))).alias("pos", "cell"),
    )
    text = F.trim(F.regexp_replace(F.regexp_replace("cell", "<[^>]*>", ""), r"\s+", " "))
    return cells.select(
        *[c for c in cells.columns if c not in ("pos", "cell")],
        (F.col("pos") + first_rank).alias("rank"),
        text.alias("text"),
    ).filter(F.col("rank").between(1, 10))


def parse_ranking_pages(pages: DataFrame) -> DataFrame:
    """Ranking pages (station_id, station_name, station_lon, station_lat, source_url, html) to events.

    Only rows with a known label count; value, flag and date come out of each rank cell.
    """
    keep = ["station_id", "station_name", "station_lon", "station_lat", "source_url"]
    rows = pages.select(
        *keep, F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_html")
    )
    cell = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"
    labelled = rows.withColumn("label", F.regexp_replace(F.regexp_extract("row_html", cell, 1), "<[^>]*>", ""))
    minutes = F.create_map(*[F.lit(x) for pair in config.RANK_LABEL_MINUTES.items() for x in pair])
    timed = labelled.withColumn("duration_minutes", F.try_element_at(minutes, normal_label(F.col("label"))))
    cells = ranked_cells(timed.filter("duration_minutes IS NOT NULL").drop("label"), cell)
    value = F.regexp_extract("text", VALUE_PATTERN, 1).try_cast("double")
    flag, date = F.regexp_extract("text", VALUE_PATTERN, 2), F.regexp_extract("text", DATE_PATTERN, 1)
    events = cells.filter(~F.col("text").isin(*BLANK_CELLS)).withColumns(
        {
            "total_mm": value,
            "event_date": F.when(date != "", date),
            "data_quality_flags": F.when(flag.isin("", "-"), F.array().cast("array<string>")).otherwise(F.array(flag)),
        }
    )
    return events.filter("total_mm > 0").withColumn("event_id", event_id()).drop("text")


def write_events(events: DataFrame, path: str) -> None:
    """Catalogue files in catalogue order: ranked first, then rank, then id."""
    ordered = events.orderBy(F.col("rank").asc_nulls_last(), "event_id")
    ordered.write.mode("overwrite").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").json(path)


def load_catalogue(
    spark: SparkSession, path: str, kind: str, version: str = "1", multi_line: bool = True
) -> DataFrame:
    """Versioned catalogue documents {schema_version, <kind>: [...]} as rows.

    Large catalogues come as one document per line (``multi_line=False``), which keeps files
    splittable.
    """
    item = EVENT_SCHEMA if kind == "events" else STATION_SCHEMA
    schema = f"schema_version STRING, {kind} ARRAY<STRUCT<{', '.join(_struct_field(f) for f in item.split(', '))}>>"
    documents = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    wrong = documents.filter(~F.col("schema_version").eqNullSafe(version)).first()
    if wrong is not None:
        raise CatalogueError(f"unsupported catalogue version {wrong['schema_version']}")
    return documents.select(F.explode(kind).alias("i")).select("i.*")


def _struct_field(declaration: str) -> str:
    name, kind = declaration.split(" ", 1)
    return f"{name}: {kind}"
