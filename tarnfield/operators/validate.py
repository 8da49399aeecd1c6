"""Rule checks that return violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.columns import finite

PRESET_HALF_SIZES_M = [250, 500, 1000, 2000, 4000]


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that is true of a row; unknown counts as not violated."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit("duplicate").alias("rule"))


def blank(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def bad_coordinate(name: str, limit: float) -> Column:
    return finite(name).isNull() | (F.abs(name) > limit)


def event_violations(events: DataFrame) -> DataFrame:
    """Rainfall events: ids, coordinates, duration, total, rank and profile rules."""
    total = finite("total_precipitation_mm")
    rules = {
        "event_id": blank("event_id"),
        "station_id": blank("station_id"),
        "longitude": bad_coordinate("station_lon_deg", 180),
        "latitude": bad_coordinate("station_lat_deg", 90),
        "duration": F.coalesce(F.col("duration_minutes") <= 0, F.lit(True)),
        "total": total.isNull() | (total <= 0),
        "rank": F.col("rank").isNotNull() & ~F.col("rank").between(1, 10),
        "profile": F.coalesce(F.col("profile_available"), F.lit(False)) & F.col("profile_id").isNull(),
        "profile_id": F.col("profile_id").isNotNull() & blank("profile_id"),
    }
    return violations(events, "event_id", rules).unionByName(duplicates(events, "event_id"))


def area_violations(areas: DataFrame) -> DataFrame:
    """Analysis areas: order, centre, size and preset rules."""
    width, height, area = F.col("width_m"), F.col("height_m"), F.col("area_m2")
    expected = width * height
    gap = F.abs(area - expected)
    names = ("west", "south", "east", "north", "lon", "lat", "width_m", "height_m", "area_m2")
    missing = F.lit(False)
    for name in names:
        missing = missing | finite(name).isNull()
    preset = F.col("mode") == "preset_square"
    rules = {
        "finite": missing,
        "order": (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north")),
        "centre": ~F.col("lon").between(F.col("west"), F.col("east"))
        | ~F.col("lat").between(F.col("south"), F.col("north")),
        "size": (width <= 0) | (height <= 0),
        "area": (gap > 1e-6) & (gap > F.greatest(F.abs(area), F.abs(expected)) * 1e-9),
        "preset_shape": preset & (width != height),
        "preset_size": preset & ~(width / 2).isin(*[float(h) for h in PRESET_HALF_SIZES_M]),
    }
    return violations(areas, "area_id", rules)


def cube_violations(frames: DataFrame, cells: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Per frame: cells missing, repeated or foreign, and unusable active values.

    With ``times`` (``t``), the expected time axis, a frame without any row shows as all cells missing.
    """
    active = F.col("mask") > 0
    counted = frames.groupBy("t", "row", "col").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(finite("h").isNull()).alias("bad_depth"),
        F.count_if(finite("u").isNull() != finite("v").isNull()).alias("half_velocity"),
    )
    known = cells.select("row", "col", "mask").withColumn("known", F.lit(True))
    joined = counted.join(known, ["row", "col"], "left")
    total = cells.count()
    found = joined.groupBy("t").agg(
        (F.lit(total) - F.count_if("known")).alias("missing"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.count_if(F.col("known").isNull()).alias("foreign_cells"),
        F.coalesce(F.sum(F.when(active, F.col("bad_depth"))), F.lit(0)).alias("bad_depth"),
        F.sum("half_velocity").alias("half_velocity"),
    )
    if times is None:
        return found
    axis = times.select("t").distinct().join(found, "t", "full_outer")
    rest = ["repeated", "foreign_cells", "bad_depth", "half_velocity"]
    return axis.select("t", F.coalesce("missing", F.lit(total)).alias("missing"), *[F.coalesce(c, F.lit(0)).alias(c) for c in rest])


def policy_problem() -> Column:
    """First broken rule of a block policy (``levels``, ``mid_ceiling``, ``core_m``, ``mid_m``, ``limits`` from level 2 on)."""
    levels, limits = F.col("levels"), F.col("limits")
    doubled = F.transform(levels, lambda size, i: F.when(i == 0, 1).otherwise(2 * F.get(levels, i - 1)) == size)
    unlimited = lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    radii = (F.col("core_m") >= 0) & (F.col("core_m") <= F.col("mid_m")) & (F.col("mid_m") < float("inf"))
    return (
        F.when((F.size(levels) < 1) | ~F.forall(doubled, lambda ok: ok) | (F.array_max(levels) > 32), "levels")
        .when(~F.array_contains(levels, F.col("mid_ceiling")), "mid_ceiling")
        .when(~F.coalesce(radii, F.lit(False)), "radii")
        .when((F.size(limits) < F.size(levels) - 1) | F.exists(limits, unlimited), "limits")
    )


def describe_source(spark: SparkSession, path: str) -> DataFrame:
    """Identity of a Parquet source: file, size, modification time; no data column is read."""
    return (
        spark.read.parquet(path)
        .select(
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .distinct()
    )


def source_changes(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files added, gone or changed since the source was recorded."""
    old = recorded.select("file_name", F.col("file_size").alias("_size"), F.col("modified").alias("_modified"))
    both = current.join(old, "file_name", "full_outer")
    change = (
        F.when(F.col("_size").isNull(), "added")
        .when(F.col("file_size").isNull(), "gone")
        .when((F.col("file_size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "changed")
    )
    return both.withColumn("change", change).filter("change IS NOT NULL").select("file_name", "change")


def archive_problems(archives: DataFrame, members: DataFrame, expected: dict[str, list[str]], max_bytes: int, same: list[str]) -> DataFrame:
    """(archive_id, problem, detail) of result archives that break their contract; sound ones give no row.

    ``archives`` (archive_id, schema_version, config, manifest: JSON texts), ``members`` (archive_id, name, size).
    The members must be those that the schema version expects, each once, with sizes that add up to no more than
    ``max_bytes``; config and manifest must be JSON objects that agree in the fields ``same``.
    """
    wanted = F.create_map(*[x for v, names in expected.items() for x in (F.lit(v), F.array(*map(F.lit, names)))])
    known = F.col("schema_version").isin(*expected)
    listed = members.groupBy("archive_id", "name").agg(F.count(F.lit(1)).alias("times"), F.min("size").alias("least"), F.sum("size").alias("bytes"))
    versions = archives.select("archive_id", "schema_version").filter(known)
    due = versions.select("archive_id", F.explode(wanted[F.col("schema_version")]).alias("name"), F.lit(True).alias("due"))
    met = due.join(listed, ["archive_id", "name"], "full").join(versions.select("archive_id"), "archive_id", "left_semi")
    problem = (
        F.when(F.col("times").isNull(), "member missing").when(F.col("due").isNull(), "member unexpected").when(F.col("times") > 1, "member twice")
    )
    by_member = met.withColumn("problem", problem).filter("problem IS NOT NULL").select("archive_id", "problem", F.col("name").alias("detail"))
    broken = listed.filter("least < 0").select("archive_id", F.lit("member size").alias("problem"), F.col("name").alias("detail"))
    heavy = listed.groupBy("archive_id").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > max_bytes)
    heavy = heavy.select("archive_id", F.lit("archive size").alias("problem"), F.col("bytes").cast("long").cast("string").alias("detail"))
    kind = "map<string,string>"
    parsed = archives.select("archive_id", "schema_version", F.from_json("config", kind).alias("c"), F.from_json("manifest", kind).alias("m"))
    checks = [F.when(~F.coalesce(known, F.lit(False)), F.struct(F.lit("schema version").alias("problem"), F.col("schema_version").alias("detail")))]
    for name, doc in (("config", "c"), ("manifest", "m")):
        checks.append(F.when(F.col(doc).isNull() | (F.size(doc) == 0), F.struct(F.lit("unreadable").alias("problem"), F.lit(name).alias("detail"))))
    both = F.col("c").isNotNull() & F.col("m").isNotNull()
    for name in same:
        differ = ~F.col("c")[name].eqNullSafe(F.col("m")[name])
        checks.append(F.when(both & differ, F.struct(F.lit("disagree").alias("problem"), F.lit(name).alias("detail"))))
    told = parsed.select("archive_id", F.explode(F.array_compact(F.array(*checks))).alias("p")).select("archive_id", "p.*")
    return told.unionByName(by_member).unionByName(broken).unionByName(heavy)
