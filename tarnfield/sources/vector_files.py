"""Map payloads to features: Overpass JSON, CityGML, legacy GML, geocoder XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.geo import project_points
from tarnfield.operators.vectors import assemble_relations

OVERPASS_SCHEMA = (
    "elements ARRAY<STRUCT<type: STRING, id: BIGINT, tags: MAP<STRING, STRING>, "
    "geometry: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>, "
    "members: ARRAY<STRUCT<role: STRING, geometry: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>>>>>"
)
GEOCODER_SCHEMA = (
    "geodetic STRING, iConf INT, converted STRING, "
    "candidate ARRAY<STRUCT<address: STRING, longitude: DOUBLE, latitude: DOUBLE, iLvl: INT>>"
)
# LOD elements of a building, best first.
LOD_ELEMENTS = ["lod0FootPrint", "lod0RoofEdge", "GroundSurface"]
# Coordinate systems a geocoder answer may be in.
WGS84_NAMES = ["wgs1984", "wgs84", "epsg:4326"]


def parse_overpass(payloads: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Overpass answers (area_id, json) to building rings and road lines in local metres.

    Ways need four points for a building and two for a road; building relations are assembled
    from their members, outer rings only.
    """
    parsed = payloads.select("area_id", F.from_json("json", OVERPASS_SCHEMA).alias("p"))
    elements = parsed.select("area_id", F.explode("p.elements").alias("e"))
    tags = F.coalesce(F.col("e.tags"), F.create_map().cast("map<string,string>"))
    building = F.map_contains_key(tags, "building") | F.map_contains_key(tags, "building:part")
    highway = F.map_contains_key(tags, "highway") & ~building
    relation = F.coalesce(F.col("e.type") == "relation", F.lit(False))
    size = F.size("e.geometry")
    layer = (
        F.when(building & ~relation & (size >= 4), "building").when(highway & (size >= 2), "road_line")
    )
    feature = F.concat_ws("/", "e.type", F.col("e.id").cast("string"))
    ways = elements.withColumn("layer", layer).filter("layer IS NOT NULL").select(
        "area_id", feature.alias("feature_id"), "layer", project_points(F.col("e.geometry"), lon0, lat0).alias("ring")
    )
    members = F.transform(
        "e.members",
        lambda m: F.struct(m["role"].alias("role"), project_points(m["geometry"], lon0, lat0).alias("line")),
    )
    key = F.concat_ws("|", "area_id", feature)
    relations = elements.filter(building & relation).select(key.alias("feature_id"), members.alias("members"))
    rings = assemble_relations(relations).filter("sign = 1").select(
        F.substring_index("feature_id", "|", 1).alias("area_id"),
        F.substring_index("feature_id", "|", -1).alias("feature_id"),
        F.lit("building").alias("layer"),
        "ring",
    )
    return ways.withColumn("area_id", F.col("area_id").cast("string")).unionByName(rings)


def numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double"))


def parse_positions(text: Column, dimension: Column) -> Column:
    """A posList (latitude first) to (lon, lat) points; NULL unless it is whole tuples, two at least."""
    values = numbers(text)
    n = F.size(values)
    ok = (n >= dimension * 2) & (n % dimension == 0)
    index = F.sequence(F.lit(0), F.floor(n / dimension).cast("int") - 1)
    points = F.transform(
        index,
        lambda i: F.struct(
            F.get(values, i * dimension + 1).alias("lon"), F.get(values, i * dimension).alias("lat")
        ),
    )
    return F.when(ok, points)


def _inner(name: str, whole: bool = False) -> str:
    """Pattern of an element by local name, whatever its prefix; group 1 is its content (``whole``: its name)."""
    end, content = (r"\1", ".*?") if whole else (name, "(.*?)")
    return rf"(?s)<(?:[\w.-]+:)?{name}(?=[\s>])[^>]*>{content}</(?:[\w.-]+:)?{end}>"


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row per ``tag`` element (with its prefix) and its inner text.

    The closing tag serves as record separator of the text source, so large files stay
    splittable and no file is parsed as a whole.
    """
    raw = spark.read.text(path, lineSep=f"</{tag}>")
    opened = rf"(?s)<{tag}(?=[\s>])[^>]*>(.*)$"
    own = F.regexp_extract("value", rf'(?s)<{tag}(?=[\s>])[^>]*\bid="([^"]+)"', 1)
    return raw.filter(F.col("value").rlike(opened)).select(
        F.regexp_extract("value", opened, 1).alias("xml"),
        F.when(own != "", own).otherwise(F.hex(F.xxhash64("value"))).alias("element_id"),
    )


def parse_shape(xml: Column) -> Column:
    """Points of a ring or line: its posList, or its single pos elements in order.

    The dimension is the shape's own ``srsDimension``; without one, single positions tell theirs by their length
    and lists have three numbers a point.
    """
    listed = F.regexp_extract(xml, _inner("posList"), 1)
    single = F.regexp_extract_all(xml, F.lit(_inner("pos")), F.lit(1))
    told = F.regexp_extract(xml, r'srsDimension="(\d)"', 1).try_cast("int")
    in_list = parse_positions(listed, F.coalesce(told, F.lit(3)))
    in_singles = parse_positions(F.concat_ws(" ", single), F.coalesce(told, F.size(numbers(F.get(single, F.lit(0))))))
    return F.when(F.trim(listed) != "", in_list).when(F.size(single) > 0, in_singles)


def polygon_rings(xml: Column) -> Column:
    """Exterior rings (four points at least) of all polygons in an element's text."""
    outers = F.flatten(
        F.transform(
            F.regexp_extract_all(xml, F.lit(_inner("Polygon")), F.lit(1)),
            lambda p: F.slice(F.regexp_extract_all(p, F.lit(_inner("exterior")), F.lit(1)), 1, 1),
        )
    )
    rings = F.transform(outers, parse_shape)
    return F.filter(rings, lambda r: r.isNotNull() & (F.size(r) >= 4))


def citygml_buildings(elements: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Footprints per building from the best LOD that has a polygon, else from any polygon."""
    options = []
    for name in LOD_ELEMENTS:
        inside = F.concat_ws("\n", F.regexp_extract_all("xml", F.lit(_inner(name)), F.lit(1)))
        options.append(polygon_rings(inside))
    options.append(polygon_rings(F.col("xml")))
    chosen = F.coalesce(*[F.when(F.size(o) > 0, o) for o in options])
    return elements.select("element_id", F.posexplode(chosen).alias("part", "ll")).select(
        F.concat_ws("/", F.lit("building"), "element_id", "part").alias("feature_id"),
        F.lit("building").alias("layer"),
        project_points(F.col("ll"), lon0, lat0).alias("ring"),
    )


def citygml_roads(elements: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Road polygons where an element has any, else its lines."""
    areas = polygon_rings(F.col("xml"))
    shapes = F.regexp_extract_all("xml", F.lit(_inner("(LineString|Curve|posList)", whole=True)), F.lit(0))
    lines = F.filter(F.transform(shapes, parse_shape), lambda r: r.isNotNull())
    chosen = elements.select(
        "element_id",
        F.when(F.size(areas) > 0, F.lit("road_polygon")).otherwise(F.lit("road_line")).alias("layer"),
        F.when(F.size(areas) > 0, areas).otherwise(lines).alias("shapes"),
    )
    return chosen.select("element_id", "layer", F.posexplode("shapes").alias("part", "ll")).select(
        F.concat_ws("/", F.lit("road"), "element_id", "part").alias("feature_id"),
        "layer",
        project_points(F.col("ll"), lon0, lat0).alias("ring"),
    )


def parse_basic_items(files: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Legacy files (name, text) to layers by file name, kept where their extent meets the box.

    ``box`` is (lon_min, lat_min, lon_max, lat_max).
    """
    layer = F.when(F.contains("name", F.lit("-BldA-")), "building").when(
        F.contains("name", F.lit("-RdEdg-")), "road_edge"
    )
    lists = files.withColumn("layer", layer).filter("layer IS NOT NULL").select(
        "name", "layer", F.posexplode(F.regexp_extract_all("text", F.lit(_inner("posList")), F.lit(1))).alias("part", "t")
    )
    points = lists.select("name", "layer", "part", parse_positions(F.col("t"), F.lit(2)).alias("ll")).filter("ll IS NOT NULL")
    lons, lats = F.transform("ll", lambda p: p["lon"]), F.transform("ll", lambda p: p["lat"])
    meets = (
        (F.array_max(lats) >= box[1]) & (F.array_min(lats) <= box[3])
        & (F.array_max(lons) >= box[0]) & (F.array_min(lons) <= box[2])
    )
    return points.filter(meets)


def _judged(responses: DataFrame, limit: int) -> DataFrame:
    """Parsed answers, their first candidates, and why an answer is refused (NULL where it is not)."""
    parsed = responses.select("query_id", F.from_xml("xml", GEOCODER_SCHEMA).alias("r"))
    first = F.slice(F.coalesce("r.candidate", F.array().cast(parsed.schema["r"].dataType["candidate"].dataType)), 1, limit)
    within = lambda x, most: F.coalesce(F.abs(x) <= most, F.lit(False)) & ~F.isnan(x)
    problem = (
        F.when(~F.coalesce(F.lower("r.geodetic").isin(*WGS84_NAMES), F.lit(False)), "coordinate_system")
        .when(F.exists("first", lambda c: F.coalesce(F.trim(c["address"]) == "", F.lit(True))), "address")
        .when(F.exists("first", lambda c: ~F.coalesce(within(c["longitude"], 180.0), F.lit(False))), "longitude")
        .when(F.exists("first", lambda c: ~F.coalesce(within(c["latitude"], 90.0), F.lit(False))), "latitude")
    )
    return parsed.withColumn("first", first).withColumn("problem", problem)


def parse_geocoder(responses: DataFrame, limit: int = 10) -> DataFrame:
    """Geocoder answers (query_id, xml) to their first candidates in order; refused answers give none."""
    usable = _judged(responses, limit).filter("problem IS NULL")
    return usable.select("query_id", "r.iConf", "r.converted", F.posexplode("first").alias("pos", "c")).select(
        "query_id",
        "pos",
        F.col("c.address").alias("title"),
        F.col("c.longitude").alias("lon"),
        F.col("c.latitude").alias("lat"),
        F.col("iConf").alias("confidence"),
        F.col("c.iLvl").alias("level"),
        "converted",
    )


def refused_geocoders(responses: DataFrame, limit: int = 10) -> DataFrame:
    """Answers that are refused whole: another coordinate system, or a candidate without address or place."""
    return _judged(responses, limit).filter("problem IS NOT NULL").select("query_id", "problem")


def unsupported_geocoders(responses: DataFrame) -> DataFrame:
    """Answers in another coordinate system."""
    parsed = responses.select("query_id", F.from_xml("xml", GEOCODER_SCHEMA).alias("r"))
    ok = F.coalesce(F.lower("r.geodetic").isin(*WGS84_NAMES), F.lit(False))
    return parsed.filter(~ok).select("query_id", F.col("r.geodetic").alias("geodetic"))
