"""Stations, ranked events, scenarios, forcing and catalogue order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfield.functions.columns import official_url, plain_number, short_id
from tarnfield.operators import rain, timeline
from tarnfield.operators.ordered import top_per_key
from tarnfield.plans import adapters as A
from tarnfield.plans.cube_queries import r6
from tarnfield.plans.registry import query
from tarnfield.runtime import scratch_path
from tarnfield.sources import catalogue

HAVERSINE = """2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2)
   + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"""


@query(
    "m1_station_distances",
    "rain_events stations points",
    f"""SELECT event_id, round({HAVERSINE}, 6) AS distance_km FROM (SELECT event_id, station_id, event_id % (SELECT count(*) FROM points) AS point_id
         FROM rain_events) e JOIN points p USING (point_id) JOIN stations s USING (station_id)""",
)
def m1(spark, folder):
    from tarnfield.functions.geo import haversine_km

    points = A.points(spark, folder)
    events = A.rain_events(spark, folder).withColumn("point_id", F.col("event_id") % points.count())
    sites = A.stations(spark, folder).select("station_id", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    joined = events.join(points, "point_id").join(sites, "station_id")
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    return joined.select("event_id", r6(km, "distance_km"))


NEAREST = f""", d AS (SELECT point_id, station_id, {HAVERSINE} AS km FROM points p, stations s),
  ranked AS (SELECT point_id, station_id, km, row_number() OVER (PARTITION BY point_id ORDER BY km, station_id) AS rank FROM d) """


@query(
    "j1_nearest_stations",
    "points stations",
    NEAREST + "SELECT point_id, station_id, round(km, 6) AS distance_km, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5",
)
def j1(spark, folder):
    found = rain.nearest_stations(A.points(spark, folder), A.stations(spark, folder), 5)
    return found.withColumn("distance_km", F.round("distance_km", 6))


@query(
    "t1_nearest_one",
    "points stations",
    NEAREST + "SELECT point_id, station_id FROM ranked WHERE rank = 1",
)
def t1(spark, folder):
    return rain.nearest_stations(A.points(spark, folder), A.stations(spark, folder), 1).select("point_id", "station_id")


@query(
    "j2_event_station_lookup",
    "rain_events stations",
    """SELECT event_id, station_id, name, duration_minutes, total_mm FROM rain_events JOIN stations USING (station_id)""",
)
def j2(spark, folder):
    joined = A.rain_events(spark, folder).join(A.stations(spark, folder), "station_id")
    return joined.select("event_id", "station_id", "name", "duration_minutes", "total_mm")


@query(
    "j2_unknown_stations",
    "rain_events stations",
    """, told AS (SELECT o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS station_id FROM orders)
       SELECT event_id, station_id FROM told ANTI JOIN stations USING (station_id)""",
)
def j2_unknown(spark, folder):
    """Events told of a customer's own number, which need not be a station."""
    told = A.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("station_id")
    )
    return told.join(A.stations(spark, folder).select("station_id"), "station_id", "left_anti").select("event_id", "station_id")


@query(
    "j3_referential_errors",
    "rain_events stations",
    """, ev AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE '' END || e.station_id AS station_id,
           name || CASE WHEN event_id % 17 = 0 THEN '?' ELSE '' END AS sname, lon + CASE WHEN event_id % 19 = 0 THEN 1e-6 ELSE 0 END AS slon, lat AS slat
         FROM rain_events e JOIN stations s ON s.station_id = e.station_id),
       chk AS (SELECT event_id, CASE WHEN s.name IS NULL THEN 'unknown_station' WHEN sname <> s.name THEN 'name_mismatch'
           WHEN abs(slon - s.lon) > 1e-12 OR abs(slat - s.lat) > 1e-12 THEN 'place_mismatch' END AS problem
         FROM ev LEFT JOIN stations s USING (station_id))
       SELECT event_id, problem FROM chk WHERE problem IS NOT NULL""",
)
def j3(spark, folder):
    stations = A.stations(spark, folder)
    key = F.col("event_id")
    events = A.rain_events(spark, folder).join(stations, "station_id")
    shaped = events.select(
        "event_id",
        F.concat(F.when(key % 13 == 0, "x").otherwise(""), "station_id").alias("station_id"),
        F.concat("name", F.when(key % 17 == 0, "?").otherwise("")).alias("station_name"),
        (F.col("lon") + F.when(key % 19 == 0, 1e-6).otherwise(0.0)).alias("station_lon"),
        F.col("lat").alias("station_lat"),
    )
    return rain.referential_errors(shaped, stations)


@query(
    "a27_missing_durations",
    "rain_events",
    """, seen AS (SELECT CAST(o_custkey AS VARCHAR) AS station_id, list(DISTINCT duration_minutes) AS have
         FROM rain_events JOIN orders ON o_orderkey = event_id GROUP BY 1)
       SELECT station_id, list_sort(list_filter([10, 60, 1440], lambda d: NOT list_contains(have, d))) AS missing FROM seen
       WHERE len(list_filter([10, 60, 1440], lambda d: NOT list_contains(have, d))) > 0""",
)
def a27(spark, folder):
    """Every event counts for the customer it was told by; a few customers lack a duration."""
    teller = A.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("station_id")
    )
    return rain.missing_durations(A.rain_events(spark, folder).drop("station_id").join(teller, "event_id"))


RANKED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY station_id, duration_minutes ORDER BY total_mm DESC, event_id) AS rn FROM rain_events) """


@query(
    "t1_top_events_per_station",
    "rain_events",
    RANKED + "SELECT event_id, station_id, duration_minutes, total_mm, CAST(rn AS INT) AS rank FROM ranked WHERE rn <= 10",
)
def top_events(spark, folder):
    order = [F.col("total_mm").desc(), F.col("event_id")]
    best = top_per_key(A.rain_events(spark, folder), ["station_id", "duration_minutes"], order, 10, F.col("event_id"))
    return best.select("event_id", "station_id", "duration_minutes", "total_mm", "rank")


ID_SQL = """'jma-' || substr(sha256(concat_ws('|', station_id, CAST(duration_minutes AS VARCHAR),
   regexp_replace(regexp_replace(printf('%.9f', total_mm), '0+$', ''), '\\.$', ''), coalesce(CAST({rank} AS VARCHAR), ''),
   strftime(event_date, '%Y-%m-%d'), 'https://www.jma.go.jp/rank')), 1, 24)"""


def identified(spark, folder):
    order = [F.col("total_mm").desc(), F.col("event_id")]
    events = A.rain_events(spark, folder)
    best = top_per_key(events, ["station_id", "duration_minutes"], order, 10, F.col("event_id"))
    ranks = best.select("event_id", "rank")
    shaped = events.join(ranks, "event_id", "left").withColumns(
        {
            "source_key": F.col("event_id"),
            "event_date": F.date_format("event_date", "yyyy-MM-dd"),
            "source_url": F.lit("https://www.jma.go.jp/rank"),
        }
    )
    return shaped.withColumn("event_id", rain.event_id())


@query(
    "m8_event_ids",
    "rain_events",
    RANKED + f"SELECT event_id AS source_key, {ID_SQL.format(rank='CASE WHEN rn <= 10 THEN rn END')} AS event_id FROM ranked",
)
def m8(spark, folder):
    return identified(spark, folder).select("source_key", "event_id")


@query(
    "w10_catalogue_order",
    "rain_events",
    RANKED
    + f""", ids AS (SELECT {ID_SQL.format(rank='CASE WHEN rn <= 10 THEN rn END')} AS event_id, CASE WHEN rn <= 10 THEN rn END AS rank FROM ranked)
       SELECT event_id, row_number() OVER (ORDER BY rank IS NULL, rank, event_id) AS position FROM ids""",
)
def w10(spark, folder):
    return rain.order_events(identified(spark, folder).select("event_id", "rank")).select("event_id", "position")


@query(
    "s8_catalogue_round_trip",
    "rain_events",
    RANKED
    + f"""SELECT {ID_SQL.format(rank='CASE WHEN rn <= 10 THEN rn END')} AS event_id, station_id, duration_minutes,
       total_mm AS total_precipitation_mm, CAST(CASE WHEN rn <= 10 THEN rn END AS INT) AS rank FROM ranked""",
)
def s8(spark, folder):
    path = scratch_path(spark, "events")
    events = identified(spark, folder).select(
        "event_id", "station_id", "duration_minutes", F.col("total_mm").alias("total_precipitation_mm"), "rank"
    )
    catalogue.write_events(events, path)
    names = ["event_id", "station_id", "duration_minutes", "total_precipitation_mm", "rank"]
    return catalogue.read_events(spark, path).select(*names)


@query(
    "t3_station_prefix",
    "stations",
    "SELECT station_id, name FROM stations ORDER BY s_suppkey LIMIT 25",
)
def t3(spark, folder):
    return A.stations(spark, folder).orderBy("s_suppkey").limit(25).select("station_id", "name")


@query(
    "p22_scenario_series",
    "rain_events",
    """, sc AS (SELECT o_orderkey AS scenario_id, CASE o_orderkey % 5 WHEN 0 THEN 'constant' WHEN 1 THEN 'historical_observed_profile' ELSE 'historical_uniform' END AS kind,
           CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 700 * 1.0::DOUBLE END AS intensity, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 11000 AS INT) END AS minutes,
           CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey + CASE WHEN o_orderkey % 29 = 0 THEN 100000000 ELSE 0 END END AS eid FROM orders),
       res AS (SELECT scenario_id, kind, e.event_id, CASE WHEN kind = 'constant' THEN minutes ELSE e.duration_minutes END AS d,
           CASE WHEN kind = 'constant' THEN intensity ELSE e.total_mm / (e.duration_minutes / 60.0::DOUBLE) END AS r FROM sc LEFT JOIN rain_events e ON e.event_id = sc.eid),
       chk AS (SELECT *, CASE WHEN kind = 'historical_observed_profile' THEN 'profile_unavailable' WHEN kind = 'historical_uniform' AND event_id IS NULL THEN 'event_unavailable'
           WHEN r IS NULL OR r <= 0 OR r > 500 THEN 'rate_out_of_range' WHEN d IS NULL OR d < 1 OR d > 10080 THEN 'duration_out_of_range' END AS problem FROM res)
       SELECT scenario_id, problem, NULL::DOUBLE AS elapsed_s, NULL::DOUBLE AS intensity FROM chk WHERE problem IS NOT NULL
       UNION ALL SELECT scenario_id, problem, k * d * 60.0::DOUBLE, r FROM chk, (VALUES (0), (1)) x(k) WHERE problem IS NULL""",
)
def p22(spark, folder):
    key = F.col("o_orderkey")
    scenarios = A.table(spark, folder, "orders").select(
        key.alias("scenario_id"),
        F.when(key % 5 == 0, "constant")
        .when(key % 5 == 1, "historical_observed_profile")
        .otherwise("historical_uniform")
        .alias("kind"),
        F.when(key % 5 == 0, (key % 700).cast("double")).alias("intensity"),
        F.when(key % 5 == 0, (key % 11000).cast("int")).alias("minutes"),
        F.when(key % 5 > 1, key + F.when(key % 29 == 0, 100000000).otherwise(0)).alias("event_id"),
    )
    return rain.resolve_scenarios(scenarios, A.rain_events(spark, folder))


@query(
    "p23_distributed_forcing",
    "cells",
    """, w AS (SELECT "row", col, "row" // 20 AS area_id, CASE WHEN building THEN 0.0 WHEN road THEN 1.5 ELSE 1.0 END AS rain_weight FROM cells),
       s AS (SELECT s_suppkey % 7 AS area_id, s_suppkey // 7 * 60.0::DOUBLE AS elapsed_s, s_suppkey % 90 * 1.0::DOUBLE AS intensity FROM supplier)
       SELECT CAST(w.area_id AS BIGINT) AS area_id, "row", col, elapsed_s, round(intensity * rain_weight, 6) AS rate FROM w LEFT JOIN s ON s.area_id = w.area_id""",
)
def p23(spark, folder):
    weight = F.when(F.col("building"), 0.0).when(F.col("road"), 1.5).otherwise(1.0)
    cells = A.cells(spark, folder).select(
        "row", "col", A.int_div(F.col("row"), 20).alias("area_id"), weight.alias("rain_weight")
    )
    key = F.col("s_suppkey")
    series = A.table(spark, folder, "supplier").select(
        (key % 7).alias("area_id"), (A.int_div(key, 7) * 60.0).alias("elapsed_s"), (key % 90).cast("double").alias("intensity")
    )
    return rain.distributed_forcing(series, cells).withColumn("rate", F.round("rate", 6))


@query(
    "w7_series_not_increasing",
    "",
    """WITH s AS (SELECT user_id AS run, event_id AS seq, event_id * 7 % 1009 AS elapsed FROM events),
       l AS (SELECT *, lag(elapsed) OVER (PARTITION BY run ORDER BY seq) AS prev_elapsed FROM s)
       SELECT * FROM l WHERE elapsed <= prev_elapsed""",
)
def w7(spark, folder):
    series = A.table(spark, folder, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 1009).alias("elapsed")
    )
    return timeline.not_increasing(series, "run", "seq", "elapsed", chunk=2000)


@query(
    "m12_official_urls",
    "",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/:?#]+)', ['scheme', 'host']) AS x FROM pages)
       SELECT page_id, x.scheme = 'https' AND (x.host = 'example.net' OR ends_with(x.host, '.example.net')) AS official FROM p""",
)
def m12(spark, folder):
    return A.table(spark, folder, "pages").select("page_id", official_url(F.col("url"), "example.net").alias("official"))


@query(
    "s6_ranked_cells",
    "",
    """WITH li AS (SELECT page_id, url, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages),
       c AS (SELECT page_id, url, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS rank FROM li),
       t AS (SELECT page_id, url, CAST(rank AS INT) AS rank, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS label FROM c)
       SELECT page_id, rank, label, 'jma-' || substr(sha256(page_id || '|' || rank || '|' || label), 1, 24) AS cell_id
       FROM t WHERE rank <= 10 AND label NOT IN ('', '--', '///', '×', '-')""",
)
def s6(spark, folder):
    pages = A.table(spark, folder, "pages").select("page_id", F.col("html").alias("row_html"))
    ranked = catalogue.ranked_cells(pages, r"(?s)<li>(.*?)</li>", first_rank=1)
    cell_id = short_id("jma-", [F.col("page_id"), F.col("rank"), F.col("text")])
    return ranked.filter(~F.col("text").isin(*catalogue.BLANK_CELLS)).select(
        "page_id", "rank", F.col("text").alias("label"), cell_id.alias("cell_id")
    )


@query(
    "s6_ranking_events",
    "",
    """WITH p AS (SELECT s_suppkey AS k, unnest([10, 60, 1440]) AS minutes, unnest([3, 5, 7]) AS factor FROM supplier),
       c AS (SELECT *, unnest(range(1, 13)) AS r FROM p),
       v AS (SELECT *, (k * factor + r * 17) % 400 AS amount, (k + r) % 6 AS kind FROM c)
       SELECT CAST(k AS VARCHAR) AS station_id, minutes::INT AS duration_minutes, r::INT AS rank, amount / 2.0::DOUBLE AS total_mm,
         CASE WHEN kind <> 3 THEN '20' || lpad((k % 24)::VARCHAR, 2, '0') || '/' || r || '/1' END AS event_date,
         CASE kind WHEN 1 THEN '*' WHEN 2 THEN ']' ELSE '' END AS flags
       FROM v WHERE r <= 10 AND kind <> 0 AND amount > 0""",
)
def s6_events(spark, folder):
    """A ranking page per supplier: three known rows of twelve cells (the last two beyond the ranks) and one unknown row."""
    key = F.col("s_suppkey")

    def cell(factor):
        def one(r):
            amount, kind = (key * factor + r * 17) % 400 / F.lit(2.0), (key + r) % 6
            flag = F.when(kind == 1, "*").when(kind == 2, " ]").otherwise("")
            date = F.concat(F.lit("<br>(20"), F.lpad((key % 24).cast("string"), 2, "0"), F.lit("/"), r.cast("string"), F.lit("/1)"))
            told = F.concat(amount.cast("string"), flag, F.when(kind != 3, date).otherwise(""))
            return F.concat(F.lit("<td>"), F.when(kind == 0, "--").otherwise(told), F.lit("</td>"))

        return one

    labels = [("日最大10分間降水量(mm)", 3), ("日最大1時間降水量(mm)", 5), ("日降水量", 7), ("月最大3時間降水量の多い方から", 9)]
    rows = [
        F.concat(F.lit(f"<tr><td>{label}</td>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), cell(factor)), ""), F.lit("</tr>"))
        for label, factor in labels
    ]
    pages = A.stations(spark, folder).select(
        "station_id",
        F.col("name").alias("station_name"),
        F.col("lon").alias("station_lon"),
        F.col("lat").alias("station_lat"),
        F.lit("https://example.org/rank").alias("source_url"),
        F.concat(F.lit("<table>"), *rows, F.lit("</table>")).alias("html"),
        "s_suppkey",
    )
    return catalogue.parse_ranking_pages(pages).select(
        "station_id", "duration_minutes", "rank", "total_mm", "event_date", F.array_join("data_quality_flags", ",").alias("flags")
    )


@query(
    "w1_rank_by_position",
    "",
    """WITH li AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages),
       c AS (SELECT page_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS rank FROM li),
       t AS (SELECT page_id, CAST(rank AS INT) AS rank, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS label FROM c)
       SELECT page_id, rank, label FROM t WHERE rank <= 10""",
)
def w1(spark, folder):
    pages = A.table(spark, folder, "pages").select("page_id", F.col("html").alias("row_html"))
    ranked = catalogue.ranked_cells(pages, r"(?s)<li>(.*?)</li>", first_rank=1)
    return ranked.select("page_id", "rank", F.col("text").alias("label"))


@query(
    "t2_candidate_cap",
    "",
    """WITH li AS (SELECT page_id, regexp_extract_all(html, '<p>', 0) AS items FROM pages),
       c AS (SELECT page_id, unnest(range(1, len(items) + 1)) AS rank FROM li)
       SELECT page_id, count(*) AS kept FROM c WHERE rank <= 10 GROUP BY 1""",
)
def t2(spark, folder):
    found = A.table(spark, folder, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("pos", "item")
    )
    return found.filter("pos < 10").groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "m7_plain_numbers",
    "",
    "SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.9f', o_totalprice), '0+$', ''), '\\.$', '') AS label FROM orders",
)
def m7(spark, folder):
    return A.table(spark, folder, "orders").select("o_orderkey", plain_number(F.col("o_totalprice")).alias("label"))


@query(
    "m7_normal_labels",
    "",
    """WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS item FROM pages)
       SELECT page_id, regexp_replace(nfc_normalize(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&amp;', '&')), '\\s', '', 'g') AS label,
         count(*) AS n FROM li GROUP BY ALL""",
)
def m7_labels(spark, folder):
    items = A.table(spark, folder, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))).alias("item")
    )
    text = F.regexp_replace("item", "<[^>]*>", "")
    labels = items.select("page_id", catalogue.normal_label(text).alias("label"))
    return labels.groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w11_first_per_key",
    "",
    """SELECT o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1""",
)
def w11(spark, folder):
    rank = F.struct("o_orderdate", "o_orderkey")
    return A.table(spark, folder, "orders").groupBy("o_custkey").agg(F.min(rank)["o_orderkey"].alias("first_order"))


@query("t5_distinct_first", "", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def t5(spark, folder):
    return A.table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query(
    "t6_set_difference",
    "",
    "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier",
)
def t6(spark, folder):
    required = A.table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    present = A.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"))
    return required.join(present, "k", "left_anti")


@query(
    "s5_station_master",
    "stations",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS station_id, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM stations
       WHERE s_suppkey % 6 < 4""",
)
def s5(spark, folder):
    path = scratch_path(spark, "stations")
    sites = A.stations(spark, folder)
    kinds = F.array(*[F.lit(k) for k in ("四", "三", "官", "雨", "雪", "日")])
    kind = F.element_at(kinds, (F.col("s_suppkey") % 6 + 1).cast("int"))

    def degrees(name):
        whole = F.floor(name)
        return whole.cast("string"), F.format_string("%.1f", (F.col(name) - whole) * 60)

    lat_d, lat_m = degrees("lat")
    lon_d, lon_m = degrees("lon")
    rows = sites.select(
        F.lit("石狩"), F.lpad("station_id", 5, "0"), kind, "name", F.lit("カナ"), F.lit("-"), F.lit("-"),
        lat_d, lat_m, lon_d, lon_m, F.lit("10"),
    ).toDF(*catalogue.STATION_HEADER)
    rows.unionByName(rows).write.option("header", True).csv(path)
    found = catalogue.read_stations(spark, path)
    return found.select("station_id", "name", r6(F.col("lon_deg"), "lon"), r6(F.col("lat_deg"), "lat"))


@query(
    "s7_catalogue_documents",
    "rain_events",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, station_id, duration_minutes, total_mm AS total_precipitation_mm FROM rain_events""",
)
def s7(spark, folder):
    path = scratch_path(spark, "documents")
    event = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        "station_id",
        "duration_minutes",
        F.col("total_mm").alias("total_precipitation_mm"),
    )
    document = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.array(event).alias("events")))
    A.rain_events(spark, folder).select(document.alias("value")).write.text(path)
    found = catalogue.load_catalogue(spark, path, "events", multi_line=False)
    return found.select("event_id", "station_id", "duration_minutes", "total_precipitation_mm")


@query(
    "m13_nice_numbers",
    "",
    """WITH c AS (SELECT o_orderkey, o_totalprice AS v, m * pow(10.0, floor(log10(o_totalprice)) + d) AS n FROM orders,
         (VALUES (1.0::DOUBLE), (1.25), (1.5), (2.0), (2.5), (3.0), (4.0), (5.0), (7.5), (10.0)) x(m), (VALUES (-1), (0), (1)) y(d))
       SELECT o_orderkey, round(arg_min(n, row(abs(n - v), n)), 3) AS nice FROM c GROUP BY 1""",
)
def m13(spark, folder):
    from tarnfield.functions.columns import nice_numbers

    price = F.col("o_totalprice")
    return A.table(spark, folder, "orders").select("o_orderkey", F.round(F.get(nice_numbers(price), 0), 3).alias("nice"))
