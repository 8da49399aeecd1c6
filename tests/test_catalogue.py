import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnfield.functions.columns import official_url
from tarnfield.operators import nearest, rain, timeline, validate
from tarnfield.sources import catalogue

HEADER = ",".join(catalogue.STATION_HEADER)
ROWS = [
    "東京,44132,官,東京,トウキヨウ,東京,千代田区,35,41.5,139,45.0,25",
    "東京,44173,四,大島,オオシマ,大島,大島町,34,44.9,139,21.8,74",
    "東京,44199,雪,雪のみ,ユキ,-,-,35,0.0,139,0.0,1",
    "東京,44132,官,別名,ベツメイ,-,-,36,0.0,140,0.0,1",
]


@pytest.mark.parametrize("charset", ["utf-8", "utf-8-sig", "cp932"])
def test_station_master(spark, tmp_path, charset):
    (tmp_path / "s.csv").write_bytes("\r\n".join([HEADER, *ROWS]).encode(charset))
    got = {r["station_id"]: r for r in catalogue.read_stations(spark, str(tmp_path)).collect()}
    assert set(got) == {"44132", "44173"}
    assert got["44132"]["name"] == "東京"
    assert got["44132"]["lat_deg"] == pytest.approx(35 + 41.5 / 60)
    assert got["44173"]["lon_deg"] == pytest.approx(139 + 21.8 / 60)


@pytest.mark.parametrize("bad", ["東京,4413,官,東京,,,,35,0,139,0,1", "東京,44133,官,,,,,35,0,139,0,1", "東京,44133,官,東京,,,,x,0,139,0,1"])
def test_broken_station_rows_are_refused(spark, tmp_path, bad):
    (tmp_path / "s.csv").write_text("\n".join([HEADER, bad]), encoding="utf-8")
    with pytest.raises(catalogue.CatalogueError):
        catalogue.read_stations(spark, str(tmp_path))


def test_station_header_contract(spark, tmp_path):
    (tmp_path / "s.csv").write_text("\n".join(["a,b,c,d,e,f,g,h,i,j,k,l", *ROWS]), encoding="utf-8")
    with pytest.raises(catalogue.CatalogueError):
        catalogue.read_stations(spark, str(tmp_path))


PAGE = """<table><tr><th>要素名／順位</th><th>1位</th><th>2位</th><th>3位</th></tr>
<tr><td>日最大10分間降水量の多い方から</td><td>31.5*<br>(2019/8/1)</td><td>--</td><td>20.0 ]<br>(2001/7/2)</td></tr>
<tr><td>日最大1時間降水量(10分間隔）の多い方から</td><td>80.0<br>(2000/7/4 12:30)</td><td>×</td><td>0.0<br>(2000/1/1)</td></tr>
<tr><td>日降水量</td><td>250<br>(2013/10/16)</td></tr>
<tr><td>月最大3時間降水量の多い方から</td><td>999.0<br>(2020/1/1)</td></tr>
<tr><td>日最大1時間降水量</td><td>888.0<br>(2020/1/2)</td></tr></table>"""


def ranking(spark, html):
    schema = "station_id string, station_name string, station_lon double, station_lat double, source_url string, html string"
    return spark.createDataFrame([("44132", "東京", 139.75, 35.69, "https://www.jma.go.jp/x", html)], schema)


def test_ranking_page(spark):
    got = catalogue.parse_ranking_pages(ranking(spark, PAGE)).orderBy("duration_minutes", "rank").collect()
    assert [(r["duration_minutes"], r["rank"], r["total_mm"]) for r in got] == [(10, 1, 31.5), (10, 3, 20.0), (60, 1, 80.0), (1440, 1, 250.0)]
    assert [r["data_quality_flags"] for r in got] == [["*"], ["]"], [], []]
    assert got[2]["event_date"] == "2000/7/4 12:30"
    assert len(set(r["event_id"] for r in got)) == 4 and all(len(r["event_id"]) == 28 for r in got)


def test_period_column_is_not_an_eleventh_rank(spark):
    cells = "".join(f"<td>{50 - i}.0</td>" for i in range(10)) + "<td>1937/1</td>"
    got = catalogue.parse_ranking_pages(ranking(spark, f"<table><tr><td>日降水量(mm)</td>{cells}</tr></table>"))
    assert got.count() == 10 and got.agg(F.max("rank")).first()[0] == 10


def test_catalogue_version(spark, tmp_path):
    event = {"event_id": "e", "station_id": "s", "duration_minutes": 10, "rank": None}
    for version, path in (("1", tmp_path / "a.json"), ("2", tmp_path / "b.json")):
        path.write_text(json.dumps({"schema_version": version, "events": [event]}, indent=1))
    assert catalogue.load_catalogue(spark, str(tmp_path / "a.json"), "events").first()["event_id"] == "e"
    with pytest.raises(catalogue.CatalogueError):
        catalogue.load_catalogue(spark, str(tmp_path / "b.json"), "events")


def test_event_rules(spark):
    good = dict(event_id="a", station_id="s", station_lon_deg=139.0, station_lat_deg=35.0, duration_minutes=10,
                total_precipitation_mm=5.0, rank=1, profile_available=False, profile_id=None)
    cases = {"rank": dict(rank=11), "total": dict(total_precipitation_mm=float("nan")), "latitude": dict(station_lat_deg=91.0),
             "profile": dict(profile_available=True), "profile_id": dict(profile_id=" "), "station_id": dict(station_id=" ")}
    rows = [good] + [{**good, **change, "event_id": name} for name, change in cases.items()] + [dict(good, event_id="a")]
    schema = ("event_id string, station_id string, station_lon_deg double, station_lat_deg double, duration_minutes int, "
              "total_precipitation_mm double, rank int, profile_available boolean, profile_id string")
    got = {(r["event_id"], r["rule"]) for r in validate.event_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(n, n) for n in cases} | {("a", "duplicate")}


def test_scenarios(spark):
    schema = "scenario_id int, kind string, intensity double, minutes int, event_id string"
    rows = [(1, "constant", 20.0, 30, None), (2, "historical_uniform", None, None, "e"), (3, "historical_uniform", None, None, "x"),
            (4, "historical_observed_profile", None, None, "e"), (5, "constant", 501.0, 30, None), (6, "constant", 5.0, 20000, None), (7, "other", 1.0, 1, None)]
    events = spark.createDataFrame([("e", 60.0, 120)], "event_id string, total_mm double, duration_minutes int")
    got = rain.resolve_scenarios(spark.createDataFrame(rows, schema), events).collect()
    series = {(r["scenario_id"], r["elapsed_s"]): r["intensity"] for r in got if r["problem"] is None}
    assert series == {(1, 0.0): 20.0, (1, 1800.0): 20.0, (2, 0.0): 30.0, (2, 7200.0): 30.0}
    assert {r["scenario_id"]: r["problem"] for r in got if r["problem"]} == {
        3: "event_unavailable", 4: "profile_unavailable", 5: "rate_out_of_range", 6: "duration_out_of_range", 7: "unsupported_kind"}


def brute(points, sites, k, metric):
    return {p[0]: [s[0] for s in sorted(sites, key=lambda s: (metric(p, s), s[0]))[:k]] for p in points}


def km(p, s):
    a = math.sin(math.radians(s[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(s[2])) * math.sin(math.radians(s[1] - p[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, a)))


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_on_the_sphere(spark, k):
    rng = np.random.default_rng(k)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(-85, 85, 60)))]
    sites += [(100 + i, 179.9 - i / 50, 10.0) for i in range(20)] + [(200 + i, 5.0, 5.0) for i in range(50)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 80), rng.uniform(-89, 89, 80)))]
    points += [(900, -179.9, 10.0), (901, 5.0, 5.0), (902, 0.0, 89.9)]
    got = nearest.nearest_k(
        spark.createDataFrame(points, "point_id int, x double, y double"),
        spark.createDataFrame(sites, "site_id int, x double, y double"), k, sphere=True)
    found = {}
    for r in got.orderBy("point_id", "rank").collect():
        found.setdefault(r["point_id"], []).append(r["site_id"])
    assert found == brute(points, sites, k, km)


def test_nearest_in_the_plane_without_self(spark):
    rng = np.random.default_rng(7)
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.exponential(5, 150), rng.exponential(5, 150)))]
    nodes += [(500 + i, 2.0, 2.0) for i in range(40)]
    got = nearest.nearest_k(
        spark.createDataFrame(nodes, "point_id int, x double, y double"),
        spark.createDataFrame(nodes, "site_id int, x double, y double"), 2, skip_self=True)
    found = {}
    for r in got.orderBy("point_id", "rank").collect():
        found.setdefault(r["point_id"], []).append(r["site_id"])
    for p in nodes:
        others = [s for s in nodes if s[0] != p[0]]
        assert found[p[0]] == brute([p], others, 2, lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2]))[p[0]]


def test_points_of_one_place_are_searched_for_once(spark, monkeypatch):
    searched = []
    search = nearest._nearest
    monkeypatch.setattr(nearest, "_nearest", lambda points, *rest: searched.append(points.count()) or search(points, *rest))
    points = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 6).cast("double").alias("x"), F.lit(1.0).alias("y"))
    sites = spark.range(10).select(F.col("id").alias("site_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = nearest.nearest_k(points, sites, 2)
    assert searched == [6] and got.count() == 6000
    assert got.filter("rank = 1 AND site_id <> point_id % 6").count() == 0
    assert nearest.nearest_k(points, sites.limit(0), 2).count() == 0


def test_points_are_not_merged_into_one_task(spark, monkeypatch):
    monkeypatch.setattr(nearest, "POINTS_PER_TASK", 100)
    points = spark.range(1000).select(F.col("id").alias("point_id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    sites = spark.range(50).select(F.col("id").alias("site_id"), (F.col("id") * 20).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = nearest._nearest(points, sites, 1, False, None)
    assert got.count() == 1000 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_frames_every_quarter_hour(spark):
    times = spark.createDataFrame([("r", i, 60.0 * i) for i in range(61)], "run string, t int, elapsed_s double")
    assert sorted(r["t"] for r in timeline.selected_frames(times, 900, ["run"]).collect()) == [0, 15, 30, 45, 60]
    tail = spark.createDataFrame([("r", i, 60.0 * i) for i in range(53)], "run string, t int, elapsed_s double")
    assert sorted(r["t"] for r in timeline.selected_frames(tail, 900, ["run"]).collect()) == [0, 15, 30, 45, 52]
    with pytest.raises(timeline.MissingFrame):
        timeline.selected_frames(times.filter("t <> 15"), 900, ["run"])


def test_official_url(spark):
    cases = {"https://www.jma.go.jp/a": True, "https://jma.go.jp:443/a": True, "http://www.jma.go.jp/a": False, "https://jma.go.jp.evil.com/": False,
             "https://user:pw@www.jma.go.jp/": False, "https://www.jma.go.jp:8443/": False, "https://notjma.go.jp/": False, "x": False}
    df = spark.createDataFrame(pd.DataFrame({"url": list(cases)}))
    got = {r["url"]: r["ok"] for r in df.select("url", official_url(F.col("url"), "jma.go.jp").alias("ok")).collect()}
    assert got == cases


def test_changed_source_is_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(path)
    recorded = spark.createDataFrame(validate.describe_source(spark, path).collect(), "file_name string, file_size long, modified timestamp")
    assert validate.source_changes(validate.describe_source(spark, path), recorded).count() == 0
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert [r["change"] for r in validate.source_changes(validate.describe_source(spark, path), recorded).collect()] == ["added"]
