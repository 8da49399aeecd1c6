import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.functions import geo
from tarnfield.operators import clipping, compare, elevation, faces, sampling, vectors
from tarnfield.operators.grid import GridSpec
from tarnfield.sources import vector_files
from tests_support import to_grid

LAYOUT = "face_id string, size int, frow int, fcol int, overlap_m2 double, mask int"


def four_faces(spark, masks=(1, 1, 1, 1)):
    rows = [(f"f{i}", 2, i // 2, i % 2, 4.0, m) for i, m in enumerate(masks)]
    return spark.createDataFrame(rows, LAYOUT)


def gate(spark, depths, volumes=None, **kwargs):
    layout, grid = four_faces(spark), GridSpec(4, 4)
    full = faces.to_source_grid(spark.createDataFrame([(f"f{i}", d) for i, d in enumerate((0.1, 0.2, 0.0, 0.3))], "face_id string, max_depth double"), layout, grid)
    cand = faces.to_source_grid(spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(depths)], "face_id string, max_depth double"), layout, grid)
    told = spark.createDataFrame([volumes], "full_volume double, candidate_volume double") if volumes else None
    return compare.accuracy_gate(full, cand, told, **kwargs).first()


def test_equal_cubes_pass_only_when_everything_is_proven(spark):
    same = (0.1, 0.2, 0.0, 0.3)
    proven = gate(spark, same, volumes=(2.4, 2.4), connectivity=True)
    assert proven["iou"] == 1 and proven["median_diff"] == 0 and proven["passed"]
    open_case = gate(spark, same)
    assert not open_case["passed"] and open_case["criteria"]["important_flow_path_connectivity"] is None
    shifted = gate(spark, (0.0, 0.2, 0.1, 0.3), volumes=(2.4, 2.4), connectivity=True)
    assert shifted["iou"] < 0.9 and not shifted["passed"]


def test_suite_needs_an_open_area_with_fewer_cells(spark):
    schema = "benchmark_class string, passed boolean, blocks long, cells long"
    good = spark.createDataFrame([("open_area", True, 10, 100), ("urban", True, 100, 100)], schema)
    assert compare.suite_verdict(good).first()["suite_passed"]
    assert not compare.suite_verdict(good.filter("benchmark_class = 'urban'")).first()["suite_passed"]


def test_face_reader_repairs(spark):
    rows = [(0, "f0", -0.05, 0.3), (0, "f1", None, None), (0, "f2", 0.0, None), (0, "f3", 0.0, None), (1, "f0", 0.2, None), (1, "f1", 0.4, None)]
    cube = faces.read_face_cube(spark.createDataFrame(rows, "t int, face_id string, h double, hmax double"), four_faces(spark, (1, 1, 3, 0)))
    got = {r["face_id"]: r for r in faces.face_maximum(cube).collect()}
    assert set(got) == {"f0", "f1"}
    assert got["f0"]["max_depth"] == 0.3 and got["f0"]["clipped"] == 1
    assert got["f1"]["max_depth"] == 0.4 and got["f1"]["reconstructed"] and got["f1"]["filled"] == 1


def test_coverage_and_conservation(spark, grid_frame):
    res = np.full((4, 5), 2, "int32")
    res[:, 4] = 1
    cells = grid_frame(resolution_m=res, mask=np.ones((4, 5), "int32"), manning_n=np.full((4, 5), 0.05), rain_weight=np.random.default_rng(0).random((4, 5)))
    fields = faces.aggregate_fields(cells)
    assert faces.rain_conserved(cells, fields)
    layout = fields.withColumn("face_id", F.concat_ws(":", "size", "frow", "fcol"))
    assert faces.coverage_violations(layout, GridSpec(5, 4), cells).count() == 0
    assert faces.coverage_violations(layout.filter("size = 1"), GridSpec(5, 4), cells).count() == 16


def test_arrow_density_does_not_follow_the_cell_size(spark):
    for step in (1.0, 2.0, 4.0):
        n = int(8 / step)
        grid = GridSpec(n, n, step, step)
        rows = [(r, c, 0.2, 0.5, 0.0) for r in range(n) for c in range(n)]
        frames = spark.createDataFrame(rows, "row int, col int, h double, u double, v double").withColumn("mask", F.lit(1))
        arrows = sampling.arrow_lines(sampling.nearest_to_bin_centre(frames, grid, 4.0, (0, n), (0, n)), grid)
        assert arrows.count() == 4 and {round(r["length_m"], 9) for r in arrows.collect()} == {3.2}


def test_windowed_arrows_equal_full_arrows(spark):
    rng = np.random.default_rng(4)
    rows = [(r, c, float(rng.random()), float(rng.normal()), float(rng.normal())) for r in range(24) for c in range(24)]
    frames = spark.createDataFrame(rows, "row int, col int, h double, u double, v double").withColumn("mask", F.lit(1))
    grid = GridSpec(24, 24)
    full = sampling.nearest_to_bin_centre(frames, grid, 4.0, (0, 24), (0, 24), 0.5)
    part = sampling.nearest_to_bin_centre(frames.filter("row >= 8 AND row < 16"), grid, 4.0, (8, 16), (0, 24), 0.5)
    keys = ["row", "col", "speed"]
    assert sorted(map(tuple, part.select(keys).collect())) == sorted(map(tuple, full.filter("brow IN (2, 3)").select(keys).collect()))


def test_geojson_feature(spark):
    frames = spark.createDataFrame(
        [(1, 1, 0.5, 1.0, 0.0, 1), (2, 2, 0.5, 9.0, 0.0, 0)], "row int, col int, h double, u double, v double, mask int"
    )  # the faster cell is not active
    grid = GridSpec(4, 4)
    lines = sampling.arrow_lines(sampling.fastest_per_block(frames, grid, 16), grid)
    feature = json.loads(sampling.geojson_features(lines, grid, 3).first()["value"])
    assert feature["geometry"]["type"] == "MultiLineString" and len(feature["geometry"]["coordinates"]) == 3
    lon, lat = feature["geometry"]["coordinates"][0][0]
    assert abs(lon - 139) < 1e-4 and abs(lat - 35) < 1e-4 and feature["properties"]["time_index"] == 3


def test_projection_against_known_radii(spark):
    """Due north and due east of the centre the projection is an arc of known curvature."""
    a, f, phi = 6378137.0, 1 / 298.257223563, math.radians(35)
    e2 = f * (2 - f)
    meridian = a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5
    normal = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    step = 0.01
    x, y = geo.to_local(F.lit(139.0), F.lit(35.0 + step), 139.0, 35.0)
    ex, ey = geo.to_local(F.lit(139.0 + step), F.lit(35.0), 139.0, 35.0)
    got = spark.range(1).select(x.alias("x"), y.alias("y"), ex.alias("ex"), ey.alias("ey")).first()
    assert got["x"] == pytest.approx(0, abs=1e-6)
    assert got["y"] == pytest.approx(meridian * math.radians(step), rel=2e-6)
    assert got["ex"] == pytest.approx(normal * math.cos(phi) * math.radians(step), rel=2e-6)
    back = geo.to_lonlat(F.lit(3000.0), F.lit(-4000.0), 139.0, 35.0)
    there = geo.to_local(*back, 139.0, 35.0)
    row = spark.range(1).select(there[0].alias("x"), there[1].alias("y")).first()
    assert math.hypot(row["x"] - 3000, row["y"] + 4000) < 1e-4


def test_priority_fill_and_counts(spark):
    rows = [(2, r, c, 10.0) for r in range(5) for c in range(9)] + [(3, r, c, 20.0) for r in range(5) for c in range(9)]
    rows += [(1, r, c, float("nan")) for r in range(5) for c in range(9)]
    merged = elevation.coalesce_providers(spark.createDataFrame(rows, "source_id int, row int, col int, z double"))
    assert {r["z"] for r in merged.collect()} == {10.0}
    assert {r["provider"]: r["cells"] for r in elevation.provider_counts(merged).collect()} == {"DEM1A": 0, "DEM5A": 45}


def test_rgb_codes(spark):
    z = [elevation.decode_rgb(*[F.lit(v) for v in rgb]) for rgb in ((0, 0, 100), (255, 255, 156), (128, 0, 0))]
    assert list(spark.range(1).select(*z).first()) == [1.0, -1.0, None]


def test_dem_text_start_and_missing(spark):
    text = "<gml:high>2 1</gml:high><gml:tupleList>\n地表面,1.5\n地表面,-9999.\n地表面,3\n</gml:tupleList><gml:startPoint>1 0</gml:startPoint>"
    got = elevation.parse_dem_text(spark.createDataFrame([("f", text)], "file_id string, text string"))
    assert sorted((r["row"], r["col"], r["z"]) for r in got.collect()) == [(0, 1, 1.5), (0, 2, None), (1, 0, 3.0)]


def test_seam_is_lifted_under_a_taper(spark):
    rows = [(0, c, 10.0 if c < 3 else 8.0, 1 if c < 3 else 2) for c in range(9)]
    cells = spark.createDataFrame(rows, "row int, col int, z double, source_id int")
    got = to_grid(elevation.blend_seams(cells, 2, 2), "z", (1, 9))[0]
    assert got[:3].tolist() == [10.0] * 3
    assert got[3] == pytest.approx(10.0) and got[4] == pytest.approx(9.0) and got[5] == pytest.approx(8.0) and got[6] == 8.0
    sloped = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, 2.0, 1), (0, 2, 0.0, 2)], "row int, col int, z double, source_id int")
    assert to_grid(elevation.blend_seams(sloped, 1, 2, extrapolate=True), "z", (1, 3))[0, 2] == pytest.approx(3.0)


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def features(spark, *rings):
    return spark.createDataFrame([(f"p{i}", r) for i, r in enumerate(rings)], f"feature_id string, ring {vectors.RING}")


def test_rasterise_inset_and_buffer(spark):
    grid = GridSpec(10, 10)
    square = features(spark, ring((-2, -2), (2, -2), (2, 2), (-2, 2), (-2, -2)))
    assert vectors.rasterise_polygons(square, grid).count() == 16
    assert vectors.rasterise_inset(square, grid, 0.5).count() == 16
    assert vectors.rasterise_inset(square, grid, 0.6).count() == 4
    tiny = features(spark, ring((0, 0), (0.8, 0), (0.8, 0.8), (0, 0.8), (0, 0)))
    assert vectors.rasterise_inset(tiny, grid, 0.5).count() == 0
    bend = vectors.buffer_lines(features(spark, ring((-3, 0.5), (0.5, 0.5), (0.5, 3))), 0.9)
    rows = {(r["row"], r["col"]) for r in vectors.rasterise_polygons(bend, grid).collect()}
    assert (5, 5) in rows and (4, 5) not in rows


def test_clipping(spark):
    box = (0.0, 0.0, 4.0, 4.0)
    diamond = features(spark, ring((0, 2), (2, 0), (6, 4), (4, 6), (0, 2)))
    clipped = clipping.clip_polygons(diamond, box)
    assert clipped.select(vectors.ring_area(F.col("ring"))).first()[0] == pytest.approx(10.0)
    path = features(spark, ring((-1, 1), (2, 1), (2, 9), (3, 9), (3, 2)))
    parts = [[(p["x"], p["y"]) for p in r["ring"]] for r in vectors.clip_lines(path, box).orderBy("part").collect()]
    assert parts == [[(0, 1), (2, 1), (2, 4)], [(3, 4), (3, 2)]]


def test_overpass_elements(spark):
    def pts(*pairs):
        return [{"lat": 35 + y / 1e4, "lon": 139 + x / 1e4} for x, y in pairs]

    square = pts((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    elements = [
        {"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": square},
        {"type": "way", "id": 2, "tags": {"highway": "residential"}, "geometry": square[:2]},
        {"type": "way", "id": 3, "tags": {"building": "yes"}, "geometry": square[:3]},
        {"type": "relation", "id": 4, "tags": {"building": "yes"}, "members": [
            {"role": "outer", "geometry": square[:3]}, {"role": "outer", "geometry": square[:1:-1][::-1]}, {"role": "inner", "geometry": square}]},
    ]
    payload = spark.createDataFrame([("a", json.dumps({"elements": elements}))], "area_id string, json string")
    got = vector_files.parse_overpass(payload, 139.0, 35.0)
    assert sorted((r["feature_id"], r["layer"]) for r in got.collect()) == [("relation/4", "building"), ("way/1", "building"), ("way/2", "road_line")]


def test_citygml_prefers_the_best_lod(spark, tmp_path):
    def poly(*pairs):
        text = " ".join(f"{35 + y / 1e4} {139 + x / 1e4} 0" for x, y in pairs)
        return f"<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{text}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"

    four, five = poly((0, 0), (1, 0), (1, 1), (0, 0)), poly((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    doc = f"""<core:CityModel><core:cityObjectMember><bldg:Building gml:id="b"><bldg:lod0RoofEdge>{four}</bldg:lod0RoofEdge>
<bldg:lod0FootPrint>{five}</bldg:lod0FootPrint></bldg:Building></core:cityObjectMember>
<bldg:Building><bldg:boundedBy><bldg:GroundSurface>{four}</bldg:GroundSurface></bldg:boundedBy></bldg:Building>
<tran:Road><gml:posList>35 139 0 35.001 139.001 0</gml:posList></tran:Road></core:CityModel>"""
    (tmp_path / "a.gml").write_text(doc)
    buildings = vector_files.citygml_buildings(vector_files.read_elements(spark, str(tmp_path), "bldg:Building"), 139.0, 35.0)
    assert sorted(len(r["ring"]) for r in buildings.collect()) == [4, 5]
    roads = vector_files.citygml_roads(vector_files.read_elements(spark, str(tmp_path), "tran:Road"), 139.0, 35.0)
    assert [(r["layer"], len(r["ring"])) for r in roads.collect()] == [("road_line", 2)]


def test_geocoder_answers(spark):
    def answer(n, system="wgs1984"):
        items = "".join(f"<candidate><address>a{i}</address><longitude>139.{i}</longitude><latitude>35.5</latitude><iLvl>7</iLvl></candidate>" for i in range(n))
        return f"<results><geodetic>{system}</geodetic><iConf>5</iConf><converted>x</converted>{items}</results>"

    rows = [(0, answer(0)), (1, answer(1)), (2, answer(12)), (3, answer(2, "tokyo"))]
    df = spark.createDataFrame(rows, "query_id int, xml string")
    counts = {r["query_id"]: r["count"] for r in vector_files.parse_geocoder(df).groupBy("query_id").count().collect()}
    assert counts == {1: 1, 2: 10}
    assert [r["query_id"] for r in vector_files.unsupported_geocoders(df).collect()] == [3]


def test_rings_of_single_positions_and_own_dimensions(spark):
    from tarnfield.sources import vector_files

    ring = [(35.0, 139.0), (35.0, 139.001), (35.001, 139.001), (35.0, 139.0)]
    single = "".join(f"<gml:pos>{a} {b} 2.5</gml:pos>" for a, b in ring)
    flat = f'<gml:posList srsDimension="2">{" ".join(f"{a} {b}" for a, b in ring)}</gml:posList>'
    solid = f'<gml:posList>{" ".join(f"{a} {b} 7" for a, b in ring)}</gml:posList>'
    polygon = "<gml:Polygon><gml:exterior><gml:LinearRing>{}</gml:LinearRing></gml:exterior></gml:Polygon>"
    rows = [("a", "".join(polygon.format(x) for x in (single, flat, solid))), ("b", f"<gml:LineString>{single}</gml:LineString>"), ("c", flat)]
    elements = spark.createDataFrame(rows, "element_id string, xml string")
    buildings = vector_files.citygml_buildings(elements.filter("element_id = 'a'"), 139.0, 35.0).collect()
    assert [r["feature_id"] for r in buildings] == ["building/a/0", "building/a/1", "building/a/2"]
    assert {len(r["ring"]) for r in buildings} == {4} and len({tuple(map(tuple, r["ring"])) for r in buildings}) == 1
    roads = vector_files.citygml_roads(elements, 139.0, 35.0).collect()
    assert sorted((r["layer"], len(r["ring"])) for r in roads) == [("road_line", 4)] * 2 + [("road_polygon", 4)] * 3


def test_element_ids_do_not_change_between_runs(spark, tmp_path):
    from tarnfield.sources import vector_files

    (tmp_path / "x.gml").write_text('<b:Building gml:id="k1"><p>1</p></b:Building>\n<b:Building><p>2</p></b:Building>')
    ids = [[r["element_id"] for r in vector_files.read_elements(spark, str(tmp_path), "b:Building").collect()] for _ in range(2)]
    assert ids[0] == ids[1] and ids[0][0] == "k1" and len(set(ids[0])) == 2


def test_projected_points_work_each_step_out_once(spark):
    """The plan of an array's projection names a sine or two per step, not one per use of an intermediate value."""
    points = spark.createDataFrame([([(139.01, 35.02), (138.99, 34.97)],)], "p array<struct<lon:double,lat:double>>")
    there = points.select(geo.project_points(F.col("p"), 139.0, 35.0).alias("xy"))
    plan = there._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("ASIN(") == 1 and plan.upper().count("ATAN(") == 1
    one = points.select(F.explode("p").alias("p")).select(*geo.to_local(F.col("p.lon"), F.col("p.lat"), 139.0, 35.0))
    assert [(q["x"], q["y"]) for q in there.first()["xy"]] == [tuple(r) for r in one.collect()]
    back = there.select(F.explode(geo.unproject_points(F.col("xy"), 139.0, 35.0)).alias("p")).select("p.*").collect()
    assert [abs(r["lon"] - lon) + abs(r["lat"] - lat) < 1e-6 for r, (lon, lat) in zip(back, points.first()["p"])] == [True, True]
