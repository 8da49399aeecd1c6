import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnfield.functions.columns import class_index, elapsed_label, output_interval_s, resource_class, zoom_stride
from tarnfield.operators import policy, summary
from tarnfield.operators.grid import GridSpec
from tarnfield.sources import cube, raw_cube

FRAME = "t int, row int, col int, h double, u double, v double"


def small_cube(spark):
    h = {(0, 0): 0.005, (0, 1): 0.06, (1, 0): 0.2, (1, 1): 1.2}
    u0 = {(0, 1): (0.2, 0.0), (1, 1): (0.1, 0.1)}
    u1 = {(0, 1): (0.3, 0.1), (1, 1): (0.4, 0.2)}
    rows = [(0, r, c, 0.0, *u0.get((r, c), (0.0, 0.0))) for r, c in h]
    rows += [(1, r, c, d, *u1.get((r, c), (0.0, 0.0))) for (r, c), d in h.items()]
    cells = [(0, 0, 1.0, 1), (0, 1, 2.0, 1), (1, 0, 3.0, 0), (1, 1, 4.0, 1)]
    return spark.createDataFrame(rows, FRAME), spark.createDataFrame(cells, "row int, col int, elevation_m double, mask int")


def test_deepest_cell_and_inactive_point(spark):
    frames, cells = small_cube(spark)
    best = summary.cell_summary(frames, cells)
    top = summary.deepest_cell(best, GridSpec(2, 2)).first()
    assert (top["row"], top["col"], top["max_depth"]) == (1, 1, 1.2)
    points = spark.createDataFrame([(1, -0.5, 0.5), (2, 0.5, 0.5), (3, 1.0, 0.0)], "point_id int, x double, y double")
    got = {r["point_id"]: r for r in cube.inspect_points(points, best, GridSpec(2, 2)).collect()}
    assert not got[1]["has_data"] and got[1]["max_depth"] is None
    assert got[2]["has_data"] and got[2]["max_depth"] == 1.2
    assert got[3]["outside"] and got[3]["row"] is None


def summary_cube(spark):
    rows = []
    for t, peak in enumerate((0.1, 0.6, 0.4)):
        for r in range(8):
            for c in range(8):
                rows.append((t, r, c, peak if (r, c) == (3, 4) else 0.1, 0.2, 0.1))
    cells = [(r, c, 5.0, 0 if (r, c) == (0, 0) else 1) for r in range(8) for c in range(8)]
    return spark.createDataFrame(rows, FRAME), spark.createDataFrame(cells, "row int, col int, elevation_m double, mask int")


def test_summary_agrees_with_raw_frames(spark):
    frames, cells = summary_cube(spark)
    best = summary.cell_summary(frames, cells).filter("row = 3 AND col = 4").first()
    series = [r["h"] for r in cube.point_series(frames, 3, 4).collect()]
    assert series == [0.1, 0.6, 0.4]
    assert best["max_depth"] == max(series) and best["max_time"] == series.index(max(series))
    assert best["peak_speed"] == pytest.approx(np.hypot(0.2, 0.1))


def test_ties_take_the_earliest_time(spark):
    frames = spark.createDataFrame([(t, 0, 0, 0.5, 0.0, 0.0) for t in (4, 2, 3)], FRAME)
    assert frames.groupBy("row").agg(summary.first_max_time().alias("t")).first()["t"] == 2


def test_window_is_clamped_and_empty_window_is_an_error(spark):
    frames, _ = summary_cube(spark)
    grid = GridSpec(8, 8)
    assert cube.read_window(frames, grid, 1, (-5, 2), (6, 99)).count() == 4
    for bad in (((8, 9), (0, 1)), ((3, 3), (0, 1))):
        with pytest.raises(cube.EmptyWindow):
            cube.read_window(frames, grid, 1, *bad)


def test_window_filters_reach_the_scan(spark, tmp_path):
    frames, _ = summary_cube(spark)
    cube.write_cube(frames.withColumn("run_id", F.lit("a")), str(tmp_path / "c"), tile=4)
    stored = cube.read_cube(spark, str(tmp_path / "c"))
    window = cube.read_window(stored, GridSpec(8, 8), 1, (0, 3), (4, 8), tile=4).select("h")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = window._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(t" in plan
    assert "LessThan(row,3)" in plan and "LessThanOrEqual(tcol,1)" in plan
    assert "u:float" not in plan.split("ReadSchema")[1]
    assert "col:int,h" not in plan.split("ReadSchema")[1]
    assert window.count() == 12
    for rows, cols in (((0, 4), (0, 8)), ((4, 8), (3, 8)), ((2, 6), (4, 8)), ((0, 8), (0, 8))):
        got = cube.read_window(stored, GridSpec(8, 8), 1, rows, cols, tile=4).count()
        assert got == (rows[1] - rows[0]) * (cols[1] - cols[0])


def test_tile_layout_holds_the_same_cube(spark, tmp_path):
    frames, cells = summary_cube(spark)
    run = frames.withColumn("run_id", F.lit("a"))
    tables = []
    for layout in ("frame", "tile"):
        path = str(tmp_path / layout)
        cube.write_cube(run, path, tile=4, layout=layout)
        best = summary.cell_summary(cube.read_cube(spark, path), cells)
        tables.append(sorted(map(tuple, best.collect())))
    assert tables[0] == tables[1]
    assert (tmp_path / "tile" / "run_id=a" / "trow=1" / "tcol=0").is_dir()


def test_peak_speed_ignores_dry_cells(spark):
    h = [[[0, 0.2], [0.1, 0]], [[0, 0.3], [0.2, 0]]]
    u = [[[1000, 0.2], [0.1, 1000]], [[1000, 0.4], [1, 1000]]]
    rows = [(t, r, c, float(h[t][r][c]), float(u[t][r][c]), 0.0) for t in (0, 1) for r in (0, 1) for c in (0, 1)]
    frames = spark.createDataFrame(rows, FRAME)
    peaks = frames.groupBy("row", "col").agg(summary.peak_wet_speed().alias("s")).filter("s IS NOT NULL")
    assert peaks.agg(F.max("s")).first()[0] == 1.0
    histogram = summary.value_histogram(peaks, F.col("s"), F.lit(4.0))
    assert histogram.agg(F.sum("area"), F.count("value")).first()[0:2] == (8.0, 2)


def test_missing_is_never_nan(spark):
    frames = spark.createDataFrame(
        [(0, 0, 0, float("nan"), 0.0, 0.0), (1, 0, 0, -0.05, 0.0, 0.0), (2, 0, 0, float("inf"), 0.0, 0.0), (3, 0, 0, 0.4, 0.0, 0.0)],
        FRAME,
    )
    report = policy.depth_report(frames).first()
    assert (report["dry_filled"], report["negative_clipped"], report["raw_min"]) == (2, 1, -0.05)
    assert summary.max_depth(frames).first()["max_depth"] == 0.4
    assert summary.final_storage(frames).first()["volume"] == 0.4


def test_stored_maximum_wins_unless_missing(spark):
    frames = spark.createDataFrame([(0, 0, 0, 0.2, 0.0, 0.0), (0, 0, 1, 0.3, 0.0, 0.0)], FRAME)
    stored = spark.createDataFrame([(0, 0, 0.9), (0, 1, float("nan"))], "row int, col int, hmax double")
    got = {r["col"]: (r["max_depth"], r["reconstructed"]) for r in summary.max_depth(frames, stored).collect()}
    assert got == {0: (0.9, False), 1: (0.3, True)}


def test_scalar_rules(spark):
    row = spark.range(1).select(
        resource_class(F.lit(1_000_000)).alias("cls"),
        output_interval_s(F.lit(3600)).alias("short"),
        output_interval_s(F.lit(864000)).alias("long"),
        zoom_stride(F.lit(18.0)).alias("z18"),
        zoom_stride(F.lit(5.0)).alias("z5"),
        elapsed_label(F.lit("93600"), F.lit("0"), F.lit(3)).alias("numeric"),
        elapsed_label(F.lit("2024-01-01T01:30:00"), F.lit("2024-01-01T00:00:00"), F.lit(3)).alias("iso"),
        elapsed_label(F.lit("later"), F.lit("0"), F.lit(3)).alias("text"),
        class_index(F.lit(0.2), F.array(*[F.lit(v) for v in (0.0, 0.1, 0.2, 0.5)])).alias("edge"),
    ).first()
    assert row["cls"] == "medium" and (row["short"], row["long"]) == (60, 900)
    assert (row["z18"], row["z5"]) == (6, 4096)
    assert (row["numeric"], row["iso"], row["text"]) == ("1日 02:00", "01:30", "later")
    assert row["edge"] == 1


def test_raw_cube_source_prunes_chunks(spark, tmp_path):
    shape = (3, 10, 12)
    values = np.arange(np.prod(shape), dtype="<f4").reshape(shape)
    for name, factor in (("h", 1), ("u", 2), ("v", 3)):
        (values * factor).tofile(tmp_path / f"{name}.f32")
    raw_cube.register(spark)
    options = {"path": str(tmp_path), "shape": "3,10,12", "variables": "h,u,v", "chunk": "1,4,5"}
    frames = spark.read.format("raw_cube").options(**options).load()
    assert frames.count() == values.size
    got = frames.filter("t = 1 AND row >= 3 AND row < 6 AND col > 7").agg(F.sum("h"), F.sum("v"), F.count("u")).first()
    want = values[1, 3:6, 8:]
    assert got[0] == want.sum() and got[1] == want.sum() * 3 and got[2] == want.size
    reader = raw_cube.RawCubeReader({**options, "path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, LessThan

    assert list(reader.pushFilters([EqualTo(("t",), 2), LessThan(("row",), 4)])) == []
    assert len(reader.partitions()) == 3
    with pytest.raises(Exception):
        spark.read.format("raw_cube").options(**{**options, "variables": "h,u"}).load()


def test_corner_products_need_all_four(spark, grid_frame):
    z = np.array([[0.0, 2.0, 4.0], [2.0, 4.0, 6.0]])
    uncovered = np.array([[True, True, False], [True, True, True]])
    got = policy.corners_to_centres(grid_frame(z=z, uncovered=uncovered))
    rows = {(r["row"], r["col"]): (r["z"], r["uncovered"]) for r in got.collect()}
    assert rows == {(0, 0): (2.0, True), (0, 1): (4.0, False)}


def test_overview_picks_the_cell_under_each_pixel(spark):
    wide = pd.DataFrame({"row": 0, "col": np.arange(1000, dtype="int32"), "k": np.arange(1000)})
    out = summary.overview(spark.createDataFrame(wide), GridSpec(1000, 1), "k", 256).orderBy("col").collect()
    assert [r["k"] for r in out] == [int((i + 0.5) * 1000 / 256) for i in range(256)]
