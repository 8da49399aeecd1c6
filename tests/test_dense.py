"""Dense tile cubes: round trips, windows, points, publication, faces, and what reads touch."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.operators.grid import GridSpec
from tarnfield.sources import dense, raw_cube
from tarnfield.sources.cube import EmptyWindow


@pytest.fixture(scope="module")
def frames(spark):
    """Two runs, three times, 19 x 23 cells, some absent, some without depth."""
    rows = [
        (run, t, r, c, None if (r * c + t) % 7 == 0 else r + c / 100 + t * 1000, float(r - c), float(t))
        for run in ("a", "b c") for t in (0, 1, 5) for r in range(19) for c in range(23) if (r + 2 * c + t) % 11
    ]
    return spark.createDataFrame(rows, "run_id string, t int, row int, col int, h double, u double, v double")


def rows_of(df):
    return sorted(df.select("run_id", "t", "row", "col", "h", "u", "v").collect(), key=repr)


GRID = GridSpec(23, 19)


@pytest.mark.parametrize("layout", ["frame", "series"])
@pytest.mark.parametrize("tile", [64, (3, 5)])
def test_round_trip(spark, frames, tmp_path, layout, tile):
    cube = dense.write_dense(frames, str(tmp_path / "c"), GRID, tile, dtype="float64", layout=layout)
    assert rows_of(cube.cells(cube.tiles())) == rows_of(frames)
    assert all(r["whole"] for r in cube.verify().collect())
    again = dense.DenseCube(spark, str(tmp_path / "c"))
    one = again.point_series(7, 9, ("h", "v")).collect()
    assert [tuple(r) for r in one] == [
        tuple(r) for r in frames.filter("row = 7 AND col = 9").orderBy("run_id", "t").select("run_id", "t", "h", "v").collect()
    ]
    for window in ((0, 19), (0, 23)), ((3, 11), (4, 5)), ((-5, 100), (20, 999)), ((4, 8), (4, 8)):
        (r0, r1), (c0, c1) = window
        want = frames.filter(f"run_id = 'a' AND t = 5 AND row >= {r0} AND row < {r1} AND col >= {c0} AND col < {c1}")
        assert rows_of(again.window(5, *window, run_id="a")) == rows_of(want)
        arrays = again.window_arrays(5, *window, run_id="a")
        assert sorted(arrays) == ["h", "u", "v"]
        r0, c0 = max(0, r0), max(0, c0)
        for r in want.collect():
            got = arrays["h"][r["row"] - r0, r["col"] - c0]
            assert got == r["h"] or (r["h"] is None and np.isnan(got))
        assert np.isfinite(arrays["u"]).sum() == want.count()


def test_totals_and_empty_windows(spark, frames, tmp_path):
    cube = dense.write_dense(frames, str(tmp_path / "c"), GRID, 8)
    got = {(r["run_id"], r["t"]): (r["cells"], r["h_n"], round(r["h_sum"], 2)) for r in cube.totals().collect()}
    want = frames.groupBy("run_id", "t").agg(F.count(F.lit(1)), F.count("h"), F.sum(F.col("h").cast("float")))
    assert got == {(r[0], r[1]): (r[2], r[3], round(r[4], 2)) for r in want.collect()}
    for bad in ((5, 5), (0, 4)), ((30, 40), (0, 4)):
        with pytest.raises(EmptyWindow):
            cube.window(0, *bad)
    with pytest.raises(EmptyWindow):
        cube.point_series(19, 0)
    assert cube.window(3, (0, 4), (0, 4)).count() == 0  # a time without a frame


def test_reads_open_what_the_window_meets(spark, frames, tmp_path):
    cube = dense.write_dense(frames, str(tmp_path / "c"), GridSpec(23, 19), (1, 1))
    files = cube.tiles(1, (0, 4), (0, 4), "a").inputFiles()
    assert len(files) == 1 < len(cube.tiles().inputFiles())
    plan = cube.tiles(1, (0, 4), (0, 4)).select("h")._jdf.queryExecution().toString()
    assert "trow" in plan.split("PushedFilters")[1] and "present" not in plan.split("ReadSchema")[1]


def test_publication(spark, frames, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    with pytest.raises(dense.BrokenCube):
        dense.DenseCube(spark, path)
    cube = dense.write_dense(frames.filter("run_id = 'a'"), path, GRID, 8, dtype="float64")
    assert rows_of(cube.cells(cube.tiles())) == rows_of(frames.filter("run_id = 'a'"))
    dense.write_dense(frames.filter("run_id = 'b c'"), path, GRID, 8, dtype="float64")
    cube = dense.DenseCube(spark, path)
    assert rows_of(cube.cells(cube.tiles())) == rows_of(frames)
    newer = frames.filter("run_id = 'a' AND t = 1").withColumn("h", F.col("h") + 1)
    dense.write_dense(newer, path, GRID, 8, dtype="float64")  # run a again, with one frame
    cube = dense.DenseCube(spark, path)
    assert rows_of(cube.cells(cube.tiles())) == rows_of(newer.unionByName(frames.filter("run_id = 'b c'")))
    assert rows_of(cube.window(1, (0, 19), (0, 23), run_id="a")) == rows_of(newer)

    def fail(*args, **more):
        raise RuntimeError("stopped before publishing")

    monkeypatch.setattr(dense, "json", type("J", (), {"dumps": fail, "loads": dense.json.loads}))
    with pytest.raises(RuntimeError):
        dense.write_dense(frames.limit(5), path, GRID, 8, dtype="float64")
    cube = dense.DenseCube(spark, path)
    assert rows_of(cube.cells(cube.tiles())) == rows_of(newer.unionByName(frames.filter("run_id = 'b c'")))


def test_bad_cells_are_refused(spark, frames, tmp_path):
    double = frames.limit(1).unionByName(frames.limit(1))
    for k, bad in enumerate((double, frames.withColumn("row", F.col("row") + 1), frames.withColumn("col", F.col("col") - 1))):
        with pytest.raises(Exception, match="outside the grid|twice|negative"):
            dense.write_dense(bad, str(tmp_path / str(k)), GRID, 4)


def test_faces(spark, frames, tmp_path):
    faces = spark.range(500).select(F.col("id").cast("int").alias("face"), (F.col("id") % 3).cast("int").alias("level"))
    series = frames.filter("run_id = 'a'").select("run_id", "t", (F.col("row") * 23 + F.col("col")).alias("face"), "h", "u", "v")
    cube = dense.write_faces(series, str(tmp_path / "f"), faces, block=64, dtype="float64")
    assert cube.document["storage_kind"] == "face" and cube.document["faces"] == 500
    key = lambda df: sorted(df.select("t", "face", "h", "u").collect(), key=repr)
    assert key(dense.face_cells(cube)) == key(series)
    assert key(dense.face_cells(cube, 5, (100, 131))) == key(series.filter("t = 5 AND face >= 100 AND face < 131"))
    assert spark.read.parquet(f"{tmp_path}/f/faces/{cube.document['face_table']}").count() == 500


def test_raw_cube_is_written_and_read_back(spark, frames, tmp_path):
    path = str(tmp_path / "r")
    one = frames.filter("run_id = 'a'").drop("run_id").withColumns({c: F.col(c).cast("float").cast("double") for c in ("h", "u", "v")})
    raw_cube.write_raw(one, path, GRID, 6, tile=8)
    found = spark.read.format("raw_cube").options(path=path, variables="h,u,v").load()
    key = lambda df: sorted(df.select("t", "row", "col", "h", "u", "v").collect(), key=repr)
    assert key(found) == key(one)
    window = "t = 5 AND row >= 3 AND row < 9 AND col <= 20"
    assert key(found.filter(window)) == key(one.filter(window))
    high = found.filter("h > 5010")  # only chunks of time 5 can hold it
    assert key(high) == key(one.filter("h > 5010"))
    reader = raw_cube.RawCubeReader({"path": path, "variables": "h"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    everything = len(reader.partitions())
    rest = list(reader.pushFilters([GreaterThan(("h",), 5010.0), EqualTo(("row",), 12)]))
    assert len(rest) == 1 and 0 < len(reader.partitions()) < everything / 3
    with pytest.raises(Exception, match="already"):
        raw_cube.write_raw(one, path, GRID, 6, tile=8)
    raw_cube.write_raw(one.filter("t = 0"), path, GRID, 6, tile=8, mode="overwrite")
    assert key(spark.read.format("raw_cube").options(path=path, variables="h,u,v").load()) == key(one.filter("t = 0"))
    with pytest.raises(Exception, match="both u and v"):
        spark.read.format("raw_cube").options(path=path, variables="h,u").load()


def test_many_raw_chunks_take_few_tasks(spark, tmp_path):
    path, grid = str(tmp_path / "m"), GridSpec(16, 400)
    cells = spark.range(16 * 400).select((F.col("id") % 400).cast("int").alias("row"), F.floor(F.col("id") / 400).cast("int").alias("col"))
    one = cells.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("t")))
    one = one.withColumns({"h": (F.col("row") * 16 + F.col("col")).cast("double"), "u": F.lit(0.5), "v": F.lit(None).cast("double")})
    raw_cube.write_raw(one, path, grid, 4, tile=4)
    reader = raw_cube.RawCubeReader({"path": path, "variables": "h,u,v"})
    parts = reader.partitions()
    assert sum(len(p.whole) for p in parts) == 4 * 4 * 100 and len(parts) <= raw_cube.LEAST_PARTS
    assert pickle.loads(pickle.dumps(reader)).listed is None
    found = spark.read.format("raw_cube").options(path=path, variables="h,u,v").load()
    got = found.filter("row >= 7").agg(F.count("*"), F.sum("h"), F.sum("u"), F.count("v")).first()
    want = one.filter("row >= 7").agg(F.count("*"), F.sum("h"), F.sum("u"), F.count("v")).first()
    assert tuple(got) == tuple(want)
    assert found.filter("row > 5000").count() == 0  # a window without chunks


def test_a_failed_raw_write_leaves_nothing(spark, frames, tmp_path):
    path = tmp_path / "r"
    raw_cube.register(spark)
    bad = frames.filter("run_id = 'a'").withColumn("h", F.when(F.col("t") == 5, F.raise_error(F.lit("stopped"))).otherwise(F.col("h")))
    with pytest.raises(Exception, match="stopped"):
        raw_cube.write_raw(bad.drop("run_id"), str(path), GRID, 6, tile=8)
    assert not (path / raw_cube.INDEX).exists()
    writer = raw_cube.RawCubeWriter({"path": str(path), "variables": "h", "shape": "6,19,23", "tile": "8,8"}, False)
    message = writer.write(iter([]))
    writer.abort([message])
    assert not list(path.glob("_pending-*")) if path.exists() else True
