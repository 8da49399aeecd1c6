import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators import blocks, components
from tarnfield.operators.grid import GridSpec
from tests_support import to_grid


def scene(grid_frame, shape=(64, 64), **extra):
    base = {
        "elevation_m": np.zeros(shape),
        "building": np.zeros(shape, bool),
        "road": np.zeros(shape, bool),
        "native": np.zeros(shape, bool),
        "mask": np.ones(shape, "int32"),
        "zone": np.zeros(shape, "int32"),
    }
    base.update(extra)
    return grid_frame(**base)


def classify(cells, grid, **kwargs):
    options = {"core_m": 0.0, "mid_m": 0.0, **kwargs}
    tile = options.get("tile", config.TILE)
    return blocks.balance(blocks.coarsen(blocks.ceilings(cells, grid, **options), tile=tile), tile=tile)


def test_flat_scene_becomes_eight_metre_blocks(spark, grid_frame):
    cells = classify(scene(grid_frame), GridSpec(64, 64))
    assert {r["resolution_m"]: r["blocks"] for r in blocks.level_counts(cells).collect()} == {8: 64}
    assert blocks.reduction(cells).first()["ratio"] == 1 / 64


def test_plane_has_no_evidence():
    y, x = np.mgrid[0:8, 0:8]
    m = blocks.plane_metrics((2 * x + 0.5 * y + 4)[None].astype(float))
    for name in ("rmse", "max_abs_residual", "curvature", "relief"):
        assert m[name][0] == pytest.approx(0, abs=1e-9)
    assert not m["connectivity"][0]


def test_steep_uniform_slope_coarsens(spark, grid_frame):
    y, x = np.mgrid[0:32, 0:32]
    cells = classify(scene(grid_frame, (32, 32), elevation_m=x * 1.0 + y * 2.0), GridSpec(32, 32))
    assert [r["resolution_m"] for r in cells.select("resolution_m").distinct().collect()] == [8]


def test_depression_keeps_fine_cells_with_a_buffer(spark, grid_frame):
    z = np.zeros((32, 32))
    z[16, 16] = -0.4
    got = to_grid(classify(scene(grid_frame, (32, 32), elevation_m=z), GridSpec(32, 32)), "resolution_m", (32, 32))
    assert got[16, 16] == 1 and (got[13:20, 13:20] <= 2).all() and (got[9:24, 9:24] <= 4).all()
    assert got[0, 0] == 8


def test_fixed_boundary_gains_a_transition_band(spark, grid_frame):
    res = np.full((32, 32), 8, "int32")
    res[:, :8] = 1
    cells = scene(grid_frame, (32, 32), resolution_m=res, ceiling_m=res).withColumn("reason", F.lit("x"))
    got = to_grid(blocks.balance(cells), "resolution_m", (32, 32))
    assert (got[:, 8:12] == 2).all() and (got[:, 12:16] == 4).all() and (got[:, 16:] == 8).all()


def test_zone_boundary_is_not_crossed(spark, grid_frame):
    zone = np.zeros((16, 16), "int32")
    zone[:, 3:] = 1
    cells = classify(scene(grid_frame, (16, 16), zone=zone), GridSpec(16, 16))
    assert blocks.map_violations(cells).agg(F.sum("cells")).first()[0] == 0
    assert to_grid(cells, "resolution_m", (16, 16))[0, 2] == 1


def test_building_interior_coarsens_but_not_its_edge(spark, grid_frame):
    building = np.zeros((32, 32), bool)
    building[8:24, 8:24] = True
    rough = np.random.default_rng(0).normal(0, 1, (32, 32)) * building
    rough[8, :] = rough[23, :] = 0
    cells = scene(grid_frame, (32, 32), building=building, mask=np.where(building, 0, 1).astype("int32"))
    got = to_grid(classify(cells, GridSpec(32, 32)), "resolution_m", (32, 32))
    assert (got[8, 8:24] == 1).all() and (got[8:24, 23] == 1).all() and got[15, 15] == 4


def sweep(res):
    """Sequential reference for the 2:1 rule."""
    res, changed = res.copy(), True
    while changed:
        changed = False
        for r in range(res.shape[0]):
            for c in range(res.shape[1]):
                s = res[r, c]
                near = [res[a, b] for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= a < res.shape[0] and 0 <= b < res.shape[1]]
                if s > 1 and s > 2 * min(near):
                    top, left = r - r % s, c - c % s
                    res[top : top + s, left : left + s] = s // 2
                    changed = True
    return res


@pytest.mark.parametrize("seed", range(3))
def test_tiled_balance_equals_sequential_sweep(spark, grid_frame, seed):
    rng = np.random.default_rng(seed)
    res = np.ones((96, 64), "int32")
    for size, share in ((2, 0.9), (4, 0.9), (8, 0.95)):
        for r in range(0, 96, size):
            for c in range(0, 64, size):
                if (res[r : r + size, c : c + size] == size // 2).all() and rng.random() < share:
                    res[r : r + size, c : c + size] = size
    cells = scene(grid_frame, res.shape, resolution_m=res, ceiling_m=res).withColumn("reason", F.lit("x"))
    got = to_grid(blocks.balance(cells, tile=32), "resolution_m", res.shape)
    assert (got == sweep(res)).all()


def test_small_tiles_give_the_same_map(spark, grid_frame):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 0.01, (64, 64)).cumsum(axis=0).cumsum(axis=1) / 10
    building = np.zeros((64, 64), bool)
    building[20:40, 10:30] = True
    cells = scene(grid_frame, elevation_m=z, building=building, mask=np.where(building, 0, 1).astype("int32"))
    whole = to_grid(classify(cells, GridSpec(64, 64)), "resolution_m", (64, 64))
    tiled = to_grid(classify(cells, GridSpec(64, 64), tile=32), "resolution_m", (64, 64))
    assert (whole == tiled).all()


def flood_labels(mask):
    labels, width = np.full(mask.shape, -1), mask.shape[1]
    for r, c in zip(*np.nonzero(mask)):
        if labels[r, c] < 0:
            stack, labels[r, c] = [(r, c)], r * width + c
            while stack:
                a, b = stack.pop()
                for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for j in range(max(0, b - 1), min(width, b + 2)):
                        if mask[i, j] and labels[i, j] < 0:
                            labels[i, j] = r * width + c
                            stack.append((i, j))
    return labels


@pytest.mark.parametrize("density", [0.3, 0.45, 0.6])
def test_components_across_tiles(spark, grid_frame, density):
    mask = np.random.default_rng(int(density * 100)).random((60, 47)) < density
    mask[30, :] = True
    cells = grid_frame(m=mask).filter("m")
    got = to_grid(components.components(cells, GridSpec(47, 60), tile=8), "label", mask.shape, -1)
    assert (got == flood_labels(mask)).all()


def test_snake_component(spark, grid_frame):
    mask = np.zeros((33, 33), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    got = to_grid(components.components(grid_frame(m=mask).filter("m"), GridSpec(33, 33), tile=8), "label", mask.shape, -1)
    assert set(np.unique(got[mask])) == {0}


def roofs(grid_frame, building):
    return grid_frame(building=building, active=np.ones(building.shape, bool))


def test_single_roof_feeds_its_ring(spark, grid_frame):
    building = np.zeros((7, 7), bool)
    building[3, 3] = True
    weights = components.allocate_roof_rain(roofs(grid_frame, building), GridSpec(7, 7))
    got = to_grid(weights, "rain_weight", (7, 7))
    assert got[3, 3] == 0 and (got > 1).sum() == 8 and got.sum() == pytest.approx(49, abs=1e-9)
    assert components.mass_balance(weights).first()["conserved"]


def test_roof_without_ground_is_an_error(spark, grid_frame):
    with pytest.raises(components.NoGroundRecipient):
        components.allocate_roof_rain(roofs(grid_frame, np.ones((3, 3), bool)), GridSpec(3, 3))


def test_roof_rain_reaches_further_rings(spark, grid_frame):
    building = np.zeros((11, 11), bool)
    building[5, 5] = True
    active = np.ones((11, 11), bool)
    active[4:7, 4:7] = False
    cells = grid_frame(building=building, active=active | building)
    got = to_grid(components.allocate_roof_rain(cells, GridSpec(11, 11)), "rain_weight", (11, 11))
    assert got[3, 3] == pytest.approx(1 + 1 / 16) and got[5, 5] == 0


def test_perimeter_rule_conserves_rain(spark, grid_frame):
    building = np.zeros((9, 9), bool)
    building[3:6, 3:5] = True
    got = to_grid(components.perimeter_roof_rain(roofs(grid_frame, building), GridSpec(9, 9)), "rain_weight", (9, 9))
    assert got.sum() == pytest.approx(81)


def test_nearest_fill_is_exact(spark, grid_frame):
    rng = np.random.default_rng(2)
    z = rng.random((20, 25))
    z[rng.random(z.shape) < 0.7] = np.nan
    z[:, 11] = np.nan
    cells = grid_frame(z=z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = to_grid(components.fill_nearest(cells), "z", z.shape)
    known = [(r, c) for r, c in zip(*np.nonzero(~np.isnan(z)))]
    for r, c in zip(*np.nonzero(np.isnan(z))):
        best = min(known, key=lambda k: ((k[0] - r) ** 2 + (k[1] - c) ** 2, k[0], k[1]))
        assert got[r, c] == z[best]


def test_coast_and_interior_gaps(spark, grid_frame):
    z = np.full((3, 5), 2.0)
    z[:, 0] = np.nan
    cells = grid_frame(z=z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    gaps = components.coastal_gaps(cells, GridSpec(5, 3))
    report = components.gap_report(cells, gaps).first()
    assert (report["coastal"], report["interior"], report["covered"]) == (3, 0, True)
    assert components.fill_elevation(cells, GridSpec(5, 3)).filter("filled AND z = 2.0").count() == 3
    z[:], z[1, 2] = 2.0, np.nan
    holed = grid_frame(z=z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    with pytest.raises(components.InteriorGap):
        components.fill_elevation(holed, GridSpec(5, 3))


def test_policy_contradictions_are_refused():
    good = (config.LEVELS_M, config.BLOCK_LIMITS, 100.0, 250.0, 2)
    blocks.check_policy(*good)
    for bad in (([1, 2, 8], *good[1:]), (good[0], {}, *good[2:]), (*good[:2], 300.0, 250.0, 2), (*good[:4], 16)):
        with pytest.raises(blocks.InvalidPolicy):
            blocks.check_policy(*bad)


def test_pointers_are_found_in_parts_that_do_not_grow(spark, monkeypatch):
    """Cells out of one file are dealt to several tasks before their messages are sorted; the pointers stay."""
    cells = spark.range(0, 100 * 30, 1, 1).selectExpr(
        "CAST(id DIV 30 AS INT) AS row", "CAST(id % 30 AS INT) AS col", "CAST(pmod(xxhash64(id), 50) AS DOUBLE) AS elevation_m"
    )
    whole = sorted(map(tuple, components.downstream(cells).collect()), key=str)
    monkeypatch.setattr(components, "SIDE", 8)
    monkeypatch.setattr(components, "PART", 300)
    found = components.downstream(cells)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect()), key=str) == whole and len(whole) == 3000
