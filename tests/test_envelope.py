"""The nearest fill against every pair of cells, on tiles and strips far smaller than the grid."""

import random

import numpy as np
import pytest

from tarnfield.operators import envelope


def plain(cells):
    valid = [(r, c, z) for r, c, z in cells if z is not None]
    out = {}
    for r, c, z in cells:
        if z is not None or not valid:
            out[r, c] = (z, False)
        else:
            out[r, c] = (min(valid, key=lambda v: ((v[0] - r) ** 2 + (v[1] - c) ** 2, v[0], v[1]))[2], True)
    return out


@pytest.mark.parametrize("seed,share,hole", [(1, 0.3, None), (2, 0.9, None), (3, 0.02, (3, 18, 2, 27)), (4, 0.99, None), (5, 1.0, None), (6, 0.5, (0, 21, 0, 15))])
def test_fill_equals_every_pair(spark, seed, share, hole):
    rng = random.Random(seed)
    cells = []
    for r in range(21):
        for c in range(30):
            gap = rng.random() < share or (hole and hole[0] <= r < hole[1] and hole[2] <= c < hole[3])
            if rng.random() > 0.03:  # some cells are absent altogether
                cells.append((r, c, None if gap else float(rng.randint(0, 10**6))))
    df = spark.createDataFrame(cells, "row int, col int, z double")
    for tile, strip in ((4, 3), (64, 16)):
        got = {(r["row"], r["col"]): (r["z"], r["filled"]) for r in envelope.fill_nearest(df, tile, strip).collect()}
        assert got == plain(cells)


def test_ties_go_to_the_smaller_row_then_column(spark):
    cells = [(r, c, None) for r in range(9) for c in range(9)]
    for r, c, z in ((0, 4, 1.0), (4, 0, 2.0), (4, 8, 3.0), (8, 4, 4.0)):
        cells[r * 9 + c] = (r, c, z)
    df = spark.createDataFrame(cells, "row int, col int, z double")
    got = {(r["row"], r["col"]): (r["z"], r["filled"]) for r in envelope.fill_nearest(df, 2, 1).collect()}
    assert got == plain(cells) and got[4, 4] == (1.0, True)


def test_envelope_is_linear_in_what_is_pushed():
    rng = np.random.default_rng(1)
    rows, width = 32, 400
    env = envelope.Envelope(rows, width)
    src = rng.integers(0, 50, (rows, width))
    for c in range(width):
        env.push(rng.random(rows) < 0.8, np.int64(c), src[:, c], src[:, c] ** 2, src[:, c].astype(float))
    index, any_ = env.best(0, width)
    best = np.take_along_axis(env.gap2, index, 1) + (np.arange(width) - np.take_along_axis(env.col, index, 1)) ** 2
    used, after = env.ends()
    assert any_.all() and (np.where(used, after - env.start, 1) > 0).all()
    assert (best <= np.take_along_axis(env.gap2, np.zeros_like(index), 1) + (np.arange(width) - env.col[:, :1]) ** 2).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "row int, col int, z double")
    assert envelope.fill_nearest(none).count() == 0
