"""Rings cut to a rectangle: several rings for concave ones, areas and points against plain counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.operators import clipping

BOX = (0.0, 0.0, 10.0, 10.0)


def closed(points):
    return np.array([*points, points[0]], dtype=float)


def area(rings):
    return sum(abs(clipping.signed_area(r[:-1])) for r in rings)


@pytest.mark.parametrize(
    "points,sizes",
    [
        ([(-5, 1), (5, 1), (5, 3), (-2, 3), (-2, 5), (5, 5), (5, 7), (-5, 7)], [10.0, 10.0]),  # a C open to the inside
        ([(2, -3), (4, -3), (4, 2), (6, 2), (6, -3), (8, -3), (8, 4), (2, 4)], [20.0]),  # a bridge: one ring is left
        ([(2, 12), (2, -2), (4, -2), (4, 6), (6, 6), (6, -2), (8, -2), (8, 12)], [2 * 10 + 2 * 10 + 2 * 4.0]),
        ([(-4, -4), (14, -4), (14, 14), (-4, 14)], [100.0]),
        ([(3, 3), (5, 3), (4, 5)], [2.0]),
        ([(20, 20), (30, 20), (25, 30)], []),
        ([(-5, -5), (15, -5), (15, -1), (-5, -1)], []),
        ([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)], [75.0]),  # on the border
        ([(-2, 2), (0, 4), (-2, 6)], []),  # touches in one point
        ([(-1, 1), (3, 1), (-1, 2), (3, 3), (-1, 4), (3, 5), (-1, 6)], None),  # a saw
    ],
)
def test_shapes(points, sizes):
    for ring in (closed(points), closed(points[::-1]), closed(points[2:] + points[:2])):
        rings = clipping.cut_ring(ring, BOX)
        if sizes is not None:
            assert sorted(abs(clipping.signed_area(r[:-1])) for r in rings) == pytest.approx(sorted(sizes))
        else:
            assert len(rings) == 3
        for r in rings:
            assert (r[0] == r[-1]).all() and r.min() >= 0 and r.max() <= 10


def in_ring(x, y, ring):
    a, b = ring[:-1], ring[1:]
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (hit & (x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))).sum() % 2 == 1


def star(rng, n):
    """A simple ring that goes in and out of the box many times."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(1, 12, n)
    return closed(list(zip(5 + far * np.cos(angle), 5 + far * np.sin(angle))))


def test_random_rings_keep_their_inside():
    rng = np.random.default_rng(4)
    several = 0
    for _ in range(150):
        ring = star(rng, int(rng.integers(5, 60)))
        ring += rng.choice([0.0, 7.5], 2)
        rings = clipping.cut_ring(ring, BOX)
        several += len(rings) > 1
        for x, y in rng.uniform(0, 10, (60, 2)):
            assert in_ring(x, y, ring) == (sum(in_ring(x, y, r) for r in rings) == 1)
    assert several > 30


def test_rows_of_features(spark):
    shapes = {"c": [(-5, 1), (5, 1), (5, 3), (-2, 3), (-2, 5), (5, 5), (5, 7), (-5, 7)], "in": [(1, 1), (2, 1), (2, 2)], "out": [(50, 1), (60, 1), (60, 2)]}
    rows = [(k, "building", [(float(x), float(y)) for x, y in [*p, p[0]]], 7) for k, p in shapes.items()]
    rows += [("none", "building", None, 7), ("line", "road_line", [(-5.0, 5.0), (5.0, 5.0), (5.0, 50.0)], 7)]
    df = spark.createDataFrame(rows, "feature_id string, layer string, ring array<struct<x:double,y:double>>, other int")
    got = clipping.clip_features(df, BOX).orderBy("feature_id", "piece").collect()
    assert [(r["feature_id"], r["piece"], r["other"]) for r in got] == [("c", 0, 7), ("c", 1, 7), ("in", 0, 7), ("line", 0, 7)]
    assert [(p["x"], p["y"]) for p in got[3]["ring"]] == [(0.0, 5.0), (5.0, 5.0), (5.0, 10.0)]
    assert clipping.clip_polygons(df.limit(0), BOX).count() == 0
    assert clipping.area_box(100, 60) == (-70, -50, 70, 50)
    many = df.filter("feature_id = 'c'").crossJoin(spark.range(500)).withColumn("ring", F.col("ring"))
    assert clipping.clip_polygons(many, BOX).count() == 1000


def test_a_ring_that_only_touches_the_line_falls_apart_there():
    arms = [(-2, 1), (8, 1), (8, 3), (0, 3), (0, 5), (8, 5), (8, 7), (-2, 7)]  # the back between the arms ends on the line
    for ring in (closed(arms), closed(arms[::-1]), closed(arms[3:] + arms[:3])):
        assert sorted(area([r]) for r in clipping.cut_ring(ring, BOX)) == pytest.approx([16.0, 16.0])


def test_the_thinnest_strips_stay_when_asked_for(spark):
    width = np.nextafter(10.0, 0)
    strip = [(float(x), float(y)) for x, y in closed([(width, 2), (18, 2), (18, 6), (width, 6)])]
    df = spark.createDataFrame([("s", strip)], "feature_id string, ring array<struct<x:double,y:double>>")
    assert clipping.clip_polygons(df, BOX).count() == 0  # a sliver
    got = clipping.clip_polygons(df, BOX, least_area=0.0).first()["ring"]
    assert {p["x"] for p in got} == {width, 10.0} and {p["y"] for p in got} == {2.0, 6.0}


def test_long_rings_take_linear_steps():
    rng = random.Random(1)
    n = 100_000
    teeth = [(i / n * 30 - 10, -1.0 if i % 2 else rng.uniform(1, 9)) for i in range(n)]
    ring = closed([*teeth, (25, 20), (-15, 20)])
    rings = clipping.cut_ring(ring, BOX)
    assert len(rings) >= 1 and area(rings) < 100
