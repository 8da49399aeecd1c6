import numpy as np
import pandas as pd
import pytest

from tarnfield.operators import classes, ordered
from pyspark.sql import functions as F


def histogram(spark, values, areas=None):
    areas = np.ones(len(values)) if areas is None else areas
    return spark.createDataFrame(pd.DataFrame({"value": np.asarray(values, float), "area": np.asarray(areas, float)}))


@pytest.mark.parametrize("outlier", [10.17, 100.0])
def test_outlier_gives_a_compressed_tail(spark, outlier):
    scale = classes.class_breaks(histogram(spark, np.append(np.linspace(0.01, 1, 10000), outlier)))
    assert (scale.mode, scale.class_count) == ("hybrid", 7)
    assert (scale.core_class_count, scale.tail_class_count) == (5, 2)
    assert scale.breaks[5] <= 1.1 and scale.breaks[-1] == outlier


def test_equal_area_edges_only_tell_of_a_tail(spark):
    values = np.append(np.linspace(0.01, 1, 10000), 10.17)
    scale = classes.equal_area_breaks(histogram(spark, values))
    assert (scale.mode, scale.class_count, len(scale.breaks)) == ("hybrid", 7, 8)
    assert scale.breaks[-2] < 1 and scale.breaks[-1] == 10.17 and all(np.histogram(values, scale.breaks)[0] > 700)
    heavy = classes.equal_area_breaks(histogram(spark, [1.0, 2.0, 3.0], [1, 20, 1]))
    assert (heavy.mode, len(heavy.breaks)) == ("repaired", 8)
    assert classes.equal_area_breaks(histogram(spark, [0.0])).mode == "empty"


def test_even_values_give_quantiles(spark):
    values = np.linspace(0.001, 1, 10000)
    scale = classes.class_breaks(histogram(spark, values))
    assert scale.mode == "quantile" and len(scale.breaks) == 8
    assert all(np.histogram(values, scale.breaks)[0] > 800)


def test_dry_cells_do_not_count(spark):
    wet = np.linspace(0.02, 1, 1000)
    a = classes.class_breaks(histogram(spark, wet), zero_epsilon=0.01)
    b = classes.class_breaks(histogram(spark, np.concatenate([wet, np.zeros(9000), [0.01]])), zero_epsilon=0.01)
    assert a.breaks == b.breaks and b.active_area == 1000


def test_subdivision_does_not_matter(spark):
    values, areas = np.append(np.arange(1.0, 21), 100), np.append(np.full(20, 10.0), 0.01)
    whole = classes.class_breaks(histogram(spark, values, areas))
    split = classes.class_breaks(histogram(spark, np.repeat(values, 10), np.repeat(areas / 10, 10)))
    assert whole.breaks == split.breaks


@pytest.mark.parametrize("offset", [-100.0, 0.0, 100.0])
def test_terrain_datum_does_not_matter(spark, offset):
    values = np.append(np.linspace(10, 11, 2000), 100) + offset
    scale = classes.class_breaks(histogram(spark, values), anchor_zero=False)
    assert scale.mode == "hybrid"
    assert (scale.breaks[0], scale.breaks[-1]) == (values.min(), values.max())


def test_constant_and_empty_fields(spark):
    scale = classes.class_breaks(histogram(spark, [-2.0, -2.0]), anchor_zero=False)
    assert scale.breaks == [-2.0] and scale.class_count == 1
    assert classes.class_breaks(histogram(spark, [0.0])).mode == "empty"


def test_critical_threshold_is_an_edge(spark):
    scale = classes.class_breaks(histogram(spark, np.linspace(0.001, 1, 10000)), critical=(0.287,))
    assert 0.287 in scale.breaks and scale.critical_used == [0.287]


def test_few_levels_are_repaired(spark):
    scale = classes.class_breaks(histogram(spark, [1, 1, 1, 1, 1, 1, 2, 3, 4], np.ones(9)))
    assert len(scale.breaks) == 5 and scale.breaks[-1] == 4


def test_labels_never_understate(spark):
    labels = classes.boundary_labels([0.0, 0.5, 1.23456])
    assert float(labels[-1]) >= 1.23456
    assert len(set(classes.boundary_labels([0.0, 100.0, 100.001]))) == 3


def test_sliced_running_total_and_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 100)
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(1, 3000), 3)
    df = spark.createDataFrame(pd.DataFrame({"value": values}))
    counts = df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = ordered.running_total(counts, "value", "n", "upto").orderBy("value").toPandas()
    assert (total["upto"].to_numpy() == total["n"].cumsum().to_numpy()).all()
    got = ordered.exact_quantiles(df, "value", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
    assert np.allclose(list(got), np.quantile(values, [0.5, 0.95, 0.0, 1.0]))


def test_row_numbers_and_lag_over_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 50)
    pdf = pd.DataFrame({"k": [1] * 400 + [2] * 20, "seq": list(range(400)) + list(range(20))})
    pdf["x"] = pdf["seq"] * 3 % 17
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=3))
    got = ordered.previous_in_key(df, ["k"], "seq", ["x"], F.floor(F.col("seq") / 7)).toPandas().sort_values(["k", "seq"])
    want = pdf.sort_values(["k", "seq"]).groupby("k")["x"].shift(1)
    assert got["prev_x"].fillna(-1).tolist() == want.fillna(-1).tolist()
    ahead = ordered.next_in_key(df, ["k"], "seq", ["x"], F.floor(F.col("seq") / 7)).toPandas().sort_values(["k", "seq"])
    assert ahead["next_x"].fillna(-1).tolist() == pdf.groupby("k")["x"].shift(-1).fillna(-1).tolist()
    numbered = ordered.global_row_number(df, [F.col("seq"), F.col("k")], "seq", "n").toPandas()
    assert sorted(numbered["n"]) == list(range(1, 421))
    ranked = numbered.sort_values("n")
    assert ranked[["seq", "k"]].values.tolist() == sorted(pdf[["seq", "k"]].values.tolist())


@pytest.mark.parametrize("values", [
    np.random.default_rng(2).exponential(1, 5000),
    np.r_[np.random.default_rng(3).random(3000) * 1e-9, 1e12, -1e12],  # all but two in one part of the range
    np.r_[np.zeros(4000), 1.0, 2.0],
    np.array([5.0]),
    np.array([1.0, 2.0]),
])
def test_quantiles_by_digits(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"value": values}))
    ps = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0, "e": 0.3333}
    got = ordered.exact_quantiles(df, "value", ps).first()
    assert np.allclose(list(got), np.quantile(values, list(ps.values())), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "value double")
    assert ordered.exact_quantiles(none, "value", {"a": 0.5}).first()["a"] is None


def test_wanted_values_take_one_edge_each():
    edges, rule = np.array([0.0, 1.0, 2.0, 4.0]), classes.Rule()
    assert classes.assigned(edges, (1.05, 1.1), rule) == {1: 1.05}
    assert classes.assigned(edges, (1.95, 1.05, 9.0, float("nan")), rule) == {1: 1.05, 2: 1.95}
    assert classes.assigned(edges, (1.5,), rule) == {}
    assert classes.readable(np.array([0.0, 0.2871, 0.6, 1.0]), {1: 0.2871}, rule)[1] == 0.2871
