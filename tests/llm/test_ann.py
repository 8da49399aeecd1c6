import numpy as np
from pyspark.sql import functions as F

from tarnfield.llm import ann


def plain(rows, k=5):
    """All queries against all rows."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, v in good:
        if i % 50 == 0:
            a = np.array(v, dtype=np.float64)
            found = []
            for j, w in good:
                if j != i:
                    b = np.array(w, dtype=np.float64)
                    found.append((-(b * a).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())), j))
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def check(df, least, k=5):
    want = plain([(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()], k)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == {q for q, found in want.items() if found}
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in got]
    assert sum(hits) >= least * sum(len(want[q]) for q in got)
    for q, found in got.items():
        assert len(found) == len(want[q]) and found == sorted(found, key=lambda x: (-x[1], x[0]))
        known = dict(want[q])
        assert all(abs(known[j] - s) < 1e-12 for j, s in found if j in known)


def test_recall_on_the_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 0.9)


def test_clusters_and_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 40)
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.3).tolist()) for i in range(2000)]
    rows += [(i, [1.0] * 16) for i in range(2000, 3000)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, score string, `a.b` int"
    rows = [
        (0, [1.0, 0.0], "", 1), (0, [1.0, 0.0], "", 1), (1, [2.0, 0.0], "", 1), (2, [1.0, 1.0], "", 1), (50, [0.0, 1.0], "", 1),
        (3, None, "", 1), (4, [0.0, 0.0], "", 1), (5, [None, 1.0], "", 1), (6, [float("nan"), 1.0], "", 1), (100, [float("inf"), 1.0], "", 1),
        (None, [1.0, 1.0], "", 1), (150, [1.0, 1.0, 1.0], "", 1), (7, [], "", 1),
    ]
    df = spark.createDataFrame(rows, schema)
    found = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 2), (50, 2, 0), (50, 3, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
