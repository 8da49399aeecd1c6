import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tarnfield.llm import toxicity
from tarnfield.llm.common import remainder


def plain_segments(scores):
    """Take the best segment (shortest, then first), then do the same on either side of it."""
    out = []

    def solve(a, b):
        total = np.concatenate([[0.0], np.cumsum(scores[a:b])])
        best = max(((total[j] - total[i], i - j, -i) for i, j in itertools.combinations(range(b - a + 1), 2)), default=(0, 0, 0))
        if best[0] > 0:
            first = a - best[2]
            last = first - best[1]
            solve(a, first)
            out.append((first, last - 1, best[0]))
            solve(last, b)

    solve(0, len(scores))
    return out


def test_segments_match_repeated_search():
    rng = random.Random(4)
    for _ in range(300):
        scores = np.array([rng.choice([-3, -1, -2, 1, 2, 5]) for _ in range(rng.randrange(25))], dtype=float)
        assert toxicity.segments(scores) == plain_segments(scores)


def test_decay_solves_its_equation():
    scores, shares = np.array([4.0, -1.0]), np.array([0.01, 0.99])
    root = toxicity.decay(scores, shares)
    assert abs((shares * np.exp(root * scores)).sum() - 1) < 1e-9 and root > 0.5


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rest = remainder(F.col("doc_id"), 5)
    model = toxicity.fit(docs, labels, rest != 0)
    rows = toxicity.scored(docs.filter(rest == 0), model).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    hits = sum(r[0] and r[1] for r in rows)
    assert hits / sum(r[0] for r in rows) > 0.85
    assert sum(r[1] and not r[0] for r in rows) / sum(1 - r[0] for r in rows) < 0.01
    assert all(0 <= r[2] <= 1 and r[1] == (r[2] >= 0.5) for r in rows)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (1, None), (6, 0), (8, 0), (None, 1), (2, 0), (7, 1), (7, 0)], "doc_id long, toxic int"
    )
    for model in (
        toxicity.fit(odd, labels, F.lit(True)),
        toxicity.fit(odd, labels.limit(0), F.lit(True)),
        toxicity.fit(none, labels, F.lit(True)),
    ):
        found = toxicity.scored(odd, model)
        rows = found.collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert [c for c in odd.columns if c != "score"] == found.columns[:10]
        assert toxicity.scored(none, model).count() == 0
