import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfield.llm import mixing, sharding


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "x" * (i % 7), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = sharding.interleaved(docs, 40).select("source", "shard", "slot").collect()
    total, sizes = Counter(r[2] for r in rows), Counter(r["shard"] for r in placed)
    assert set(sizes.values()) == {75}
    per = Counter((r["source"], r["shard"]) for r in placed)
    for source, n in total.items():
        for shard in range(40):
            assert abs(per[source, shard] - n / 40) <= 2 + len(total) * n / 3000  # a cut moves by a row per source
    for shard in range(40):
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(75))


def test_odd_rows_are_sharded(odd, none):
    placed = sharding.interleaved(odd, 5)
    rows = placed.collect()
    assert placed.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == 12 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sorted(str(r["text"]) for r in rows) == sorted(str(r["text"]) for r in odd.collect())
    assert sharding.interleaved(none, 5).count() == 0


def hashed(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson(u, mean):
    k, below = 0, math.exp(-mean)
    while below <= u:
        k += 1
        below += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
    return k


@pytest.mark.parametrize("weights", [None, {"a": 0.7, "b": 0.3}, {"b": 1.0}])
def test_copies_follow_the_inverted_law(odd, none, weights):
    rows = odd.collect()
    n = Counter(r["source"] for r in rows)
    share = {s: (math.sqrt(c) if weights is None else weights.get(s, 0)) for s, c in n.items()}
    want = Counter()
    for r in rows:
        rate = share[r["source"]] / sum(share.values()) * len(rows) * 6 / n[r["source"]]
        parts = max(1, math.ceil(rate / 16))
        name = "" if r["doc_id"] is None else r["doc_id"]
        copies = sum(poisson(hashed(f"{name}/{p}/poisson17"), rate / parts) for p in range(1, parts + 1)) if rate else 0
        for c in range(1, copies + 1):
            want[r["doc_id"], r["text"], copies, c] += 1
    mixed = mixing.poisson_mix(odd, weights, size=6.0)
    got = mixed.collect()
    assert Counter((r["doc_id"], r["text"], r["copies"], r["copy"]) for r in got) == want
    places = [hashed(f"{'' if r['doc_id'] is None else r['doc_id']}/{r['copy']}/order17") for r in sorted(got, key=lambda r: r["position"])]
    assert places == sorted(places)
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert mixing.poisson_mix(none, weights).count() == 0


def test_target_weights_are_met(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source")
    )
    counts = {r[0]: r[1] for r in mixing.poisson_mix(docs, {"hot": 0.9, "cold": 0.1}, size=4.0).groupBy("source").count().collect()}
    assert abs(counts["hot"] - 21600) < 5 * math.sqrt(21600)  # a rate of 10.8
    assert abs(counts["cold"] - 2400) < 5 * math.sqrt(2400)
