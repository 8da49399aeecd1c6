"""The stages, each held against a plain version of what it must keep."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from test_similar import plain_classes

from tarnfield.llm import toxicity
from tarnfield.llm.common import remainder

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark, docs):
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    now = docs
    seen = {}
    for name, stage in stages.items():
        now = stage(spark, now, FOLDER)
        now = spark.createDataFrame(now.collect(), now.schema)
        seen[name] = now
        if name != "sharding":
            assert now.schema.names == docs.schema.names
    ids = {k: {r["doc_id"] for r in v.collect()} for k, v in seen.items()}
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    toxic = {r["doc_id"] for r in toxicity.scored(docs, model).filter("predicted = 1").collect()}
    assert ids["toxicity"] == set(rows) - toxic
    classes, _ = plain_classes([(r["doc_id"], r["text"]) for r in seen["toxicity"].collect()])
    assert ids["near_dedup"] == set(classes.values())
    plain = lambda t: " ".join(t.lower().split())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids["decontamination"] == {i for i in ids["near_dedup"] if not any(x in plain(rows[i]["text"]) for x in items)}
    assert ids["mixing"] <= ids["decontamination"] and ids["sharding"] == ids["mixing"]
    placed = seen["sharding"].collect()
    assert len(placed) == seen["mixing"].count()
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in placed)
    sizes = [sum(r["shard"] == s for r in placed) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert zlib.crc32(b"1") % 5 == model_remainder(spark)


def model_remainder(spark):
    return spark.range(1).select(remainder(F.lit(1), 5)).first()[0]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 50


def test_stages_take_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            out = stage(spark, df, FOLDER)
            out.count()
            assert out.columns == df.columns + (["shard", "slot"] if name == "sharding" else [])
