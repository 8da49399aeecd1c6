import itertools
import zlib

import numpy as np

from tarnfield.llm import langid
from tarnfield.llm.common import remainder
from pyspark.sql import functions as F


def test_viterbi_matches_every_path():
    rng = np.random.default_rng(3)
    sizes = [0, 5, 1, 3, 5]
    bounds = np.r_[0, np.cumsum(sizes)]
    scores = rng.normal(size=(sum(sizes), 3)) * 2
    path = langid.best_paths(scores, bounds, 1.5)
    for a, b in zip(bounds, bounds[1:]):
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        if a < b:
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert np.isclose(value(path[a:b].tolist()), value(best))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = remainder(F.col("doc_id"), 3)
    model = langid.fit(docs.filter(rest != 1))
    rows = langid.labelled(docs.filter(rest == 1), model).select("doc_id", "lang", "lang_pred", "score").collect()
    assert all(zlib.crc32(str(r[0]).encode()) % 3 == 1 and 0 <= r[3] <= 1 for r in rows)
    assert sum(r[1] == r[2] for r in rows) / len(rows) > 0.97


def test_mixed_text_has_spans_and_scripts_narrow(spark):
    train = [("the cat and the dog are in the house with a mouse " * 5, "en"), ("le chat et le chien sont dans la maison " * 5, "fr"),
             ("кот и собака живут в доме с мышью " * 5, "ru")]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    texts = ["the dog and the cat are in the house le chien et le chat sont dans la maison", "кот в доме", "中文 文字"]
    rows = langid.labelled(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [s["lang"] for s in rows[0]["spans"]] == ["en", "fr"]
    assert rows[1]["lang_pred"] == "ru" and rows[1]["score"] == 1.0
    assert rows[2]["lang_pred"] in ("en", "fr", "ru")


def test_odd_rows(odd, none):
    model = langid.fit(odd)
    assert model.names == ["en", "fr"]
    found = langid.labelled(odd, model)
    by_text = {r["text"]: r["lang_pred"] for r in found.collect()}
    assert by_text[None] == by_text[""] == by_text["12345 67890 !!!"] == "und"
    assert found.count() == odd.count()
    assert {r["lang_pred"] for r in langid.labelled(odd, langid.fit(none)).collect()} == {"und"}
    assert langid.labelled(none, model).count() == 0
