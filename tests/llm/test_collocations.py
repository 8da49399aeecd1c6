import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnfield.llm import collocations, common


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top=2000):
    """Every phrase counted in a dictionary."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        rows = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            holds = [c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c >= 80 * a for c in holds):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n[lang], -score)
    return out


def rows_of(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def written(spark):
    """A hot language, words shared by languages, planted phrases that hold others, separators of all kinds."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "fr", None])
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["New", "York"], ["new", "york", "city", "hall"], ["è", "漢"], ["a"], ["the"], [f"w{rng.randint(0, 40)}"]])
        text = "".join(w + rng.choice([" "] * 12 + ["\t", ". ", ",", "\n", "\r\n", "\x0b", " ! ", "  ", " "]) for w in words)
        rows.append((i, text, lang))
    rows.append((999, None, "en"))
    return rows


def test_whole_result_against_plain_counts(spark, written):
    docs = spark.createDataFrame(written, "doc_id long, text string, lang string")
    want = plain([(r[2], r[1]) for r in written], collocations.FREQUENT)
    assert rows_of(collocations.collocations(docs)) == want
    assert {k[0] for k in want} == {"en", "fr", "und"} and len(want) > 30
    top = rows_of(collocations.collocations(docs, top=3))
    assert top == {k: v for k, v in want.items() if k[1] <= 3}


def test_shards_change_nothing(spark, written, monkeypatch):
    docs = spark.createDataFrame(written, "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "TRIE", 7)
    monkeypatch.setattr(collocations, "SLICE", 300)
    assert rows_of(collocations.collocations(docs)) == plain([(r[2], r[1]) for r in written], collocations.FREQUENT)


def test_tasks_get_rows_in_batches_of_bytes(spark, written, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    before = spark.conf.get(common.BATCH_BYTES)
    found = common.table(texts.mapInArrow(sizes, "rows long, bytes long"), "sizes", 100_000).collect()
    assert sum(r["rows"] for r in found) == 400 and max(r["bytes"] for r in found) < 150_000
    assert spark.conf.get(common.BATCH_BYTES) == before
    monkeypatch.setattr(collocations, "BATCH", 500)
    monkeypatch.setattr(collocations, "TRIE", 7)
    docs = spark.createDataFrame(written, "doc_id long, text string, lang string").coalesce(1)
    assert rows_of(collocations.collocations(docs)) == plain([(r[2], r[1]) for r in written], collocations.FREQUENT)


def test_double_array_holds_its_paths_only():
    rng = np.random.default_rng(2)
    for rows, width, depth in ((1, 4, 2), (3000, 64, 4), (5000, 2048, 2), (2048, 2048, 1)):
        paths = np.unique(rng.integers(0, width, (rows, depth)), axis=0)
        trie = collocations.DoubleArray(paths, width)

        def number(path):
            states = np.zeros(1, dtype=np.int64)
            for d in path:
                states, goes = trie.step(states, np.array([d]))
                if not goes[0]:
                    return -1
            return int(trie.accepts[states[0]])

        assert [number(p) for p in paths[:500]] == list(range(min(500, len(paths))))
        known = set(map(tuple, paths.tolist()))
        others = [p for p in map(tuple, rng.integers(0, width, (300, depth)).tolist()) if p not in known]
        assert all(number(p) == -1 for p in others)


def test_positions_advance_together():
    rng = random.Random(6)
    codes = np.array([rng.choice([-1, 5, 70_000, 9_000_000, 12]) for _ in range(5000)], dtype=np.int32)
    for k in (2, 3, 4):
        seen = sorted({tuple(codes[i : i + k].tolist()) for i in range(0, 4000, 3)} - {()})
        kept = [p for p in seen if -1 not in p and len(p) == k][::2]
        trie = collocations.PhraseTrie(3, pa.table({
            "symbols": pa.array(kept, pa.list_(pa.int32())), "id": pa.array([3 * collocations.ROOM + i for i in range(len(kept))], pa.int32()),
        }))
        at, found = trie.accepted(codes)
        want = [(i, kept.index(tuple(codes[i : i + k].tolist()))) for i in range(len(codes) - k + 1) if tuple(codes[i : i + k].tolist()) in kept]
        assert list(zip(at.tolist(), found.tolist())) == want


def test_a_position_visits_one_trie_only(spark):
    """However many tries there are, all of them together are asked for each position once."""
    rng = random.Random(9)
    group = [np.array([rng.choice([-1, *range(30)]) for _ in range(n)], dtype=np.int32) for n in (4000, 3000, 2)]
    length, shards = 3, 16
    grams = [(k, i, tuple(c[i : i + length].tolist())) for k, c in enumerate(group) for i in range(len(c) - length + 1)]
    kept = sorted({g for _, _, g in grams if -1 not in g})[::2]
    rows = spark.createDataFrame([(list(g),) for g in kept], "symbols array<int>")
    placed = rows.withColumn("shard", F.pmod(collocations.phrase_mark(F.col("symbols")), F.lit(shards)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("shard").orderBy("symbols")) - 1
    placed = placed.withColumn("id", (F.col("shard") * collocations.ROOM + nth).cast("int"))
    ids = {tuple(r["symbols"]): r["id"] for r in placed.collect()}
    asked = []

    class Counted:
        def __init__(self, trie):
            self.trie, self.first, self.count = trie, trie.first, trie.count

        def accepted(self, codes, at=None):
            asked.append(len(codes) if at is None else len(at))
            return self.trie.accepted(codes, at)

    total = {}
    tries = ((shard, Counted(trie)) for shard, trie in collocations.built(placed, shards))
    found = collocations.advanced(group, tries, shards, length, total)
    assert len(total) == shards and sum(asked) == sum(-1 not in g for _, _, g in grams)
    want = [np.full(len(c), -1, np.int32) for c in group]
    for k, i, g in grams:
        want[k][i] = ids.get(g, -1)
    assert all(np.array_equal(x, y) for x, y in zip(found, want))
    often = Counter(ids[g] for _, _, g in grams if g in ids)
    assert {first + i: n for first, some in total.items() for i, n in enumerate(some.tolist())} == often


def test_symbols_are_found_by_table_and_by_search_alike(monkeypatch):
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 900, 400) + rng.integers(0, 3, 400) * collocations.ROOM).astype(np.int32)
    rows = pa.table({"symbols": pa.array([[k, k] for k in known.tolist()], pa.list_(pa.int32())), "id": pa.array(range(len(known)), pa.int32())})
    codes = np.r_[known, rng.integers(-1, 1200, 3000), rng.integers(-1, 1 << 31, 3000), 1 + collocations.ROOM * rng.integers(0, 500, 500)].astype(np.int32)
    want = np.where(np.isin(codes, known), np.searchsorted(known, codes), -1)
    wide = collocations.PhraseTrie(0, rows)
    assert wide.spread() is not None and np.array_equal(wide.numbers(codes), want)
    monkeypatch.setattr(collocations, "WIDE", 100)
    narrow = collocations.PhraseTrie.unpacked(wide.packed().to_pylist()[0])
    assert narrow.spread() is None and np.array_equal(narrow.numbers(codes), want)


def test_words_are_told_their_shard_as_in_spark(spark):
    words = [("en", "the"), ("fr", "é"), ("und", "漢字" * 40), ("", "x")]
    want = [r[0] for r in spark.createDataFrame(words, "lang string, word string").select(F.xxhash64("lang", "word")).collect()]
    marks = collocations.word_marks([lang for lang, _ in words], [w.encode() for _, w in words])
    assert marks.view(np.int64).tolist() == want


def test_groups_and_held_counts_change_nothing(spark, written, monkeypatch):
    docs = spark.createDataFrame(written, "doc_id long, text string, lang string").coalesce(2)
    for name, value in (("TRIE", 20), ("SLICE", 300), ("GROUP", 500), ("HELD", 50), ("PAIRS", 40)):
        monkeypatch.setattr(collocations, name, value)
    assert rows_of(collocations.collocations(docs)) == plain([(r[2], r[1]) for r in written], collocations.FREQUENT)


def test_large_counts_stay_exact(spark):
    big = 3 * 10**18
    rows = [([1], big), ([2], big - 1), ([1, 2], big - 2)]
    found = spark.createDataFrame(rows, "symbols array<int>, f long").selectExpr("*", "size(symbols) AS size")
    row = collocations.scored(found).first()
    assert row["score"] == 2000000 * (big - 2) // (2 * big - 1) and (row["l"], row["r"]) == (big, big - 1)


def test_odd_rows(spark, odd, none):
    want = plain([(r["lang"], r["text"]) for r in odd.collect()], collocations.FREQUENT)
    assert rows_of(collocations.collocations(odd)) == want and want
    assert collocations.collocations(none).count() == 0
