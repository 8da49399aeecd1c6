import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnfield.llm import spelling


def plain_words(rows, shortest=5, rarest=3):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= rarest}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out, form = {}, {}
    near = {w: [v for v in words if v != w and one_apart(v, w)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def written(spark):
    """Few letters, so that many words are one edit apart, with counts that chain."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 8))) for _ in range(700)]
    rows = []
    for i in range(120):
        words = [vocabulary[min(int(rng.expovariate(0.006)), 699)] for _ in range(150)]
        rows.append((i if i % 9 else None, rng.choice([" ", "-", "一", "1"]).join(words).upper() if i % 2 else " ".join(words)))
    return rows


def test_whole_result_against_every_pair(spark, written):
    docs = spark.createDataFrame(written, "doc_id long, text string")
    words = plain_words(written)
    want = plain_variants(words)
    got = rows_of(spelling.variants(docs))
    assert got == want
    assert max(v[3] for v in want.values()) > 5 and any(v[1] not in (w, v[0]) for w, v in want.items())


def test_shards_and_grids_change_nothing(spark, written, monkeypatch):
    docs = spark.createDataFrame(written, "doc_id long, text string")
    want = plain_variants(plain_words(written))
    for name, value in (("SHARD", 20), ("PART", 15), ("LEAF", 2), ("BLOCK", 64), ("SAMPLE", 120)):
        monkeypatch.setattr(spelling, name, value)
    trees = spelling.top_trees(spelling.word_counts(docs))
    assert len(trees) > 2
    assert rows_of(spelling.variants(docs)) == want


def test_pairs_of_random_words():
    rng = random.Random(5)
    for length in (5, 9):
        for longer in (0, 1):
            a = sorted({"".join(rng.choice("abcdé") for _ in range(length)) for _ in range(400)})
            b = sorted({"".join(rng.choice("abcdé") for _ in range(length + longer)) for _ in range(400)})
            b = sorted(set(b) | {w[:2] + "a" * longer + "b" + w[3:] for w in a[:50]})
            pairs = {(a[i], b[j]) for i, j in spelling.near_pairs(a, b).tolist()}
            assert pairs == {(x, y) for x in a for y in b if x != y and one_apart(x, y)}
            assert len(spelling.near_pairs(a, b)) == len(pairs)  # no pair twice


def test_boxes_out_of_reach_are_pruned():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(20_000)})
    counts = spelling.letter_counts(spelling.letters(words))
    tree = spelling.Tree(counts, 20_000 / 16)
    seen = sum(len(at) for _, at in tree.visits(counts[:500], downs=True))
    assert seen < 500 * len(tree.members) / 10
    home = tree.homes(counts)
    assert all((np.sort(tree.members[k]) == np.flatnonzero(home == k)).all() for k in range(len(tree.members)))


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(spelling.variants(odd)) == plain_variants(plain_words(rows))
    assert spelling.variants(none).count() == 0
    long = "a" * 300_000
    docs = spark.createDataFrame([(i, long + "b" * (i % 2)) for i in range(1000, 1007)], "doc_id long, text string")
    assert rows_of(spelling.variants(docs)) == plain_variants(plain_words([(r[0], r[1]) for r in docs.collect()]))
