"""Fingerprints, the vantage-point search and the classes against plain versions."""

import random

import numpy as np
import xxhash

from tarnfield.llm import simhash


def plain_print(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, radius=3):
    """(id, print) rows to id -> smallest id reachable, by comparing all pairs."""
    prints = {}
    for i, p in rows:
        prints.setdefault(i, set()).add(p)
    ids = sorted(prints)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any((a ^ b).bit_count() <= radius for a in prints[x] for b in prints[y]):
                a, b = sorted((top(x), top(y)))
                up[b] = a
    return {i: top(i) for i in ids}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    prints = [(i, plain_print(t)) for i, t in rows]
    want = plain_classes([(i, p) for i, p in prints if i is not None])
    got = simhash.near_duplicates(df).collect()
    expected = sorted((str(i), f"{p:016x}", str(want.get(i))) for i, p in prints)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == expected


def test_documents_match_all_pairs(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_class_stays(odd, docs, none):
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7, 8]  # 2, 3 and 4 have no words and are one class
    assert ids.count(None) == 2
    found = {r[0]: r[2] for r in simhash.near_duplicates(docs).collect()}
    left = [r[0] for r in simhash.without_near_duplicates(docs).select("doc_id").collect()]
    assert sorted(left) == sorted(set(found.values()))
    assert simhash.without_near_duplicates(none).count() == 0


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 40)]
    marks = set()
    while len(marks) < n:
        value = rng.choice(centres) if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            value ^= 1 << rng.randrange(64)
        marks.add(value)
    dense = rng.getrandbits(64)  # a group that holds a third of all
    while len(marks) < n * 3 // 2:
        value = dense
        for _ in range(rng.randrange(9)):
            value ^= 1 << rng.randrange(20)
        marks.add(value)
    return np.array(sorted(marks), dtype=np.uint64)


def test_shards_lose_no_link():
    fps = clustered(3000, 1)
    tree = simhash.top_tree(np.random.default_rng(0).choice(fps, 1000, replace=False), 16, 3)
    classes = simhash.Classes(len(fps))
    homes, sent = np.zeros(len(fps), dtype=int), 0
    for _, at, home in simhash.route(tree, fps, 3):
        sent += len(at)
        np.add.at(homes, at[home], 1)
        classes.join(at, at[simhash.link_shard(fps[at], home, 3)])
    assert (homes == 1).all()
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
    plain = simhash.Classes(len(fps))
    plain.join(near[:, 0], near[:, 1])
    assert (classes.root == plain.root).all()
    assert len(np.unique(plain.root)) < len(fps)
    assert sent < 16 * len(fps)


def test_links_through_spark(spark):
    fps = clustered(2000, 2)
    rows = [(int(f), i) for i, f in enumerate(fps.view(np.int64))]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, id long")).collect()
    found, plain = simhash.Classes(len(fps)), simhash.Classes(len(fps))
    found.join(np.array([r[0] for r in links]), np.array([r[1] for r in links]))
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
    plain.join(near[:, 0], near[:, 1])
    assert (found.root == plain.root).all()
