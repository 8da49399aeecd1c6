"""Near duplicates by SimHash: fingerprints partitioned by vantage-point trees, pruned by triangle bounds.

A top tree is fitted on a bounded sample of distinct fingerprints; it only shapes the shards. Every
fingerprint has one home shard and also visits each shard whose side of a vantage point's sphere lies
within the radius. Inside a shard a tree of its own is built over the home members, and home members and
visitors descend it together, so every pair within the radius meets in the home shard of one of them.
A shard returns one link per member that joins something (to the smallest of its class), never pairs.

Rows without text or words have fingerprint zero and are linked like others. Rows without ``doc_id`` get a
fingerprint and no class. Repeated rows stay rows; ties do not arise, classes are named by their smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import connected, over_batches, quoted, raw, ship, table

ship(__name__)

SAMPLE = 65_536  # fingerprints that shape the top tree
SHARDS = 32  # at least, so that small tables visit as many shards per fingerprint as large ones
SHARD = 262_144  # home fingerprints in a shard, at most, as far as the sample tells
LEAF = 256
BLOCK = 1 << 22  # cells of one distance block


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles, as an unsigned number."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(ends, ends[size:])], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long), one row per document."""

    def start():
        def step(batch):
            marks = np.array([fingerprint(t, shingle) for t in raw(batch, "text")], dtype=np.uint64)
            return {"doc_id": batch.column(0), "fp": pa.array(marks.view(np.int64))}

        return step

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", start)


def far(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def split(sample: np.ndarray, radius: int, rng: np.random.Generator):
    """A vantage point and a sphere that share out ``sample`` with little overlap, or None if none divides it."""
    few = sample if len(sample) <= 1024 else rng.choice(sample, 1024, replace=False)
    best = None
    for point in rng.choice(few, min(12, len(few)), replace=False):
        near = np.cumsum(np.bincount(far(few, point), minlength=66 + radius)) / len(few)
        for mu in range(64):
            inside = near[mu]
            if 0.2 <= inside <= 0.8:
                cost = inside * near[mu + radius] + (1 - inside) * (1 - (near[mu - radius] if mu >= radius else 0))
                if best is None or cost < best[0]:
                    best = cost, np.uint64(point), mu
    return best and best[1:]


def top_tree(sample: np.ndarray, shards: int, radius: int) -> list:
    """Nodes (point, mu, inner, outer) and leaves (shard number,), as nested lists."""
    rng, leaves = np.random.default_rng(7), [0]

    def grow(part: np.ndarray, wanted: int):
        cut = split(part, radius, rng) if wanted > 1 and len(part) >= 2 else None
        if cut is None:
            leaves[0] += 1
            return (leaves[0] - 1,)
        inside = far(part, cut[0]) <= cut[1]
        share = min(wanted - 1, max(1, round(wanted * inside.mean())))
        return (*cut, grow(part[inside], share), grow(part[~inside], wanted - share))

    return grow(sample, shards)


def route(tree, fps: np.ndarray, radius: int):
    """(shard, positions, home flags) for every shard that a fingerprint lives in or has to visit."""
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if len(node) == 1:
            yield node[0], at, home
            continue
        point, mu, inner, outer = node
        d = far(fps[at], point).astype(np.int16)
        go_in, go_out = d <= mu + radius, d > mu - radius
        stack.append((inner, at[go_in], home[go_in] & (d[go_in] <= mu)))
        stack.append((outer, at[go_out], home[go_out] & (d[go_out] > mu)))


class Classes:
    """Union-find over positions with all roots at hand as an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])]), axis=1)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for x, y in pairs.T.tolist():
            x, y = top(x), top(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        moved = self.root.copy()
        for x in parent:
            moved[x] = top(x)
        self.root = moved[self.root]


def link_shard(fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Class of every position after linking all (home member, any member) pairs within the radius.

    A leaf whose members are one class already skips the queries of that class.
    """
    classes, rng = Classes(len(fps)), np.random.default_rng(11)
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        members, queries = stack.pop()
        if not len(members) or not len(queries):
            continue
        cut = split(fps[members], radius, rng) if len(members) > LEAF else None
        if cut is not None:
            point, mu = cut
            dm, dq = far(fps[members], point), far(fps[queries], point).astype(np.int16)
            stack.append((members[dm <= mu], queries[dq <= mu + radius]))
            stack.append((members[dm > mu], queries[dq > mu - radius]))
            continue
        for m in range(0, len(members), LEAF):
            part = members[m : m + LEAF]
            for q in range(0, len(queries), BLOCK // LEAF):
                some = queries[q : q + BLOCK // LEAF]
                own = np.unique(classes.root[part])
                if len(own) == 1:
                    some = some[classes.root[some] != own[0]]
                i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[some][None, :]) <= radius)
                classes.join(part[i], some[j])
    return classes.root


def near_links(marks: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (fp, id) that connect all pairs within the radius."""
    distinct = marks.count()
    shards = max(1, min(SAMPLE // 32, distinct // LEAF, max(SHARDS, -(-distinct // SHARD))))
    share = min(1.0, 1.2 * SAMPLE / max(1, distinct))
    picked = marks.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(SAMPLE)
    sample = np.array([r[0] for r in picked.collect()], dtype=np.int64).view(np.uint64)
    tree = top_tree(np.sort(sample), shards, radius)

    def start():
        def step(batch):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = list(route(tree, fps, radius))
            at = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            return {
                "shard": pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int32)),
                "fp": batch.column(0).take(pa.array(at)),
                "id": batch.column(1).take(pa.array(at)),
                "home": pa.array(np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, dtype=bool)),
            }

        return step

    def local(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("id", kind="stable")
        ids = members["id"].to_numpy()
        root = link_shard(members["fp"].to_numpy().view(np.uint64), members["home"].to_numpy(dtype=bool), radius)
        joined = root != np.arange(len(root))
        return pd.DataFrame({"a": ids[joined], "b": ids[root[joined]]})

    sent = over_batches(marks.select("fp", "id"), "shard int, fp long, id long, home boolean", start)
    return sent.groupBy("shard").applyInPandas(local, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links)."""
    prints = table(fingerprints(docs, shingle), "prints")
    marks = table(
        prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "marks"
    )
    # One id may come with several texts; its fingerprints are one class then.
    same_id = prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    several = same_id.filter("lo <> hi").select("doc_id")
    shared = prints.join(several, "doc_id").join(marks, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    classes = connected(near_links(marks, radius).unionByName(shared))
    named = marks.join(classes, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    labelled = prints.join(named, "fp", "left")
    return labelled.select(
        "doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each class (that of the smallest id); rows without id all stay."""
    found = near_duplicates(docs, shingle, radius)
    kept = table(
        found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept"
    )
    single, repeated = kept.filter("rows = 1").select("doc_id"), kept.filter("rows > 1").select("doc_id")
    once = docs.join(single.hint("merge"), "doc_id", "left_semi")  # one plan at every size
    more = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(docs.filter("doc_id IS NULL")).select(*quoted(docs.columns))
