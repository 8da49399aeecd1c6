"""Approximate nearest neighbours by cosine: a hierarchical k-means tree with best-bin-first visits.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids, which is all that a list of ``k`` can show.
The tree is fitted on a bounded sample of entries; every entry is then put into the leaf that it descends to,
and crowded leaves are cut into chunks. A query opens the tree's bins in the order of their distance through
a priority queue and visits the nearest leaves. How many is found by calibration: for a bounded sample of
entries the true neighbours are computed against all entries, and the visits widen until ``RECALL`` of them
lie in the visited leaves. Within the visited leaves the search is exact, in double precision.

Vectors that are null, zero, hold null or non-finite components, or are not of the most frequent length take no
part, nor do rows without id. Repeated rows count once. Ties go to the smaller id; fewer candidates than ``k``
give fewer rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import bounded, over_batches, ship, table

ship(__name__)

SAMPLE = 32_768  # entries that shape the tree
LEAF = 400  # entries aimed at in a leaf
BRANCH = 12
CHUNK = 8_192  # entries of one leaf searched at once
PROBES = 256  # entries whose true neighbours calibrate the visits
RECALL = 0.97


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means centres, seeded by distance; fewer than ``k`` where rows coincide."""
    centres = rows[rng.integers(len(rows))][None]
    gap = 1 - rows @ centres[0]
    while len(centres) < k and gap.max() > 1e-12:
        pick = rng.choice(len(rows), p=np.maximum(gap, 0) / np.maximum(gap, 0).sum())
        centres = np.vstack([centres, rows[pick]])
        gap = np.minimum(gap, 1 - rows @ rows[pick])
    for _ in range(8):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres = unit(sums[full])
    return centres


class Tree:
    """Nodes as (centres, children); a leaf is its number."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.count, rng = 0, np.random.default_rng(5)

        def grow(part: np.ndarray, wanted: float):
            centres = means(part, min(BRANCH, round(wanted)), rng) if round(wanted) >= 2 and len(part) > 1 else None
            if centres is None or len(centres) < 2:
                self.count += 1
                return self.count - 1
            own = (part @ centres.T).argmax(axis=1)
            return centres, [grow(part[own == i], wanted * (own == i).mean()) for i in range(len(centres))]

        self.root = grow(rows, leaves)

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        out = np.zeros(len(rows), dtype=np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                own = (rows[at] @ node[0].T).argmax(axis=1)
                stack += [(child, at[own == i]) for i, child in enumerate(node[1])]
        return out

    def nearest(self, row: np.ndarray, visits: int) -> list[int]:
        """Leaves in best-bin-first order."""
        found, queue, ties = [], [(0.0, 0, self.root)], 0
        while queue and len(found) < visits:
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                found.append(node)
                continue
            for near, child in zip((node[0] @ row).tolist(), node[1]):
                ties += 1
                heapq.heappush(queue, (-near, ties, child))
        return found


def best(queries: np.ndarray, entries: np.ndarray, ids: list, k: int):
    """(query position, id, cosine) of the ``k`` best ids of each query: screened by one product, then computed exactly."""
    if not len(queries) or not len(entries):
        return
    lengths = np.sqrt((entries * entries).sum(axis=1))
    base = unit(entries)
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        rough = unit(block) @ base.T
        floor = np.partition(rough, len(entries) - k, axis=1)[:, len(entries) - k] if len(entries) > k else np.full(len(block), -2.0)
        for i, row in enumerate(block):
            near = np.flatnonzero(rough[i] >= floor[i] - 1e-9)
            scores = (entries[near] * row).sum(axis=1) / (lengths[near] * np.sqrt((row * row).sum()))
            ranked = sorted((-s, v) for s, e in zip(scores.tolist(), near.tolist()) for v in ids[e])
            for s, v in ranked[:k]:
                yield at + i, v, -s


def entries_of(vectors: DataFrame, keep: int) -> DataFrame:
    """``entry`` (smallest id), ``vector``, ``ids`` (the ``keep`` smallest), one row per different vector."""
    rows = vectors.count()
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.lit(max(1, rows // 20_000))))
    for keys in (["vector", "salt"], ["vector"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("nth", nth).filter(F.col("nth") <= keep)
    ids = F.sort_array(F.collect_list("vec_id"))
    return salted.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("entry"), "vector", "ids")


def valid(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` of the rows that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding")
    if embeddings.schema["embedding"].dataType.elementType.typeName() not in ("float", "double"):
        vector = vector.cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL").filter(F.forall("vector", number) & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else 0)).distinct()


def visits_needed(entries: DataFrame, tree: Tree, k: int) -> int:
    """Fewest leaves per query that hold ``RECALL`` of the true neighbours of the probes."""
    probes = bounded(entries.select("entry", "vector"), "entry", PROBES).toPandas()
    if probes.empty:
        return 1
    names, rows = probes["entry"].to_numpy(), np.stack(probes["vector"].to_numpy()).astype(np.float64)

    def start():
        def step(batch):
            near = matrix(batch.column(1))
            leaves = tree.leaf(unit(near))
            found = [(int(names[q]), int(leaves[e]), s) for q, e, s in best(rows, near, [[e] for e in range(len(near))], k + 1)]
            return {
                "probe": pa.array([f[0] for f in found], pa.int64()),
                "leaf": pa.array([f[1] for f in found], pa.int64()),
                "score": pa.array([f[2] for f in found], pa.float64()),
            }

        return step

    near = over_batches(entries.select("entry", "vector"), "probe long, leaf long, score double", start)
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "leaf"))
    truth = near.withColumn("place", place).filter(F.col("place") <= k + 1).select("probe", "leaf").toPandas()
    order = {int(n): {leaf: i for i, leaf in enumerate(tree.nearest(r, tree.count))} for n, r in zip(names, unit(rows))}
    ranks = np.sort([order[p][leaf] for p, leaf in zip(truth["probe"].tolist(), truth["leaf"].tolist())])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of each row for which ``is_query`` holds."""
    vectors = table(valid(embeddings), "vectors")
    entries = table(entries_of(vectors, k + 1), "entries")
    size = entries.count()
    picked = bounded(entries.select("entry", "vector"), "entry", SAMPLE).select("vector").toPandas()["vector"]
    sample = unit(np.stack(picked.to_numpy()).astype(np.float64)) if len(picked) else np.zeros((0, 1))
    tree = Tree(sample, max(1, min(size // LEAF, len(sample) // 16)))
    visits = visits_needed(entries, tree, k)

    def placing():
        def step(batch):
            return {
                "entry": batch.column(0),
                "vector": batch.column(1),
                "ids": batch.column(2),
                "leaf": pa.array(tree.leaf(unit(matrix(batch.column(1))))),
            }

        return step

    kind = entries.schema["vector"].dataType.simpleString()
    placed = over_batches(entries, f"entry long, vector {kind}, ids array<long>, leaf long", placing)
    placed = table(placed, "leaves")
    # One row per leaf: as many as the bounded sample allows.
    chunks = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")))
    chunked = placed.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("entry"), "chunks")).drop("chunks")

    asking = vectors.filter(is_query).join(entries.select("entry", "vector"), "vector").select("vec_id", "entry")
    asking = table(asking, "asking")

    def routing():
        def step(batch):
            rows = matrix(batch.column(1))
            found = [tree.nearest(r, visits) for r in unit(rows)]
            at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
            return {
                "query": batch.column(0).take(pa.array(at)),
                "vector": batch.column(1).take(pa.array(at)),
                "leaf": pa.array(np.concatenate([*found, np.zeros(0)]).astype(np.int64)),
            }

        return step

    different = entries.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    routed = over_batches(different, f"query long, vector {kind}, leaf long", routing)
    visiting = routed.join(chunks, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if own.empty or queries.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64"})
        rows = [np.stack(f["vector"].to_numpy()).astype(np.float64) for f in (queries, own)]
        names = queries["query"].to_numpy()
        found = [(names[q], v, s) for q, v, s in best(*rows, own["ids"].tolist(), k + 1)]
        return pd.DataFrame(found, columns=["query", "vec_id", "score"])

    pairs = chunked.groupBy("leaf", "chunk").cogroup(visiting.select("leaf", "chunk", "query", "vector").groupBy("leaf", "chunk"))
    found = pairs.applyInPandas(search, "query long, vec_id long, score double")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = table(found.withColumn("nth", F.row_number().over(by_query)).filter(F.col("nth") <= k + 1), "found")
    joined = asking.withColumnRenamed("vec_id", "query_id").join(found, F.col("entry") == F.col("query"))
    own = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = joined.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
