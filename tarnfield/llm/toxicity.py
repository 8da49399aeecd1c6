"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value significance.

Fit, on at most ``FIT_ROWS`` labelled training documents (picked by a hash of the id where there are more):
a token's log-odds between toxic and clean documents, shrunk by a Dirichlet prior at the corpus's own
frequencies; tokens whose log-odds are not significant score zero, and every token pays a drift that makes
the expected score of clean text negative. One linear scan finds all maximal segments of a text. A segment
of score S in n tokens has p = 1 - exp(-n e^(-lambda S)) by the extreme-value law, lambda being the positive
root of E[e^(lambda s)] = 1 over clean tokens. The strongest and the summed -ln p of a document go through a
logistic curve fitted on the same documents.

Null and empty texts have no segment and get the curve's lowest score. Repeated label rows of an id count as
toxic if any is; rows with null labels or ids teach nothing. Without both classes all scores are the smoothed
toxic rate. Other columns of the documents stay; ``score``, ``predicted`` and ``passages`` are replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import appended, bounded, over_batches, raw, ship

ship(__name__)

FIT_ROWS = 100_000
TERMS = 65_536  # most significant tokens that are kept
PRIOR = 0.1  # weight of the prior, in shares of the corpus
Z = 3.0
DRIFT = 1.0
SIGNIFICANT = 0.01
ADDED = "score double, predicted int, passages array<struct<first:int,last:int,gain:double,p:double>>"
#: A-Z to a-z; all other ASCII but a-z to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in one pass over the runs of positive scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    breaks = np.flatnonzero(np.diff(positive) > 1)
    firsts, lasts = positive[np.r_[0, breaks + 1]], positive[np.r_[breaks, len(positive) - 1]]
    held: list[list] = []  # first, last, sum before, sum up to the end, nearest earlier entry with a lower sum before
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        low, high = total[first], total[last + 1]
        while True:
            at = len(held) - 1
            while at >= 0 and held[at][2] >= low:
                at = held[at][4]
            if at < 0 or held[at][3] >= high:
                held.append([first, last, low, high, at])
                break
            first, low = held[at][0], held[at][2]
            del held[at:]
    return [(f, e, float(h - lo)) for f, e, lo, h, _ in held]


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(root * scores)) = 1; 1 where there is none."""
    if not len(scores) or scores.max() <= 0 or (scores * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while excess(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


class Model:
    """Token scores, decay and curve; ``curve`` is None until fitted, ``rate`` is used without both classes."""

    def __init__(self, weights: dict[bytes, float], root: float, rate: float):
        self.weights, self.root, self.rate, self.curve = weights, root, rate, None

    def passages(self, text: bytes | None) -> list[tuple[int, int, float, float]]:
        words = tokens(text)
        weights = self.weights
        if not weights or weights.keys().isdisjoint(words):
            return []
        scores = np.fromiter((weights.get(w, 0.0) for w in words), dtype=np.float64, count=len(words)) - DRIFT
        return [
            (a, b, s, -math.expm1(-len(words) * math.exp(-self.root * s))) for a, b, s in segments(scores)
        ]

    def features(self, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        strength = [-math.log(max(p, 1e-300)) for *_, p in found]
        return math.log1p(max(strength, default=0.0)), math.log1p(sum(strength))

    def score(self, found: list) -> float:
        if self.curve is None:
            return self.rate
        x = self.curve[0] + float(np.dot(self.curve[1:], self.features(found)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; slopes are kept from falling below zero."""
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[b[0], np.maximum(b[1:], 0)]


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """Learn from the labelled documents for which ``training`` (on ``doc_id``) holds."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(training)
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = F.broadcast(bounded(marks, "doc_id", FIT_ROWS))  # at most FIT_ROWS rows of two numbers
    known = docs.select("doc_id", "text").join(marks, "doc_id").select("toxic", "text")

    def counting():
        def step(batch):
            seen = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                seen[toxic > 0].update({*tokens(text), b" "})  # a blank stands for the document itself
            words = list(seen[0].keys() | seen[1].keys())
            return {
                "word": pa.array(words, pa.binary()),
                "clean": pa.array([seen[0][w] for w in words], pa.int64()),
                "toxic": pa.array([seen[1][w] for w in words], pa.int64()),
            }

        return step

    counted = over_batches(known, "word binary, clean long, toxic long", counting)
    counted = counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).cache()
    size = counted.filter(F.col("word") == F.lit(b" ")).first()
    n0, n1 = (size["clean"], size["toxic"]) if size else (0, 0)
    rate = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        counted.unpersist()
        return Model({}, 1.0, rate)
    words = counted.filter(F.col("word") != F.lit(b" "))
    sums = words.agg(F.sum("clean"), F.sum("toxic")).first()
    s0, s1 = (float(s or 0) for s in sums)
    mass = PRIOR * (s0 + s1)
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y1 / (s1 + mass - y1)) - F.log(y0 / (s0 + mass - y0))
    sure = odds / F.sqrt(1 / y1 + 1 / y0)
    strong = (
        words.select("word", odds.alias("odds"), (y0 / (s0 + mass)).alias("share"), sure.alias("z"))
        .filter(F.abs("z") >= Z)
        .orderBy(F.abs("z").desc(), "word")
        .limit(TERMS)
        .collect()
    )
    counted.unpersist()
    scores = np.array([r["odds"] for r in strong] + [0.0]) - DRIFT
    shares = np.array([r["share"] for r in strong])
    shares = np.r_[shares, max(0.0, 1 - shares.sum())]
    model = Model({bytes(r["word"]): r["odds"] for r in strong}, decay(scores, shares), rate)

    def measuring():
        def step(batch):
            both = [model.features(model.passages(t)) for t in raw(batch, "text")]
            return {
                "toxic": batch.column(0),
                "a": pa.array([f[0] for f in both], pa.float64()),
                "b": pa.array([f[1] for f in both], pa.float64()),
            }

        return step

    seen = over_batches(known, "toxic int, a double, b double", measuring).toPandas()  # at most FIT_ROWS rows
    model.curve = logistic(seen[["a", "b"]].to_numpy(), (seen["toxic"] > 0).to_numpy(dtype=float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and the significant ``passages`` (token positions)."""
    kinds = pa.list_(
        pa.struct([("first", pa.int32()), ("last", pa.int32()), ("gain", pa.float64()), ("p", pa.float64())])
    )

    def start():
        def step(batch):
            found = [model.passages(t) for t in raw(batch, "text")]
            scores = [model.score(f) for f in found]
            shown = [[dict(zip(("first", "last", "gain", "p"), s)) for s in f if s[3] <= SIGNIFICANT] for f in found]
            return [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array(shown, kinds),
            ]

        return step

    return appended(docs, ADDED, start)
