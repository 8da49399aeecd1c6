"""Language of text spans: script ranges narrow the candidates, Viterbi with a switching penalty labels the words.

Fit, over all training documents: counts of letters per (language, script) and of hashed character n-grams
(1 to 4 letters, words padded by a blank) per (language, bucket). The counts have a fixed number of buckets
per language, whatever the size of the corpus. A word's score in a language is the mean smoothed log
probability of its n-grams times its length, limited to languages that use the word's script; where no
language does, all stay. The best path pays ``PENALTY`` for every change of language. A document's language
is the one whose spans hold most letters (ties: the first in name order); its score is their share.

Null texts and texts without a letter are ``und`` with score 0. Without training rows all texts are ``und``.
Rows with null or empty ``lang`` teach nothing. Other columns stay; ``lang_pred``, ``score`` and ``spans`` are
replaced.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import appended, over_batches, raw, ship, slices

ship(__name__)

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
SMOOTH = 0.5
USES = 0.001  # share of a language's letters that makes a script its own
ADDED = "lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"
#: First code point of each run of code blocks and its script (0: none).
SCRIPTS = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 2),
    (0x00B6, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1),
    (0x02C2, 0), (0x0300, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7),
    (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0E00, 11), (0x0E80, 12), (0x10A0, 13), (0x1100, 14),
    (0x1200, 15), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 0), (0x3040, 16), (0x30A0, 17),
    (0x3100, 0), (0x3400, 18), (0xA000, 0), (0xAC00, 14), (0xD7B0, 0), (0xF900, 18), (0xFB00, 1),
    (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0),
    (0xFF41, 1), (0xFF5B, 0), (0xFF66, 17), (0xFFA0, 14), (0xFFE0, 0), (0x20000, 18), (0x30000, 0),
)
OTHER = 19  # letters outside the runs above
N_SCRIPTS = 20


def script_table() -> np.ndarray:
    """Script of every code point; 0 for what is neither a letter nor a mark of a script."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for (at, script), (end, _) in zip(SCRIPTS, [*SCRIPTS[1:], (0x110000, 0)]):
        table[at:end] = script
    letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    for point in np.flatnonzero((table > 0) & ~letter).tolist():
        if unicodedata.category(chr(point))[0] != "M":
            table[point] = 0
    table[letter & (table == 0)] = OTHER
    return table


def words_of(texts: list[bytes | None], script: np.ndarray):
    """Letters of all texts as one array of lower-case code points with a blank (0) around every word.

    Gives (points, script of each, start of each word, end of each word, words before each text).
    """
    joined = "\n".join((t or b"").decode("utf-8", "replace").lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    kind = script[points]
    breaks = np.flatnonzero(points == 10)
    edges = np.diff(np.r_[0, (kind > 0).astype(np.int8), 0])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.r_[0, np.searchsorted(starts, breaks), len(starts)] if texts else np.zeros(1, dtype=np.int64)
    return np.where(kind > 0, points, 0), kind, starts, ends, bounds


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each order: (bucket of the n-gram that begins at each point, whether it lies within a padded word)."""
    padded = np.r_[0, points, np.zeros(max(ORDERS), dtype=np.int64)].astype(np.uint64)
    size = ends - starts + 2
    owner = np.repeat(np.arange(len(starts)), size)
    closing = (ends + 1)[owner]  # padded position of the blank after the word
    at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + starts[owner]
    for order in ORDERS:
        fits = at + order <= closing + 1
        if order == 1:
            fits &= padded[at] > 0
        place = at[fits]
        mixed = np.full(len(place), order, dtype=np.uint64)
        for k in range(order):
            mixed = (mixed ^ padded[place + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        yield (mixed >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), owner[fits]


class Model:
    """Languages, their scripts (bool, language x script) and n-gram log probabilities (bucket x language)."""

    def __init__(self, names: list[str], uses: np.ndarray, logs: np.ndarray):
        self.names, self.uses, self.logs = names, uses, logs

    def emissions(self, points, kind, starts, ends) -> np.ndarray:
        total = np.zeros((len(starts), len(self.names)))
        count = np.zeros(len(starts))
        for bucket, owner in grams(points, starts, ends):
            for k in range(len(self.names)):
                total[:, k] += np.bincount(owner, self.logs[bucket, k], minlength=len(starts))
            count += np.bincount(owner, minlength=len(starts))
        scores = total / np.maximum(count, 1)[:, None] * (ends - starts)[:, None]
        allowed = self.uses[:, kind[starts]].T
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, scores, -1e6)


def best_paths(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi for many texts at once: text i owns rows bounds[i] .. bounds[i + 1]; step t advances all that have one."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="left")
    from_where = np.zeros(scores.shape, dtype=np.int16)
    n, langs = len(sizes), np.arange(scores.shape[1], dtype=np.int16)
    state = np.zeros((n, scores.shape[1]))
    for t, live in enumerate(alive.tolist()):
        rows = first[:live] + t
        held = state[:live]
        if t:
            top = held.argmax(axis=1)
            moved = held[np.arange(live), top] - penalty
            stay = held >= moved[:, None]
            from_where[rows] = np.where(stay, langs, top[:, None])
            held = np.where(stay, held, moved[:, None])
        state[:live] = held + scores[rows]
    path = np.zeros(len(scores), dtype=np.int16)
    now = state.argmax(axis=1).astype(np.int16)
    for t in range(len(alive) - 1, -1, -1):
        rows = first[: alive[t]] + t
        path[rows] = now[: alive[t]]
        now[: alive[t]] = from_where[rows, now[: alive[t]]]
    return path


def fit(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs`` (``text``, ``lang``) that have both."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''").select("text", F.col("lang").cast("string"))

    def counting():
        script = script_table()

        def step(batch):
            texts, langs = raw(batch, "text"), batch.column(1).to_pylist()
            out = {"lang": [], "bucket": [], "n": []}
            for lang in dict.fromkeys(langs):
                own = [t for t, of in zip(texts, langs) if of == lang]
                counts, used = np.zeros(BUCKETS, dtype=np.int64), np.zeros(N_SCRIPTS, dtype=np.int64)
                for part in slices(own):
                    points, kind, starts, ends, _ = words_of(own[part], script)
                    for bucket, _ in grams(points, starts, ends):
                        counts += np.bincount(bucket, minlength=BUCKETS)
                    used += np.bincount(kind, minlength=N_SCRIPTS)
                seen, used = np.flatnonzero(counts), used[1:]
                out["bucket"] += [seen, -np.arange(1, N_SCRIPTS)]  # scripts are counted below zero
                out["n"] += [counts[seen], used]
                out["lang"] += [lang] * (len(seen) + len(used))
            return {
                "lang": pa.array(out["lang"], pa.string()),
                "bucket": pa.array(np.concatenate(out["bucket"] or [np.zeros(0)]).astype(np.int32)),
                "n": pa.array(np.concatenate(out["n"] or [np.zeros(0)]).astype(np.int64)),
            }

        return step

    counted = over_batches(known, "lang string, bucket int, n long", counting)
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets x languages at most
    names = sorted(counted["lang"].unique())
    logs = np.zeros((BUCKETS, len(names)), dtype=np.float32)
    uses = np.zeros((len(names), N_SCRIPTS), dtype=bool)
    for k, name in enumerate(names):
        own = counted[counted["lang"] == name]
        bucket, n = own["bucket"].to_numpy(), own["n"].to_numpy(dtype=np.float64)
        dense = np.zeros(BUCKETS)
        dense[bucket[bucket >= 0]] = n[bucket >= 0]
        logs[:, k] = np.log((dense + SMOOTH) / (dense.sum() + SMOOTH * BUCKETS))
        letters = np.zeros(N_SCRIPTS)
        letters[-bucket[bucket < 0]] = n[bucket < 0]
        uses[k] = letters > USES * max(letters.sum(), 1)
    return Model(names, uses, logs)


def labelled(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (runs of words in one language)."""
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def start():
        script = script_table()
        names = [*model.names, "und"]

        def some(texts):
            points, kind, starts, ends, bounds = words_of(texts, script)
            n, size = len(texts), max(1, len(model.names))
            text_of = np.repeat(np.arange(n), np.diff(bounds))
            path = np.zeros(len(starts), dtype=np.int64)
            if model.names:
                path = best_paths(model.emissions(points, kind, starts, ends), bounds, penalty).astype(np.int64)
            share = np.bincount(text_of * size + path, ends - starts, minlength=n * size).reshape(n, size)
            letters, top = share.sum(axis=1), share.argmax(axis=1)
            known = (letters > 0) & bool(model.names)
            score = np.where(known, share[np.arange(n), top] / np.maximum(letters, 1), 0.0)
            new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])]) if len(path) else path
            length = np.diff(np.r_[new, len(path)])
            runs = pa.StructArray.from_arrays(
                [
                    pa.array((new - bounds[text_of[new]]).astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    pa.array(names).take(pa.array(path[new] if model.names else np.zeros(len(new), dtype=np.int64))),
                ],
                fields=list(kinds.value_type),
            )
            offsets = np.searchsorted(new, bounds).astype(np.int32)
            return (
                pa.array(names).take(pa.array(np.where(known, top, len(names) - 1))),
                pa.array(score),
                pa.ListArray.from_arrays(pa.array(offsets), runs).cast(kinds),
            )

        def step(batch):
            texts = raw(batch, "text")
            parts = [some(texts[part]) for part in slices(texts)]
            return [pa.chunked_array([p[k] for p in parts]).combine_chunks() for k in range(3)]

        return step

    return appended(docs, ADDED, start)
