"""Line deduplication by overlapping windows of consecutive lines.

Every three consecutive lines of a text form a window. Windows are counted by a 128-bit hash over all
documents; of a window that occurs more than once, the first occurrence in the order of (id, text hash, line)
stays and every later one covers its lines. The union of the covered lines is removed from the text.

Texts of fewer lines than a window, empty and null texts stay as they are. Rows without id come last in the
order. Rows that agree in id and text are one document: they keep and lose the same lines. A text whose lines
are all covered becomes empty. Other columns stay; ``n_lines``, ``n_removed`` and ``removed`` are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import appended, raw, ship, table

ship(__name__)

ADDED = "text string, n_lines int, n_removed int, removed array<struct<first:int,last:int>>"


def windows(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``_mark`` (text hash), ``line`` (first line of the window) and the window's hash ``_a``, ``_b``."""
    split = docs.select("doc_id", F.xxhash64("text").alias("_mark"), F.split("text", "\n", -1).alias("_lines"))
    starts = F.sequence(F.lit(0), F.size("_lines") - size)
    exploded = split.filter(F.size("_lines") >= size).select("doc_id", "_mark", "_lines", F.explode(starts).alias("line"))
    taken = [F.get("_lines", F.col("line") + k) for k in range(size)]
    return exploded.select(
        "doc_id", "_mark", "line", F.xxhash64(*taken).alias("_a"), F.xxhash64(F.lit(1), *taken).alias("_b")
    )


def covered(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``_mark``, ``_starts``: first lines of the later windows of each document that has any."""
    found = table(windows(docs, size), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark", "line")
    first = found.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    repeated = first.filter("_first <> _last").select("_a", "_b", "_first")
    later = found.join(repeated, ["_a", "_b"]).filter(place > F.col("_first"))
    return later.groupBy("doc_id", "_mark").agg(F.collect_set("line").alias("_starts"))


def without_repeated_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with the lines of later windows removed from ``text``, and what was removed."""
    gone = table(covered(docs.select("doc_id", "text"), size), "covered")
    other = gone.toDF("_id", "_hash", "_starts").hint("merge")  # one plan at every size
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    met = docs.drop("_id", "_hash", "_starts").join(other, same, "left").drop("_id", "_hash")

    def start():
        kinds = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

        def step(batch):
            texts, counts, lost, spans = [], [], [], []
            starts = batch.column(batch.schema.get_field_index("_starts")).to_pylist()
            for text, begins in zip(raw(batch, "_text"), starts):
                lines = text.split(b"\n") if text is not None else []
                runs: list[list[int]] = []
                for at in sorted(begins or ()):
                    if runs and at <= runs[-1][1] + 1:
                        runs[-1][1] = at + size - 1
                    else:
                        runs.append([at, at + size - 1])
                kept, at = [], 0
                for first, last in runs:
                    kept += lines[at:first]
                    at = last + 1
                kept += lines[at:]
                texts.append(None if text is None else b"\n".join(kept).decode())
                counts.append(len(lines))
                lost.append(len(lines) - len(kept))
                spans.append([{"first": a, "last": b} for a, b in runs])
            return [pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(lost, pa.int32()), pa.array(spans, kinds)]

        return step

    return appended(met.withColumn("_text", F.col("text")), ADDED, start).drop("_text", "_starts")
