"""Sharding by proportional stratified interleaving.

Rows are put into a seeded random order within their source; the row of rank r out of n gets the fraction
(r + 1/2) / n. The global order of the fractions mixes the sources in proportion everywhere, so cutting it
into equal runs gives shards whose counts differ by at most one and that each hold a source to within one
row per cut of its share.

A null source is a source of its own. Rows without id, empty texts and repeated rows are placed like any
other; rows that agree in id, text and source are interchangeable. An empty table gives an empty result.
Columns that come with the documents stay, but for earlier ``shard`` and ``slot`` columns, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import numbered, quoted, table
from tarnfield.runtime import broadcast_if_small

KEYS = ("_id", "_crc", "_size", "_source")


def unit(text: Column) -> Column:
    """52 bits of the text's md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a narrow key; equal keys are told apart by ``_nth``, in any order, as they are alike."""
    wide = docs.withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
            "_crc": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)),
            "_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16,
            "_source": F.col("source").cast("string"),
        }
    )
    alike = Window.partitionBy("_id").orderBy("_crc", "_size", "_source")
    return wide.withColumn("_nth", F.row_number().over(alike))


def assign(keys: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard`` and ``slot`` for rows (_id, _crc, _size, _source, _nth)."""
    rows = keys.count()
    draw = unit(F.concat_ws("/", F.col("_id").cast("string"), F.col("_nth").cast("string"), F.lit(f"shard{seed}")))
    drawn = table(keys.withColumn("_draw", draw), "drawn")
    ranked = numbered(drawn, F.col("_draw"), [F.col("_id"), F.col("_nth")], "_rank", rows, ["_source"])
    totals = broadcast_if_small(
        drawn.groupBy(F.col("_source").alias("_of")).agg(F.count(F.lit(1)).alias("_total"))
    )
    placed = ranked.join(totals, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_fraction", (F.col("_rank") + 0.5) / F.col("_total")
    )
    narrow = table(placed.select(*KEYS, "_nth", "_fraction"), "fractions")
    order = [F.col("_source").asc_nulls_first(), F.col("_id"), F.col("_nth")]
    in_order = numbered(narrow, F.col("_fraction"), order, "_at", rows)
    n = max(rows, 1)
    shard = F.expr(f"(_at * {shards}) div {n}")
    first = F.expr(f"((_at * {shards}) div {n} * {n} + {shards - 1}) div {shards}")
    return in_order.select(
        "_id", "_nth", shard.cast("int").alias("shard"), (F.col("_at") - first).cast("long").alias("slot")
    )


def interleaved(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in the shard).

    The places are worked out on the narrow keys; the texts are exchanged once, by id, to meet them.
    """
    wide = keyed(docs.drop("shard", "slot"))
    places = assign(wide.select(*KEYS, "_nth"), shards, seed)
    by_id = places.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_nth", "shard", "slot"))).alias("_places"))
    met = wide.join(by_id, "_id").withColumn("_place", F.element_at("_places", F.col("_nth")))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return met.select(*quoted(kept), F.col("_place.shard").alias("shard"), F.col("_place.slot").alias("slot"))
