"""Elevation from several providers: tile decode, priority fill, resampling, seam blending."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.functions.columns import finite
from tarnfield.operators.grid import ring_offsets
from tarnfield.operators.tiles import Dense, shift, tile_map

NO_DATA_CODE = 2**23
MISSING_GML = 9000.0


def decode_rgb(r: Column, g: Column, b: Column) -> Column:
    """24-bit signed centimetres; the middle code means no data."""
    code = F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")
    signed = F.when(code > NO_DATA_CODE, code - 2**24).otherwise(code)
    return F.when(code != NO_DATA_CODE, signed * 0.01)


def parse_dem_text(files: DataFrame) -> DataFrame:
    """DEM text (file_id, text) to cells; rows run from north to south, as in the file.

    The tuple list may start part-way into the grid (``startPoint``) and may end early; cells
    without a tuple are absent, values from 9000 m up are missing.
    """
    number = r"\s*(\d+)\s+(\d+)\s*"
    head = files.select(
        "file_id",
        F.regexp_extract("text", f"<gml:high>{number}</gml:high>", 1).try_cast("int").alias("_hx"),
        F.regexp_extract("text", f"<gml:high>{number}</gml:high>", 2).try_cast("int").alias("_hy"),
        F.coalesce(F.regexp_extract("text", f"<gml:startPoint>{number}</gml:startPoint>", 1).try_cast("int"), F.lit(0)).alias("_sx"),
        F.coalesce(F.regexp_extract("text", f"<gml:startPoint>{number}</gml:startPoint>", 2).try_cast("int"), F.lit(0)).alias("_sy"),
        F.trim(F.regexp_extract("text", r"(?s)<gml:tupleList>\s*(.*?)\s*</gml:tupleList>", 1)).alias("_tuples"),
    )
    nx = F.col("_hx") + 1
    lines = head.select(
        "file_id", nx.alias("nx"), (F.col("_hy") + 1).alias("ny"), (F.col("_sy") * nx + F.col("_sx")).alias("start"),
        F.posexplode(F.split("_tuples", r"\r?\n")).alias("pos", "line"),
    )
    at = F.col("pos") + F.col("start")
    value = finite(F.substring_index("line", ",", -1).try_cast("double"))
    return lines.filter(at < F.col("nx") * F.col("ny")).select(
        "file_id",
        F.floor(at / F.col("nx")).cast("int").alias("row"),
        (at % F.col("nx")).cast("int").alias("col"),
        F.when(F.abs(value) < MISSING_GML, value).alias("z"),
    )


def coalesce_providers(offers: DataFrame) -> DataFrame:
    """Best offer per cell: the lowest source id with a finite elevation.

    One aggregate whatever the number of providers; map tasks keep one offer per cell.
    """
    z = finite("z")
    usable = F.when(z.isNotNull(), F.col("source_id"))
    return offers.groupBy("row", "col").agg(
        F.min(F.when(usable.isNotNull(), F.struct(usable.alias("s"), z.alias("z")))).alias("b")
    ).select("row", "col", F.col("b.s").alias("source_id"), F.col("b.z").alias("z"))


def fill_holes(*sources: DataFrame) -> DataFrame:
    """Overlay: the first source wins, each further one only fills the holes left so far."""
    offers = [s.select("row", "col", "z", F.lit(i).alias("source_id")) for i, s in enumerate(sources, start=1)]
    return coalesce_providers(reduce(DataFrame.unionByName, offers))


def provider_counts(merged: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Cells taken per provider.

    Providers after the one that completed the grid were never consulted and give no row; a
    consulted provider without a cell counts 0.
    """
    names = names or config.DEM_PROVIDERS
    per = [F.count_if(F.col("source_id") == i).alias(f"c{i}") for i in range(1, len(names) + 1)]
    one = merged.agg(F.count_if(F.col("z").isNull()).alias("holes"), F.max("source_id").alias("last"), *per)
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("source_id"), F.lit(n).alias("provider"), F.col(f"c{i}").alias("cells"))
                for i, n in enumerate(names, start=1)
            ]
        )
    )
    return (
        one.select("holes", "last", rows)
        .filter((F.col("holes") > 0) | (F.col("source_id") <= F.col("last")))
        .select("source_id", "provider", "cells")
    )


def bilinear(targets: DataFrame, source: DataFrame) -> DataFrame:
    """Value at fractional source positions from the four cells around them.

    ``targets`` has (target_id, r, c) with cell centres at whole numbers. A missing or absent
    corner makes the sample missing; corners of zero weight are not asked for.
    """
    r0, c0 = F.floor("r").cast("int"), F.floor("c").cast("int")
    fr, fc = F.col("r") - F.floor("r"), F.col("c") - F.floor("c")
    corners = F.array(
        *[
            F.struct(
                (r0 + dr).alias("row"),
                (c0 + dc).alias("col"),
                ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("w"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
    )
    asked = targets.select("target_id", F.explode(F.filter(corners, lambda s: s["w"] > 0)).alias("s")).select(
        "target_id", "s.*"
    )
    got = asked.join(source.select("row", "col", "z"), ["row", "col"], "left")
    return got.groupBy("target_id").agg(
        F.when(F.count("z") == F.count(F.lit(1)), F.sum(F.col("z") * F.col("w"))).alias("z")
    )


def _blended(z: np.ndarray, source: np.ndarray, width: int, sources: int, extrapolate: bool) -> np.ndarray:
    """Heights after each source, in order, was lifted towards the higher-priority ones at its seam."""
    reach = [(dr, dc) for dr in range(-width, width + 1) for dc in range(-width, width + 1) if dr * dr + dc * dc <= width * width]
    reach.sort(key=lambda s: (s[0] * s[0] + s[1] * s[1], s))  # nearest first, ties by row and column
    for sid in range(2, sources + 1):
        mine = source == sid
        total, count = np.zeros(z.shape), np.zeros(z.shape)
        for dr, dc in ring_offsets(False, centre=False):
            z1, s1 = shift(z, dr, dc, np.nan), shift(source, dr, dc, 0)
            if extrapolate:
                z2, s2 = shift(z, 2 * dr, 2 * dc, np.nan), shift(source, 2 * dr, 2 * dc, 0)
                z1 = np.where(s2 == s1, 2 * z1 - z2, z1)
            gap = np.where((s1 > 0) & (s1 < sid), z1 - z, np.nan)
            there = ~np.isnan(gap)
            total[there] += gap[there]
            count += there
        seam = mine & (count > 0)
        fix = np.where(seam, total / np.maximum(count, 1), np.nan)
        lift, open_ = np.zeros(z.shape), mine.copy()
        for dr, dc in reach:
            near = shift(fix, dr, dc, np.nan)
            hit = open_ & ~np.isnan(near)
            lift[hit] = 0.5 * (1 + np.cos(np.pi * np.sqrt(float(dr * dr + dc * dc)) / width)) * near[hit]
            open_ &= ~hit
        z = z + lift
    return z


def blend_seams(
    cells: DataFrame, width: int, sources: int, extrapolate: bool = True, tile: int = config.TILE
) -> DataFrame:
    """Lift lower-priority terrain towards its higher-priority neighbours near their seam.

    Sources are handled in priority order, since each blended source is the reference of the
    next. A seam cell's correction is the mean over its higher-priority 4-neighbours; cells
    within ``width`` take the nearest seam cell's correction (row, then col on ties) under a
    cosine taper. ``extrapolate`` continues the neighbour's slope where it is two cells deep, as is the rule.

    One pass over tiles: a source looks ``width`` and two cells further, so a halo of that times the sources to
    come holds all that can reach a tile.
    """
    state = cells.select("row", "col", F.col("z").cast("double").alias("z"), "source_id")
    if width <= 0 or sources < 2:
        return state
    halo = (sources - 1) * (width + 2)

    def kernel(d: Dense) -> pd.DataFrame:
        raw = d.get("source_id", np.nan)
        source = np.where(np.isnan(raw), 0, raw).astype(np.int64)
        z = _blended(d.get("z", np.nan), source, width, sources, extrapolate)
        out = d.rows(z=z, source_id=raw)
        return out.astype({"source_id": "Int32"})

    given = state.withColumn("source_id", F.col("source_id").cast("double"))
    return tile_map(given, kernel, "row int, col int, z double, source_id int", halo=halo, tile=max(tile, halo))
