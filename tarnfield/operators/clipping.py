"""Polygons cut to a rectangle, where a concave ring may fall into several.

A ring is cut by the four sides in turn. The part inside a side is a set of chains between an entry and an exit
on the side's line. Sorted along the line, the crossings bound the ring's inside in pairs, so an exit goes on at
the entry it is paired with; following those links gives the rings. Rings wholly inside or outside are told by
their bounds and never walked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tarnfield.operators.vectors import RING, clip_lines

LEAST_AREA = 1e-9
Box = tuple[float, float, float, float]  # xmin, ymin, xmax, ymax


def area_box(width_m: float, height_m: float, margin_m: float = 20.0) -> Box:
    """The rectangle of an area around the origin with a margin on every side."""
    half_w, half_h = width_m / 2 + margin_m, height_m / 2 + margin_m
    return -half_w, -half_h, half_w, half_h


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T  # near the origin: no digits are lost on far coordinates
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def cut_side(ring: np.ndarray, normal: np.ndarray, least: float) -> list[np.ndarray]:
    """Open rings of the part of an open ring where ``normal . p >= least``; what only touches the line is no part.

    ``normal`` lies along an axis, and crossings get the line's own coordinate: a strip as thin as one bit stays one.
    """
    depth = ring @ normal - least
    inside = depth > 0
    if (depth >= 0).all():
        return [ring]
    if not inside.any():
        return []
    first = int(np.flatnonzero(~inside)[0])
    ring, depth, inside = (np.roll(v, -first, axis=0) for v in (ring, depth, inside))
    n = len(ring)
    before = np.roll(inside, 1)
    begins = np.flatnonzero(inside & ~before)  # first vertex of each chain
    ends = np.flatnonzero(inside & ~np.roll(inside, -1))

    def crossing(out: np.ndarray, into: np.ndarray) -> np.ndarray:
        share = depth[out] / (depth[out] - depth[into])
        found = ring[out] + share[:, None] * (ring[into] - ring[out])
        found[:, normal != 0] = least * normal[normal != 0]
        return found

    entries, exits = crossing(begins - 1, begins), crossing((ends + 1) % n, ends)
    along = np.array([-normal[1], normal[0]])
    place = np.concatenate([entries @ along, exits @ along])
    chains = len(begins)
    order = np.lexsort([np.tile(np.arange(chains), 2), place])
    partner = np.empty(2 * chains, dtype=np.int64)
    for k in range(0, 2 * chains, 2):
        a, b = order[k], order[k + 1]
        if (a < chains) == (b < chains) and k + 2 < 2 * chains and place[b] == place[order[k + 2]]:
            order[k + 1], order[k + 2] = order[k + 2], order[k + 1]  # crossings in one point: the other one fits
            b = order[k + 1]
        partner[a], partner[b] = b, a
    follows = partner[chains:]
    if (follows >= chains).any():  # the ring crosses itself on the line: keep its own order, as one ring
        follows = np.roll(np.arange(chains), -1)
    rings, left = [], np.ones(chains, dtype=bool)
    for chain in range(chains):
        points = []
        while left[chain]:
            left[chain] = False
            points += [entries[chain][None], ring[begins[chain] : ends[chain] + 1], exits[chain][None]]
            chain = int(follows[chain])
        if points:
            found = np.concatenate(points)
            found = found[(found != np.roll(found, 1, axis=0)).any(axis=1)]
            if len(found) > 2:
                rings.append(found)
    return rings


def cut_ring(ring: np.ndarray, box: Box, least_area: float = LEAST_AREA) -> list[np.ndarray]:
    """Closed rings of a closed ring inside a rectangle, without those of ``least_area`` or less."""
    rings = [ring[:-1] if (ring[0] == ring[-1]).all() else ring]
    xmin, ymin, xmax, ymax = box
    for normal, least in (((1.0, 0.0), xmin), ((-1.0, 0.0), -xmax), ((0.0, 1.0), ymin), ((0.0, -1.0), -ymax)):
        rings = [part for r in rings for part in cut_side(r, np.array(normal), least)]
    return [np.concatenate([r, r[:1]]) for r in rings if len(r) > 2 and abs(signed_area(r)) > least_area]


def clip_polygons(features: DataFrame, box: Box, least_area: float = LEAST_AREA) -> DataFrame:
    """Rows with a closed ``ring`` cut to a rectangle: one row per ring that is left, numbered by ``piece``.

    Rings of ``least_area`` or less are slivers and go; with 0 every ring that has an area stays.
    """
    box = tuple(float(b) for b in box)
    names = [c for c in features.columns if c != "piece"]
    given = features.select(*[F.col(c).cast(RING).alias(c) if c == "ring" else F.col(c) for c in names])
    at = names.index("ring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            values = rings.flatten()
            points = np.stack([values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            rows, pieces, parts = [], [], []
            for row in np.flatnonzero(sizes > 2):
                ring = points[ends[row] - sizes[row] : ends[row]]
                (x0, y0), (x1, y1) = ring.min(axis=0), ring.max(axis=0)
                if x1 < box[0] or y1 < box[1] or x0 > box[2] or y0 > box[3]:
                    continue
                whole = x0 >= box[0] and y0 >= box[1] and x1 <= box[2] and y1 <= box[3]
                found = [ring] if whole and abs(signed_area(ring)) > least_area else cut_ring(ring, box, least_area)
                rows += [row] * len(found)
                pieces += range(len(found))
                parts += found
            flat = np.concatenate(parts) if parts else np.zeros((0, 2))
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.ListArray.from_arrays(pa.array(offsets), xy) if k == at else kept.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.int32())], names=[*names, "piece"])

    schema = StructType([*given.schema.fields, StructField("piece", IntegerType())])
    return given.mapInArrow(run, schema)


def clip_features(features: DataFrame, box: Box) -> DataFrame:
    """Payload features (``layer``, ``ring``): polygons and ``*_line`` layers cut to a rectangle, with ``piece``."""
    line = F.col("layer").endswith("_line")
    polygons = clip_polygons(features.filter(~line), box)
    lines = clip_lines(features.filter(line).withColumn("ring", F.col("ring").cast(RING)).drop("part"), box)
    named = lines.withColumnRenamed("part", "piece").withColumn("piece", F.col("piece").cast("int"))
    keep = [c for c in features.columns if c != "part"]
    return polygons.select(*keep, "piece").unionByName(named.select(*keep, "piece"))
