"""Headline queries, timed end to end; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnfield.plans import QUERIES  # noqa: E402
from tarnfield.runtime import local_session  # noqa: E402

HEADLINE = [
    "s1_cube_scan",
    "s2_window_read",
    "s3_point_series",
    "a4_cell_summary",
    "a5_diagnostics",
    "a15_accuracy_gate",
    "a9_weighted_quantiles",
    "p11_hydraulic_mask",
    "a17_plane_fit",
    "g2_components",
    "g3_roof_rain",
    "g5_nearest_fill",
    "g14_two_to_one_balance",
    "j1_nearest_stations",
    "j5_priority_coalesce",
    "j18_nearest_in_time",
    "g9_polygons_touched",
    "w5_nearest_to_bin_centre",
    "w8_cumulative_durations",
    "p23_distributed_forcing",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


SIDE = 8000


def chunk_reads(spark, seconds: dict[str, float], rows: dict[str, int]) -> None:
    """Chunk reads like the published ones: 2000 x 2000 float32 out of an 8000 x 8000 frame stored as dense tiles.

    The frame repeats the lineitem rows in key order until it is full; tiles are the default ones.
    """
    import numpy as np
    from pyspark.sql import functions as F

    from tarnfield.operators.ordered import global_row_number
    from tarnfield.plans import adapters as A
    from tarnfield.runtime import cut_lineage, scratch_path
    from tarnfield.sources import dense

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    lines = A.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    numbered = cut_lineage(global_row_number(lines, [F.col("l_orderkey"), F.col("l_linenumber")], "l_orderkey", "k")).repartition(32)
    times = -(-SIDE * SIDE // lines.count())
    at = (F.col("k") - 1) * times + F.col("n")
    cells = numbered.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).filter(at < SIDE * SIDE).select(
        F.lit("r").alias("run_id"),
        F.lit(0).alias("t"),
        F.floor(at / SIDE).cast("int").alias("row"),
        (at % SIDE).cast("int").alias("col"),
        (F.col("l_quantity") / 10).cast("double").alias("h"),
        F.col("l_discount").alias("u"),
        F.col("l_tax").alias("v"),
    )
    path = scratch_path(spark, "bench-cube")
    grid = dense.GridSpec(SIDE, SIDE)
    seconds["s17_write_cube_tiles"] = timed(lambda: dense.write_dense(cells, path, grid))
    stored = dense.DenseCube(spark.newSession(), path)
    half = SIDE // 2
    chunks = (
        ("s2_chunk_2000x2000_h_first", (0, 2000), (0, 2000), ("h",)),
        ("s2_chunk_2000x2000_h_second", (half + 1000, half + 3000), (half, half + 2000), ("h",)),
        ("s2_chunk_2000x2000_uv", (0, 2000), (0, 2000), ("u", "v")),
    )
    for name, high, wide, columns in chunks:
        # Like the published reads: the window's arrays in hand.
        read = []
        seconds[name] = timed(lambda: read.append(stored.window_arrays(0, high, wide, columns)))
        rows[name] = min(int(np.isfinite(v).sum()) for v in read[0].values())
        if rows[name] != 2000 * 2000:
            raise AssertionError(f"{name} read {rows[name]} cells")
        # The same window as a DataFrame of cells, counted and summed.
        total = stored.window(0, high, wide, columns).agg(F.count(columns[0]), *[F.sum(c) for c in columns])
        counted = []
        seconds[f"{name}_as_rows"] = timed(lambda: counted.append(total.first()))
        if counted[0][0] != 2000 * 2000 or None in counted[0]:
            raise AssertionError(f"{name} gave {counted[0]} as rows")
    whole = []
    seconds["s2_whole_frame_8000x8000_h"] = timed(lambda: whole.append(stored.totals().first()))
    rows["s2_whole_frame_8000x8000_h"] = whole[0]["h_n"]
    if whole[0]["h_n"] != SIDE * SIDE:
        raise AssertionError(f"whole frame gave {whole[0]}")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{folder}/events.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    rows: dict[str, int] = {}
    chunk_reads(spark, seconds, rows)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
