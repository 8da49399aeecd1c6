"""SQL twins of the adapters in ``adapters.py``, used by the checking queries only."""

VIEWS = {
    "cells": """
        SELECT CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col,
               (CAST(p_partkey // 50 AS INT) * 2 + CAST(p_partkey % 50 AS INT)
                 - CASE WHEN p_partkey % 97 = 0 THEN 400 ELSE 0 END) / 1000.0::DOUBLE AS elevation_m,
               p_size <= 8 AS building,
               (p_brand = 'Brand#1' AND p_size > 8) AS road,
               p_size > 46 AS water,
               p_partkey
        FROM part""",
    "frames": """
        SELECT CAST(user_id // 15 AS INT) AS "row", CAST(user_id % 15 AS INT) AS col, t,
               CAST(s AS DOUBLE) / (n * 10000) AS h,
               ((e * 37) % 200 - 100) / 100.0::DOUBLE AS u, ((e * 53) % 200 - 100) / 100.0::DOUBLE AS v
        FROM (SELECT user_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t,
                     sum(CAST(round(value * 100) AS BIGINT)) AS s, count(*) AS n, max(event_id) AS e
              FROM events GROUP BY 1, 2)""",
    "raw_frames": """
        SELECT "row", col, t,
               CASE WHEN e % 11 = 0 THEN 'NaN'::DOUBLE
                    ELSE CAST(s - n * 2000 AS DOUBLE) / (n * 10000) END AS h,
               u, v
        FROM (SELECT CAST(user_id // 15 AS INT) AS "row", CAST(user_id % 15 AS INT) AS col, t, s, n, e,
                     ((e * 37) % 200 - 100) / 100.0::DOUBLE AS u, ((e * 53) % 200 - 100) / 100.0::DOUBLE AS v
              FROM (SELECT user_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t,
                           sum(CAST(round(value * 100) AS BIGINT)) AS s, count(*) AS n, max(event_id) AS e
                    FROM events GROUP BY 1, 2))""",
    "frame_cells": """
        SELECT CAST(user_id // 15 AS INT) AS "row", CAST(user_id % 15 AS INT) AS col,
               CAST(CASE WHEN user_id % 17 = 0 THEN 0 WHEN user_id % 13 = 0 THEN 3 ELSE 1 END AS INT) AS mask,
               (CAST(user_id // 15 AS INT) * 2 + CAST(user_id % 15 AS INT)) / 1000.0::DOUBLE AS elevation_m
        FROM (SELECT DISTINCT user_id FROM events)""",
    "stations": """
        SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_suppkey, s_name AS name,
               122 + ((s_suppkey * 7919) % 2400) / 100.0::DOUBLE AS lon,
               24 + ((s_suppkey * 104729) % 2100) / 100.0::DOUBLE AS lat
        FROM supplier""",
    "points": """
        SELECT c_custkey AS point_id,
               122 + ((c_custkey * 7919) % 2400) / 100.0::DOUBLE AS lon,
               24 + ((c_custkey * 104729) % 2100) / 100.0::DOUBLE AS lat
        FROM customer""",
    "rain_events": """
        SELECT o_orderkey AS event_id, CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS station_id,
               CASE o_orderkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 60 ELSE 1440 END AS duration_minutes,
               o_totalprice / 1000 AS total_mm, o_orderdate AS event_date
        FROM orders""",
    "elevation": """
        SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS source_id,
               CAST(o_custkey // 15 AS INT) AS "row", CAST(o_custkey % 15 AS INT) AS col,
               min(o_totalprice) AS z
        FROM orders GROUP BY 1, 2, 3""",
    "run_events": """
        SELECT user_id AS run_id, event_id AS sequence, ts,
               CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'VALIDATING'
                    WHEN 'click' THEN 'ACQUIRING_TERRAIN' WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAILED' END AS state,
               (CAST(round(value * 100) AS BIGINT) % 130 - 10) / 100.0::DOUBLE AS progress
        FROM events""",
    "scene": """
        SELECT CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col,
               (CAST(p_partkey // 50 AS INT) * 2 + CAST(p_partkey % 50 AS INT)
                 - CASE WHEN p_partkey % 397 = 0 THEN 400 ELSE 0 END) / 1000.0::DOUBLE AS elevation_m,
               (p_partkey // 50 // 8 + p_partkey % 50 // 8 * 3) % 11 = 0 AS building,
               p_partkey % 50 = 43 AS road, p_partkey % 613 = 0 AS native,
               CASE WHEN (p_partkey // 50 // 8 + p_partkey % 50 // 8 * 3) % 11 = 0 THEN 0 ELSE 1 END AS mask,
               CAST(p_partkey % 50 // 24 AS INT) AS zone
        FROM part""",
}
