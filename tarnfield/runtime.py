"""Session set-up, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarnfield")
    settings = {
        **SESSION_DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_bytes: int = 8 << 20, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after measuring rows and bytes; a larger side keeps the shuffled (AQE) join."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns]
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(sizes, F.lit(8))).alias("bytes")).first()
    if found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes:
        return F.broadcast(df)
    return df
