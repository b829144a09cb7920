"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs count on. Broadcast sides are chosen by Spark from
# measured shuffle sizes (adaptive execution), never by an unchecked hint; the
# skew split may add a shuffle, which is cheaper than one task with a hot symbol.
# Distributions must use all their keys: data already laid out by symbol would
# otherwise satisfy (symbol, chunk) and keep a hot symbol in one task. Local
# shuffle reads are off because they undo the spreading of rows that few map
# tasks wrote.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "false",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_FALLBACK: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a temporary one, if all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="ebbtide-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table or stream checkpoint."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("ebbtide")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # Recording the call site of every column takes longer than the small plans do.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
