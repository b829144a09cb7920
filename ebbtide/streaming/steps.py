"""Versioned tables for micro-batches.

Each micro-batch writes its own version of a table under its batch number. A
batch that is run again after a failure overwrites the same version and reads
the one before it, so replays change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


#: Keyed state stays on disk, and a batch writes what it changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DONE = "_SUCCESS"  # the last file that a finished write leaves


def write_version(rows: DataFrame, path: str, batch: int) -> None:
    """A version counts once its commit marker is there, which Spark writes last."""
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/batch={batch}")


def read_version(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={batch}")


def read_before(spark: SparkSession, path: str, batch: int, schema: StructType) -> DataFrame:
    """The version of the batch before, empty for the first."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch - 1}")


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, in order; one that is being written is not among them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/{DONE}")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    return sorted(int(re.search(rf"/batch=(\d+)/{DONE}$", str(f.getPath()))[1]) for f in found)


def read_newest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest whole version there is now, also when it holds no row; empty without one."""
    numbers = finished(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], schema)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
                every: str | None = None) -> StreamingQuery:
    """Run `step` per micro-batch: on a schedule, or over what is there and stop."""
    writer = stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return with_state(stream.sparkSession, (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start)


def with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query under the settings of STATE; it keeps them."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
