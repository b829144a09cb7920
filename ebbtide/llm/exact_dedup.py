"""Exact duplicates by a stateful stream.

The stream's state is keyed by the digest of the normalised text, lives in
RocksDB on disk and never expires. For each digest it retains the stable
identifier (largest doc_id), the content locator of that row (file and row
number) and the number of rows. Rows of a micro-batch are reduced per task
before they reach the state, so a huge group is one row from each task. Every
micro-batch writes its changed keys under its number: a repeated batch
overwrites itself.

A hit is a digest met more than once. The texts of its rows are compared in full;
if they differ, the rows are grouped by the text itself. The locator names the
one row that stays, also among rows equal in text and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .base import ascii_lower, settings

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Small stores would otherwise each reserve megabytes of disk ahead of use.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
FILES_PER_BATCH = 64


def located(rows: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """doc_id, locator, digest and normalised text of files read as rows."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return rows.select(F.col(id_col).alias("doc_id"), place.alias("locator"), text.alias("norm")).withColumn(
        "digest", F.substring(F.sha2("norm", 256), 1, digest_bits // 4))


def newest() -> list[Column]:
    """Of a group: the row that stays, and how many rows there are."""
    return [F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("n")]


def stream_state(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256,
                 files_per_batch: int = FILES_PER_BATCH, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run the stream over all files not yet seen; the latest row of every digest.

    With the same checkpoint and out, a later call takes only files that are new.
    """
    checkpoint, out = checkpoint or scratch_path(spark, "dedup-state"), out or scratch_path(spark, "dedup-keys")
    schema = spark.read.parquet(path).schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, STATE):
        # As a pattern that matches this path alone, it may be one file as well as a folder.
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
        keys = located(source, id_col, text_col, digest_bits).groupBy("digest").agg(*newest())
        query = (keys.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    changed = spark.read.schema("digest string, top struct<doc_id: bigint, locator: string>, n bigint, batch int").parquet(out)
    return changed.groupBy("digest").agg(F.max_by(F.struct("top", "n"), "batch").alias("s")).select("digest", "s.top", "s.n")


def exact_groups(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256,
                 files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row for each row of the Parquet folder: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are one group. Of rows equal in text and id
    one is kept, the one latest by file and row number; a null id is below all
    others. Columns besides id and text are not read, whatever their names. An
    empty table gives no rows. `digest_bits` is lowered only by tests, to make
    different texts meet under one digest.
    """
    state_path = scratch_path(spark, "dedup-latest")
    stream_state(spark, path, id_col=id_col, text_col=text_col, digest_bits=digest_bits, files_per_batch=files_per_batch).write.parquet(state_path)
    state = spark.read.parquet(state_path)
    rows = located(spark.read.parquet(path), id_col, text_col, digest_bits)

    # Grouping by the text compares it in full; equal texts are one row of each task.
    many = state.where("n > 1").select("digest")
    bodies = rows.join(many, "digest").groupBy("digest", "norm").agg(*newest())
    body_path = scratch_path(spark, "dedup-bodies")
    bodies.select("digest", F.sha2("norm", 256).alias("text_sha256"), "top", "n").write.parquet(body_path)
    bodies = spark.read.parquet(body_path)
    mixed = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    split_path = scratch_path(spark, "dedup-mixed")
    bodies.join(mixed, "digest").write.parquet(split_path)
    split = spark.read.parquet(split_path)

    light = rows.select("doc_id", "locator", "digest", F.sha2("norm", 256).alias("text_sha256"))
    if split.isEmpty():
        groups = light.join(state.select("digest", "top", "n"), "digest")
    else:
        exact = split.select("text_sha256", "top", "n")
        whole = state.join(split.select("digest").distinct(), "digest", "left_anti")
        groups = (light.join(whole, "digest").select("doc_id", "locator", "text_sha256", "top", "n")
                  .unionByName(light.join(split.select("digest").distinct(), "digest", "left_semi").join(exact, "text_sha256")
                               .select("doc_id", "locator", "text_sha256", "top", "n")))
    return groups.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                         (F.col("locator") == F.col("top.locator")).alias("kept"), "text_sha256")
