"""From raw documents to a training mix: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import contamination, jaccard, line_chunks, mixing, toxicity
from ebbtide.llm.base import table, written

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit by a model of the folder's labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).where(F.col("score") < TOXIC_FROM).select("row.*")


HAS_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of several lines that an earlier one has; n_chars is brought up to date.

    A document that is left without a word was a copy, line for line, and goes. One
    that never had a word stays.
    """
    left = line_chunks.without_repeated_chunks(docs)
    cut = F.col("n_removed_lines") > 0
    columns = [F.when(cut, F.length("row.text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
               for c in docs.columns]
    return left.where(~cut | F.col("row.text").rlike(HAS_WORDS)).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return contamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot in the mix, in reading order. The new columns give way to columns of the same names."""
    order = mixing.mixed_order(docs).orderBy("slot", "place", "source", "row.doc_id")
    return order.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("slot").alias(free("mix_slot", docs)), F.col("place").alias(free("mix_place", docs)))


def free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("mixing", mix_sources)]

#: MinHash and trees have no SQL; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
