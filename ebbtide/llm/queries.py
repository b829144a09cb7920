"""One query for each operator, over whole tables; digests are derived from the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import contamination, conversation_trie, exact_dedup, html_text, jaccard, licenses, line_chunks, mixing, personal_data, repeats, token_files, toxicity, vector_codes
from .base import table, written

SCORE_FROM = 0.3


def joined_ids(ids: str) -> Column:
    """Ids as strings, sorted as strings, comma-joined."""
    return F.array_join(F.array_sort(F.transform(F.col(ids), lambda x: x.cast("string"))), ",")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(tune(spark), folder, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, table(spark, folder, "benchmark"), with_text=False)
    hit = contamination.hit_words("spans")
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(joined_ids("items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.personal_data(table(tune(spark), folder, "documents").select("doc_id", "text"))
    base = [(k, k) for k in personal_data.KINDS]
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed(*base), 256).alias("base_sha256"),
                        personal_data.listed(*base, ("context", "context")).alias("spans"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(tune(spark), f"{folder}/documents.parquet")


def op4_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    done = line_chunks.without_repeated_chunks(table(tune(spark), folder, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(tune(spark), folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = model.score(docs, with_text=False)
    return scored.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= SCORE_FROM).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_matches(table(tune(spark), folder, "documents").select("doc_id", "text"))
    names = F.array_join(F.transform("matches", lambda m: m["template"]), ",")
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_licenses"), names.alias("licenses"),
                        F.array_max(F.transform("matches", lambda m: m["containment"])).alias("containment"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = repeats.without_repeats(table(tune(spark), folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.near_duplicates(table(tune(spark), folder, "documents"))
    return found.select("doc_id", "class_id", "group_id", "group_size", "n_links")


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    done = html_text.main_texts(table(tune(spark), folder, "pages"))
    return done.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    order = mixing.mixed_order(table(tune(spark), folder, "documents").select("doc_id", "source"))
    return order.select("row.doc_id", "source", "block", "slot", "released", "due", "place")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(tune(spark), folder, "embeddings"))
    coded = written(spark, coded, "codes")
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = coded.alias("c").join(of_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", vector_codes.hex_codes("codes").alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


#: Conversations that share a head, and one more than the most turns of it.
FAMILY, HEADS = 5, 9


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(tune(spark), folder, "conversations"))
    rebuilt, convs = conversation_trie.spliced(written(spark, turns, "ordered"), FAMILY, HEADS)
    return conversation_trie.prefix_trie(rebuilt, convs)


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_token_files(table(tune(spark), folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(tune(spark), folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_personal_data, op3_exact_dedup, op4_line_chunks, op5_toxicity, op6_licenses, op7_suffix_dedup,
                            op8_jaccard_join, op9_html_text, op10_mixing, op11_vector_codes, op12_conversation_trie, op13_token_files, pipeline)}
