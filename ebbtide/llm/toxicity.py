"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that occur in far more toxic
than other labelled texts. It is counted in Spark over all labelled training
rows, in folds, so that a training row is scored by a lexicon that has not seen
its own fold. Features of a text are densities and peaks of lexicon entries,
how near second-person words stand to them, capitals, punctuation, and how
often words only match after de-obfuscation. Trees are fitted on the features
of a bounded sample of labelled rows, calibration on a fold kept from them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bitmap_of, extended, in_bitmap, written

FOLDS = 4
FIT_ROWS = 20_000        # labelled rows, chosen by hash, that trees and calibration are fitted on (expected number)
LEXICON_ENTRIES = 4096   # entries of greatest weight that a lexicon keeps
LEAST_TEXTS = 4          # toxic training texts that an entry must occur in
LEAST_ODDS = 2.0         # log odds from which an entry counts
STRONG_ODDS = 3.0
PREFIXES = (4, 5)
NEAR = 5                 # words between a second-person word and an entry that count as near

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.U)
JOINED = re.compile(r"(?<![^\W_])(?:[^\W_][.*_\-]){2,}[^\W_](?![^\W_])|[^\W\d_]+[@$!*013457|][\w@$!*|]*", re.U)
#: Look-alike characters and the letters they stand for.
LOOKALIKES = str.maketrans("@$!013457|*", "asioieastl_")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Kind of each byte of a text: 1 capital, 2 punctuation, 3 odd sign, 4 exclamation mark, 5 digit or a sign that stands for a letter, 0 other.
CHARACTER = np.array([1 if 65 <= b <= 90 else 4 if b == 33 else 5 if chr(b) in "0123456789@$*_-|" else 3 if chr(b) in "#%&^~<>{}"
                      else 2 if 33 <= b < 127 and not chr(b).isalnum() else 0 for b in range(256)], dtype=np.int64)
FEATURES = ("density", "strong_density", "strong_words", "strong_kinds", "peak", "mean_weight", "prefix_density", "near_you", "you_density", "capital_rate",
            "capital_words", "punctuation_rate", "bang_rate", "odd_rate", "obfuscated_rate", "obfuscated_hits", "words")


def terms(text: str) -> set[str]:
    """Distinct words and word beginnings of a text, and what obfuscated words stand for."""
    found = set()
    for w in set(WORD.findall(text.lower())) | set(deobfuscated(text)):
        found.add(w)
        for n in PREFIXES:
            if len(w) > n:
                found.add("^" + w[:n])
    return found


def deobfuscated(text: str) -> list[str]:
    out = []
    for m in JOINED.findall(text):
        plain = re.sub(r"[^\w]|_", "", m.lower().translate(LOOKALIKES))
        if len(plain) > 2:
            out.append(plain)
    return out


class Scorer:
    """Features of texts under one lexicon; what is known of a token is kept while it is common."""

    KEPT = 500_000

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, tuple | None] = {}

    def look_up(self, token: str) -> tuple | None:
        """(word, weight, by its beginning, second person, capitals), None for a plain word."""
        w = token.lower()
        weight, by_prefix = self.weights.get(w, 0.0), False
        if not weight and len(w) > PREFIXES[0]:
            weight = max(self.weights.get("^" + w[:k], 0.0) for k in PREFIXES)
            by_prefix = weight > 0
        capitals = len(token) > 2 and token.isupper()
        found = (w, weight, by_prefix, w in SECOND_PERSON, capitals) if weight or capitals or w in SECOND_PERSON else None
        if len(self.known) >= self.KEPT:
            self.known.clear()
        self.known[token] = found
        return found

    def features(self, text: str, raw: np.ndarray) -> list[float]:
        tokens, known = WORD.findall(text), self.known
        n = max(1, len(tokens))
        hits = strong = by_prefix = near = you = caps = 0
        peak = total = 0.0
        kinds: set[str] = set()
        last_you = last_hit = -NEAR - 1
        for i, token in enumerate(tokens):
            found = known[token] if token in known else self.look_up(token)
            if found is None:
                continue
            w, weight, prefix, second, capitals = found
            caps += capitals
            if second:
                you += 1
                near += i - last_hit <= NEAR
                last_you = i
            if weight > 0:
                hits += 1
                by_prefix += prefix
                total += weight
                peak = max(peak, weight)
                near += i - last_you <= NEAR
                last_hit = i
                if weight >= STRONG_ODDS:
                    strong += 1
                    kinds.add(w)
        kinds_of = np.bincount(CHARACTER[raw], minlength=6)
        # Hidden words need one of the look-alikes, or two full stops around one character.
        may_hide = kinds_of[4] + kinds_of[5] > 0 or bool(np.any((raw[:-2] == 46) & (raw[2:] == 46)))
        hidden = deobfuscated(text) if may_hide else []
        chars = max(1, len(text))
        return [hits / n, strong / n, float(strong), float(len(kinds)), peak, total / max(1, hits), by_prefix / n, near / n, you / n,
                kinds_of[1] / chars, caps / n, kinds_of[2:].sum() / chars, kinds_of[4] / chars, kinds_of[3] / chars,
                len(hidden) / n, float(sum(self.weights.get(w, 0.0) >= LEAST_ODDS for w in hidden)), math.log1p(len(tokens))]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[tuple[str, int], list[int]] = {}
        for text, fold, toxic in zip(batch.column("text"), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for t in terms(text.as_py()):
                out.setdefault((t, fold), [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()),
                                          pa.array([v[1] for v in out.values()], pa.int64()), pa.array([v[0] for v in out.values()], pa.int64())],
                                         names=["term", "fold", "bad", "good"])


def lexicons(labelled: DataFrame, entries: int = LEXICON_ENTRIES) -> list[dict[str, float]]:
    """One lexicon without each fold, and one of all folds at the end.

    Counted over all labelled rows, which hold a text once: many copies are one
    piece of evidence. Each has at most `entries` entries: that is
    what reaches the driver and what is broadcast.
    """
    counts = labelled.select("text", "fold", "toxic").mapInArrow(_terms, "term string, fold int, bad bigint, good bigint")
    per_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("bad", "good")]
    table = written(labelled.sparkSession, counts.groupBy("term").agg(*per_fold).where(" + ".join(f"bad{f}" for f in range(FOLDS)) + f" >= {LEAST_TEXTS}"), "lexicon")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in labelled.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for left in (*range(FOLDS), None):
        used = [f for f in range(FOLDS) if f != left]
        bad, good = (sum((F.col(f"{c}{f}") for f in used), F.lit(0)) for c in ("bad", "good"))
        n_bad, n_good = (sum(sizes.get((f, t), 0) for f in used) + 1.0 for t in (1, 0))
        odds = F.log((bad + 0.1) / n_bad) - F.log((good + 0.5) / n_good)
        # Entries that hold in too few toxic texts are chance or one text copied about.
        least = F.lit(max(3.0, 0.003 * n_bad))
        top = (table.where(bad >= least).select("term", odds.alias("odds"), (odds * F.sqrt(bad)).alias("rank")).where(F.col("odds") >= LEAST_ODDS)
               .orderBy(F.desc("rank"), "term").limit(entries).select("term", F.round("odds", 6).alias("odds")).collect())
        out.append({r["term"]: r["odds"] for r in top})
    return out


def _featured(lexicons_sent, with_fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(weights) for weights in lexicons_sent.value]
        for batch in batches:
            folds = batch.column("fold").to_pylist() if with_fold else [-1] * batch.num_rows
            rows = [scorers[fold].features(text.as_py() or "", np.frombuffer(text.as_buffer() or b"", dtype=np.uint8))
                    for text, fold in zip(batch.column("text"), folds, strict=True)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])
    return run


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: object
    bounds: list[float]
    levels: list[float]

    def score(self, docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
        """Each row of docs as struct `row`, with score between 0 and 1. Null texts count as empty."""
        sent = docs.sparkSession.sparkContext.broadcast([self.lexicon])
        rows = docs.select((F.struct("*") if with_text else F.struct(*(c for c in docs.columns if c != text_col))).alias("row"), F.col(text_col).alias("text"))
        kind = extended(rows.select("row").schema, "features array<double>")
        scored = self.trees.transform(rows.mapInArrow(_featured(sent, False), kind).withColumn("vector", array_to_vector("features")))
        raw = F.get(vector_to_array("probability"), 1)
        return scored.select("row", F.round(interpolated(raw, self.bounds, self.levels), 9).alias("score"))


def interpolated(x: Column, bounds: list[float], levels: list[float]) -> Column:
    """The isotonic step function, linear between its knots (few: their number is that of distinct levels)."""
    if not bounds:
        return x
    knots = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(v).alias("v")) for b, v in zip(bounds, levels, strict=True)))
    low = F.array_max(F.filter(knots, lambda k: k["b"] <= x))
    high = F.array_min(F.filter(knots, lambda k: k["b"] > x))
    between = low["v"] + (high["v"] - low["v"]) * (x - low["b"]) / (high["b"] - low["b"])
    value = F.when(low.isNull(), F.lit(levels[0])).when(high.isNull(), F.lit(levels[-1])).otherwise(between)
    # A thousandth of the tree score keeps the order inside a level.
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value * 0.999 + x * 0.001))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from the labelled rows of docs whose id is not held out.

    Rows without id or label teach nothing; null texts count as empty; several
    labels of one id or one text count as toxic if one says so; rows of equal text count once.
    With no labels, or labels of one kind, the score is that share of 1s.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(~held_out("id"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    # Which rows teach is decided without their texts; then only those texts are moved, once.
    chosen = rows.select("id", "text_hash").join(marks, "id").groupBy("text_hash").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    chosen = written(spark, chosen.withColumn("row_hash", F.xxhash64("id", "text_hash")), "toxic-chosen")
    bitmap = spark.sparkContext.broadcast(bitmap_of(chosen, "row_hash"))
    teaches = F.pandas_udf(lambda h: pd.Series(in_bitmap(bitmap.value, h.to_numpy())), "boolean")
    labelled = rows.where(teaches(F.xxhash64("id", "text_hash"))).join(chosen.select("id", "text_hash", "toxic"), ["id", "text_hash"])
    labelled = labelled.dropDuplicates(["id", "text_hash"]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int"))
    labelled = written(spark, labelled, "toxic-labelled")
    known = lexicons(labelled)
    share = min(1.0, fit_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    sent = spark.sparkContext.broadcast(known)
    kind = extended(sample.select("id", "fold", "toxic").schema, "features array<double>")
    sample = sample.select("id", "text", "fold", "toxic").mapInArrow(_featured(sent, True), kind)
    sample = written(spark, sample.withColumn("label", F.col("toxic").cast("double")).select("fold", "label", "features"), "toxic-sample").coalesce(1)
    sample = sample.withColumn("vector", array_to_vector("features"))
    counts = {(r["last"], r["label"]): r["n"] for r in sample.groupBy((F.col("fold") == FOLDS - 1).alias("last"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sum(n for (_, y), n in counts.items() if y == 1) / max(1, sum(counts.values()))
    if not (counts.get((False, 1.0)) and counts.get((False, 0.0))):
        return ToxicityModel(known[-1], Constant(share), [], [])
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, maxBins=64, seed=7)
    trees = trees.fit(sample.where(F.col("fold") != FOLDS - 1))
    kept = trees.transform(sample.where(F.col("fold") == FOLDS - 1)).select("label", F.get(vector_to_array("probability"), 1).alias("p"))
    if not (counts.get((True, 1.0)) and counts.get((True, 0.0))):
        return ToxicityModel(known[-1], trees, [], [])
    steps = IsotonicRegression(featuresCol="p", labelCol="label").fit(kept.select("p", "label"))
    pairs: dict[float, float] = {}
    for b, v in zip(np.asarray(steps.boundaries).tolist(), np.asarray(steps.predictions).tolist(), strict=True):
        pairs[b] = v
    return ToxicityModel(known[-1], trees, list(pairs), list(pairs.values()))


@dataclass(frozen=True)
class Constant:
    """Stands for the trees where there is nothing to learn from."""

    share: float

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("probability", array_to_vector(F.array(F.lit(1 - self.share), F.lit(self.share))))


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
