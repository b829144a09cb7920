"""Removal of every byte inside a long repeated string, by sampled suffixes.

The suffix order is only needed to the depth of the repeat (200 bytes), and the
cover of sampled positions is content-defined: of any 100 consecutive positions
the one whose eight bytes hash lowest is sampled. Both places of a repeated
string are then sampled at the same offsets, which is what a difference cover is
for, with one sample in about 50 positions instead of two in three.

1. Sampled suffixes. A sample is responsible for a run of string starts at and
   before it, and each of those strings holds the CORE bytes from the sample on.
   Samples whose core occurs once cannot be in a repeat and go no further. A
   bitmap of fixed size, made from repeated cores, drops most of them while
   texts are scanned; it may let some pass, which only costs time.
2. Names. A sample's context (all bytes of its strings) is named by its digest.
   Equal names mean that all their strings repeat. Samples that share the core
   but not the context are refined: only one sample of each name goes on.
3. Remaining suffixes. Starts before a sample are compared by the bytes up to
   it and the name of what follows: first eight starts together by the bytes
   they have in common and by their whole, then start by start where eight agree
   only in part. One task never needs a whole group: every comparison is an
   equality of names, counted with partial aggregation.

No window of text is shuffled more than once, and of equal contexts one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CLEAN_UP, bitmap_of, in_bitmap, mixed, settings, text_key, written

LENGTH = 200
WINDOW = 100                    # positions that share one sample
GRAM = 8
CORE = LENGTH - WINDOW + 1      # bytes from a sample on that all its strings hold
BLOCK = 8                       # starts refined together
PIECE = 1 << 20                 # starts of one text looked at at once
BUNDLE = 1 << 17                # bytes of short texts looked at together

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(17).integers(0, 2**64, CORE // GRAM + 1, dtype=np.uint64)


def _sampled(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed eight bytes at each position, and the sample of each start of LENGTH bytes."""
    grams = np.empty(len(raw) - GRAM + 1, dtype=np.uint64)
    for o in range(GRAM):
        grams[o::GRAM] = np.frombuffer(raw, dtype="<u8", offset=o, count=(len(raw) - o) // GRAM)
    least = (grams ^ (grams >> np.uint64(31))) * _ODD
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < WINDOW:
        least = np.minimum(least[:size - WINDOW], least[WINDOW - size:])
    return grams, (least[:len(raw) - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _core_names(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the core in words of eight bytes, the last one overlapping."""
    core = np.zeros(len(at), dtype=np.uint64)
    for k, offset in enumerate([*range(0, CORE - GRAM, GRAM), CORE - GRAM]):
        core += mixed(grams[at + offset] + _SALT[k])
    return mixed(core).view(np.int64)


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first start, starts, sample, name of its core) of every run: all starts of LENGTH bytes, in order.

    Short texts are looked at in bundles; strings that would cross from one into
    the next are no starts. A long text is looked at by pieces.
    """
    waiting: list[int] = []
    size = 0
    for i, data in enumerate(texts):
        if len(data) < LENGTH:
            continue
        if len(data) >= BUNDLE:
            for low in range(0, len(data) - LENGTH + 1, PIECE):
                raw = data[low:low + PIECE + LENGTH - 1]
                grams, sample = _sampled(raw)
                first = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])
                at = sample[first]
                yield np.full(len(first), i), first + low, np.diff(np.r_[first, len(sample)]), at + low, _core_names(grams, at)
            continue
        if size + len(data) > BUNDLE:
            yield _bundled(texts, waiting)
            waiting, size = [], 0
        waiting.append(i)
        size += len(data)
    if waiting:
        yield _bundled(texts, waiting)


def _bundled(texts: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(texts[i]) for i in numbers])
    offsets = np.cumsum(sizes) - sizes
    grams, sample = _sampled(b"".join([texts[i] for i in numbers]))
    edge = np.r_[True, sample[1:] != sample[:-1], True]
    edge[offsets] = True
    edge[offsets + sizes - LENGTH + 1] = True       # from here on strings would cross
    bounds = np.flatnonzero(edge)
    first, count = bounds[:-1], np.diff(bounds)
    owner = np.searchsorted(offsets, first, side="right") - 1
    good = first <= offsets[owner] + sizes[owner] - LENGTH
    first, count, owner = first[good], count[good], owner[good]
    at = sample[first]
    return np.array(numbers)[owner], first - offsets[owner], count, at - offsets[owner], _core_names(grams, at)


def name64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - 2**63


def name128(data: bytes) -> tuple[int, int]:
    """A digest as two bigints, which aggregate by hash and without sorting."""
    d = xxhash.xxh3_128_intdigest(data)
    return (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [core for *_, core in runs([t or b"" for t in batch.column("text").to_pylist()])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, dtype=np.int64))], names=["core"])


def identities(seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each start of a text, its seed standing for the text's row."""
    return mixed(seeds + starts.astype(np.uint64) * _ODD).view(np.int64)


def table_of(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = []
    for name, kind in kinds.items():
        parts = columns[name]
        whole = np.concatenate(parts) if parts and isinstance(parts[0], np.ndarray) else parts
        arrays.append(pa.array(whole, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _samples(sent):
    """The samples that may repeat: their names and where they are."""
    kinds = {"core": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "ident": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "start": pa.int32(), "starts": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            docs, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_numpy()
            for which, first, count, _, core in runs(texts):
                some = np.flatnonzero(in_bitmap(bitmap, core))
                if not len(some):
                    continue
                which, first, count = which[some], first[some], count[some]
                names = [name128(texts[i][a:e]) for i, a, e in zip(which.tolist(), first.tolist(), (first + count + (LENGTH - 1)).tolist(), strict=True)]
                out["core"].append(core[some])
                out["c1"] += [x for x, _ in names]
                out["c2"] += [y for _, y in names]
                out["ident"].append(identities(seeds[which], first))
                out["doc_id"] += [docs[i] for i in which.tolist()]
                out["key"].append(keys[which])
                out["start"].append(first.astype(np.int32))
                out["starts"].append(count.astype(np.int32))
            yield table_of(out, kinds)
    return run


def _bytes(sent):
    """The bytes of chosen samples' contexts, with the place of the sample in them."""
    kinds = {"ident": pa.int64(), "back": pa.int32(), "starts": pa.int32(), "body": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            for which, first, count, sample, _ in runs(texts):
                ident = identities(seeds[which], first)
                some = np.flatnonzero(in_bitmap(bitmap, ident))
                if len(some):
                    w, a, n = which[some], first[some], count[some]
                    out["ident"].append(ident[some])
                    out["back"].append((sample[some] - a).astype(np.int32))
                    out["starts"].append(n.astype(np.int32))
                    out["body"] += [texts[i][x:y] for i, x, y in zip(w.tolist(), a.tolist(), (a + n + (LENGTH - 1)).tolist(), strict=True)]
            yield table_of(out, kinds)
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each context, blocks of starts that lie equally far before the sample: the name of their common bytes, and of all."""
    kinds = {"core": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "n": pa.int64(), "block": pa.int32(), "near": pa.int32(), "far": pa.int32(),
             "common": pa.int64(), "w1": pa.int64(), "w2": pa.int64()}
    for batch in batches:
        rows = []
        for core, c1, c2, n, back, starts, body in zip(*(batch.column(c).to_pylist() for c in ("core", "c1", "c2", "n", "back", "starts", "body")), strict=True):
            lowest = back - starts + 1
            for block in range(lowest // BLOCK, back // BLOCK + 1):
                near, far = max(lowest, block * BLOCK), min(back, block * BLOCK + BLOCK - 1)
                at = back - block * BLOCK  # where the sample is block * BLOCK bytes away
                whole = name128(b"%d %d " % (near, far) + body[back - far:back - near + LENGTH])
                rows.append((core, c1, c2, n, block, near, far, name64(body[at:at + LENGTH - BLOCK + 1]), *whole))
        yield table_of(dict(zip(kinds, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in kinds}, kinds)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each start of the listed blocks of a context, named by its string."""
    kinds = {"core": pa.int64(), "w1": pa.int64(), "w2": pa.int64(), "back": pa.int32(), "s1": pa.int64(), "s2": pa.int64()}
    for batch in batches:
        rows = []
        for core, back, body, blocks in zip(*(batch.column(x).to_pylist() for x in ("core", "back", "body", "blocks")), strict=True):
            for b in blocks:
                for o in range(b["near"], b["far"] + 1):
                    rows.append((core, b["w1"], b["w2"], o, *name128(body[back - o:back - o + LENGTH])))
        yield table_of(dict(zip(kinds, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in kinds}, kinds)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            data = text.as_py() or b""
            spans: list[list[int]] = []
            for low, high in sorted((x["low"], x["high"]) for x in found.as_py() or ()):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            left, at = [], 0
            for low, high in spans:
                left.append(data[at:low])
                at = high
            left.append(data[at:])
            n_bytes.append(len(data))
            n_removed.append(sum(h - x for x, h in spans))
            n_spans.append(len(spans))
            kept.append(b"".join(left))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                          pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes: a cut may fall inside a character).

    A null text counts as empty. Texts below 200 bytes keep everything. Repeated
    rows are repeats of each other. Runs that touch are one span. Other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    seeded = keyed.withColumn("seed", F.xxhash64("doc_id", "key"))
    cores = keyed.select("text").mapInArrow(_cores, "core bigint").groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with settings(spark, CLEAN_UP):
        sent = spark.sparkContext.broadcast(bitmap_of(cores, "core"))
    samples = written(spark, seeded.mapInArrow(_samples(sent), "core bigint, c1 bigint, c2 bigint, ident bigint, doc_id bigint, key bigint, start int, starts int"), "samples")

    named = samples.groupBy("c1", "c2").agg(F.min("core").alias("core"), F.count(F.lit(1)).alias("n"), F.min("ident").alias("ident"))
    named = written(spark, named, "contexts")
    mixed_cores = named.groupBy("core").agg(*several("c1", "c2")).where(SEVERAL).select("core")
    chosen = written(spark, named.join(mixed_cores, "core", "left_semi"), "mixed-contexts")
    sent = spark.sparkContext.broadcast(bitmap_of(chosen, "ident"))
    bodies = seeded.mapInArrow(_bytes(sent), "ident bigint, back int, starts int, body binary").join(chosen, "ident")
    bodies = written(spark, bodies.select("core", "c1", "c2", "n", "back", "starts", "body"), "context-bytes")

    kinds = "core bigint, c1 bigint, c2 bigint, n bigint, block int, near int, far int, common bigint, w1 bigint, w2 bigint"
    blocks = written(spark, bodies.mapInArrow(_blocks, kinds), "blocks")
    wholes = written(spark, blocks.groupBy("core", "block", "common", "w1", "w2", "near", "far").agg(F.sum("n").alias("n"), F.min("c1").alias("c1")), "block-names")
    unlike = wholes.groupBy("core", "block", "common").agg(*several("w1", "w2")).where(SEVERAL).select("core", "block", "common")
    # One context stands for all with the same block; the smallest first half of a name finds it.
    wanted = (wholes.join(unlike, ["core", "block", "common"], "left_semi").groupBy("core", "c1")
              .agg(F.collect_list(F.struct("near", "far", "w1", "w2")).alias("blocks")))
    starts = bodies.dropDuplicates(["core", "c1"]).join(wanted, ["core", "c1"]).select("core", "back", "body", "blocks")
    starts = written(spark, starts.mapInArrow(_starts, "core bigint, w1 bigint, w2 bigint, back int, s1 bigint, s2 bigint"), "starts")
    again = starts.groupBy("core", "back", "s1", "s2").agg(*several("w1", "w2")).where(SEVERAL).select("core", "back", "s1", "s2")
    single = starts.join(again, ["core", "back", "s1", "s2"]).select("core", "w1", "w2", F.col("back").alias("near"), F.col("back").alias("far"))

    spans_of_whole = wholes.where("n > 1").select("core", "w1", "w2", "near", "far").unionByName(single)
    partly = (blocks.where("n = 1").select("core", "w1", "w2", "c1", "c2").join(spans_of_whole, ["core", "w1", "w2"])
              .groupBy("c1", "c2").agg(F.collect_set(F.struct("near", "far")).alias("spans")).join(bodies.select("c1", "c2", "back"), ["c1", "c2"]))
    # Distances before the sample, as numbers of starts in the run.
    partly = partly.select("c1", "c2", F.transform("spans", lambda s: F.struct((F.col("back") - s["far"]).alias("low"), (F.col("back") - s["near"]).alias("high"))).alias("spans"))
    all_of = named.where("n > 1").select("c1", "c2", F.lit(None).cast("array<struct<low:int,high:int>>").alias("spans"))
    known = written(spark, all_of.unionByName(partly), "repeats")

    whole_run = F.array(F.struct(F.lit(0).alias("low"), (F.col("starts") - 1).alias("high")))
    found = samples.select("c1", "c2", "doc_id", "key", "start", "starts").join(known, ["c1", "c2"]).select("doc_id", "key", F.transform(
        F.coalesce("spans", whole_run), lambda s: F.struct((F.col("start") + s["low"]).alias("low"), (F.col("start") + s["high"] + LENGTH).alias("high"))).alias("spans"))
    # As a set: a row delivered many times has its spans once.
    lists = written(spark, found.groupBy(F.col("doc_id").alias("in_doc"), F.col("key").alias("in_key")).agg(F.flatten(F.collect_set("spans")).alias("found")), "found")
    match = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("key") == F.col("in_key"))
    joined = keyed.join(lists, match, "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


SEVERAL = "a0 != b0 or a1 != b1"


def several(*names: str) -> list:
    """Columns for SEVERAL: whether a group has more than one name."""
    return [f(n).alias(f"{x}{i}") for i, n in enumerate(names) for f, x in ((F.min, "a"), (F.max, "b"))]
