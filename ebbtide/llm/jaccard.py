"""Similarity join on word n-grams: MinHash bands propose, full n-gram sets decide.

1. Documents with the same n-gram set are one class. A class has a MinHash
   signature, cut into bands; how many follows from the rows of a band and the
   recall wanted for pairs just at the threshold.
2. Bands are shuffled by (band, hash). A bucket links its members to its
   smallest one, reduced in each task first; connected classes form a pool.
3. The n-gram set of a class in a pool is shuffled once. Pools are verified in
   blocks of bounded size: a pool of k blocks makes k (k + 1) / 2 block pairs,
   each a task's work of its own. All pairs inside a block pair are compared,
   and counted where they are found, so pairs are never rows: what leaves a
   block pair is each class's number of links and the smallest class they lead to.
4. Pools of more than one block are joined into groups by connected components
   over these verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bitmap_of, in_bitmap, shingles, text_key, word_hashes, written
from .components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.999
BAND_ROWS = 5
BLOCK_SHINGLES = 500_000   # n-grams of a verification block, on average
BLOCK_CLASSES = 1000       # classes of a verification block, on average
COMMON = 32                # an n-gram in more classes of a block pair than this is counted by matrix product


def band_count(threshold: float, rows: int, recall: float) -> int:
    """Bands so that a pair at the threshold shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def signature(grams: np.ndarray, hashes: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 2**64, hashes, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**64, hashes, dtype=np.uint64)
    out = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at:at + 2048]
        out = np.minimum(out, (mult[:, None] * part[None, :] + add[:, None]).min(axis=1))
    return out


def _signed(n: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, keys, sizes = [], [], []
            for text in batch.column("text"):
                grams = shingles(word_hashes(text.as_py() or b""), n)
                sizes.append(len(grams))
                classes.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                keys.append(signature(grams, rows * bands).reshape(bands, rows) if len(grams) else None)
            packed = [None if k is None else [xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) - 2**63 for i, b in enumerate(k)] for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()),
                                              pa.array(packed, pa.list_(pa.int64()))], names=["doc_id", "key", "class", "size", "bands"])
    return run


def _sets(n: int, sent):
    """The n-gram sets of rows that may be heads of a pool's classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(in_bitmap(sent.value, batch.column("ident").to_numpy()))
            grams = [shingles(word_hashes(batch.column("text")[int(k)].as_py() or b""), n).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), batch.column("key").take(pa.array(some)), pa.array(grams, pa.binary())],
                                             names=["doc_id", "key", "grams"])
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets (of one list with itself)."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    grams = np.concatenate(both)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    counts = np.diff(np.r_[starts, len(grams)])
    out = np.zeros((len(both), len(both)), dtype=np.float32)
    for size in np.unique(counts[(counts > 1) & (counts <= COMMON)]):
        members = owner[starts[counts == size][:, None] + np.arange(size)[None, :]]
        for i in range(size):
            for j in range(i + 1, size):  # members are in order: counted once, above the diagonal
                np.add.at(out, (members[:, i], members[:, j]), 1)
    common = np.flatnonzero(counts > COMMON)
    for at in range(0, len(common), 2048):
        some = common[at:at + 2048]
        grid = np.zeros((len(both), len(some)), dtype=np.float32)
        for k, g in enumerate(some):
            grid[owner[starts[g]:starts[g] + counts[g]], k] = 1
        out += np.triu(grid @ grid.T, 1)
    return out[:len(left), len(left):] if right is not None else out


def verified(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a Jaccard similarity of at least the threshold."""
    common = overlaps(left, right)
    a, b = np.array([len(x) for x in left], dtype=np.float64), np.array([len(x) for x in (left if right is None else right)], dtype=np.float64)
    union = a[:, None] + b[None, :] - common
    return np.nonzero((common > 0) & (common >= threshold * union - 1e-9))


def local_roots(a: np.ndarray, b: np.ndarray, classes: list[bytes]) -> dict[int, bytes]:
    """For every linked index the smallest class that links inside the block pair lead to."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    least: dict[int, bytes] = {}
    for x in list(root):
        least[top(x)] = min(least.get(top(x), classes[x]), classes[x])
    return {x: least[top(x)] for x in root}


def _verify(threshold: float):
    """Of one block pair: its classes' link counts, and links enough to connect what is linked."""
    def run(held: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in held.column("grams").to_pylist()]
        classes, copies, side = held.column("class").to_pylist(), held.column("n").to_numpy(), held.column("side").to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(two):
            i, j = verified([sets[k] for k in one], [sets[k] for k in two], threshold) if len(one) else (one, one)
            i, j = one[i], two[j]
        elif held.column("i")[0].as_py() == held.column("j")[0].as_py():
            i, j = verified(sets, None, threshold)
        else:
            i = j = np.empty(0, dtype=np.int64)
        links = np.zeros(len(sets), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        roots = local_roots(i, j, classes)
        some = sorted(roots)
        return pa.table({"class": pa.array([classes[k] for k in some], pa.binary()), "links": pa.array(links[some] if some else [], pa.int64()),
                         "near": pa.array([roots[k] for k in some], pa.binary()), "whole": pa.array([held.column("cuts")[0].as_py() == 1] * len(some), pa.bool_())})
    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
                    rows: int = BAND_ROWS, block_shingles: int = BLOCK_SHINGLES, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """doc_id, key, class_id, group_id, group_size, n_links for every document.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A
    text of fewer than n words is one n-gram; a text without words (null, empty)
    is linked to nothing and is a group of its own. class_id is the smallest id
    with the same n-gram set, group_id the smallest id that links lead to,
    n_links the number of other documents with a similarity of at least the
    threshold, copies included. Rows equal in id and text are one document.
    Null ids come before all others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bands = band_count(threshold, rows, recall)
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    signed = written(spark, keyed.mapInArrow(_signed(n, rows, bands), "doc_id bigint, key bigint, class binary, size int, bands array<bigint>"), "signatures")
    documents = signed.dropDuplicates(["doc_id", "key"])
    classes = written(spark, documents.where("class is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "key")).alias("head"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"),
        F.first("bands").alias("bands")), "classes")

    buckets = classes.select("class", F.posexplode("bands").alias("band", "hash"))
    firsts = buckets.groupBy("band", "hash").agg(F.min("class").alias("b"), F.max("class").alias("last")).where("b != last").select("band", "hash", "b")
    edges = buckets.join(firsts, ["band", "hash"]).select(F.col("class").alias("a"), "b").where("a != b")
    pools = components(edges).withColumnRenamed("node", "class")

    pooled = written(spark, pools.join(classes.select("class", "n", "size", "head"), "class"), "pools")
    cuts = pooled.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / block_shingles), F.ceil(F.count(F.lit(1)) / block_classes)).alias("cuts"))
    placed = pooled.join(cuts, "root").withColumn("cut", F.pmod(F.xxhash64("class"), "cuts"))
    heads = written(spark, placed.select("class", "root", "n", "cuts", "cut", F.col("head.doc_id").alias("head_id"), F.col("head.key").alias("head_key")), "pool-heads")
    # Texts are not shuffled for this: a bitmap of fixed size passes all heads, and few other rows.
    ident = F.xxhash64("doc_id", "key").alias("ident")
    sent = spark.sparkContext.broadcast(bitmap_of(heads.select(F.xxhash64("head_id", "head_key").alias("ident")), "ident"))
    passed = keyed.select("doc_id", "key", ident, "text").mapInArrow(_sets(n, sent), "doc_id bigint, key bigint, grams binary")
    match = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head_key"))
    sets = heads.join(passed, match).dropDuplicates(["class"])
    # Block pair (i, j), i <= j: block i is its first side, block j its second.
    pairs = sets.select("root", "class", "n", "grams", "cut", "cuts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("other")).select(
        "root", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "class", "n", "grams", "cuts", (F.col("cut") > F.col("other")).cast("int").alias("side"))
    found = written(spark, pairs.groupBy("root", "i", "j").applyInArrow(_verify(threshold), "class binary, links bigint, near binary, whole boolean"), "links")

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    # A pool of one block was connected in its task; larger ones are connected over their local roots.
    apart = components(found.where("not whole").select(F.col("class").alias("a"), F.col("near").alias("b")))
    groups = apart.withColumnRenamed("node", "class").unionByName(found.where("whole").select("class", F.col("near").alias("root")))
    named = (classes.select("class", "class_id", "n").join(groups, "class", "left").join(links, "class", "left")
             .select("class", "class_id", "n", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    named = written(spark, named, "near-classes")
    sizes = named.groupBy("root").agg(F.min("class_id").alias("group_id"), F.sum("n").alias("group_size"))
    full = named.join(sizes, "root").select("class", "class_id", "group_id", "group_size", (F.col("n") - 1 + F.col("links")).alias("n_links"))
    out = signed.select("doc_id", "key", "class").join(full, "class", "left")
    alone = F.col("class").isNull()
    return out.select("doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, the one with the smallest id, and rows without words; same columns.

    Of rows of one group that share this id the one with the smallest hash of its text
    stays. Rows equal in all columns are one row, whether they have words or not;
    rows equal in id and text that differ elsewhere stay or go together.
    """
    found = written(docs.sparkSession, near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "groups")
    heads = found.where("group_size > 1 and doc_id <=> group_id").groupBy("group_id").agg(F.min("key").alias("head_key"))
    here = found.where("group_size > 1").join(heads.withColumnRenamed("group_id", "head_id"), F.col("group_id").eqNullSafe(F.col("head_id")))
    gone = here.where("not (doc_id <=> group_id) or key != head_key").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"))
    match = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    kept = rows.join(gone, match, "left_anti")
    # Only keys that are there more than once are compared in full; the others pass with their hash alone.
    again = kept.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key"))
    again = written(docs.sparkSession, again, "repeated-rows")
    if again.isEmpty():
        return kept.select("row.*")
    twice = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key"))
    once = kept.join(again, twice, "left_anti").select("row.*")
    return once.unionByName(kept.join(again, twice, "left_semi").select("row.*").dropDuplicates())
