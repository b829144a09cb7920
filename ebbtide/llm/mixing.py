"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight w = parts / total has its j-th block (from 0) released at
floor(j / w) and due at ceil((j + 1) / w). One block is read in each slot:
among the released blocks the one with the earliest deadline. Then the blocks
that a source has had by slot t differ from t * w by less than one, as long as
no source has run out. Windows repeat every `total` slots, so one period is
scheduled, from the weights alone, and every block finds its slot by a join:
slot = period * total + place in the period.

Rows are dealt to blocks without a window over a whole source: each source is
cut into chunks by a hash of the row, with about CHUNK_ROWS rows in each, chunk
sizes are summed up in a small table, and rows are numbered inside chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
CHUNK_ROWS = 4096
PARTS = 1000


def sqrt_weights(docs: DataFrame, source_col: str = "source", parts: int = PARTS) -> DataFrame:
    """source, parts: each source in proportion to the square root of its rows, at least one part."""
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.sqrt(F.count(F.lit(1))).alias("root"))
    total = counts.agg(F.sum("root").alias("total"))
    return counts.join(total, F.lit(True)).select("source", F.greatest(F.lit(1), F.round(parts * F.col("root") / F.col("total"))).cast("bigint").alias("parts"))


def period(weights: DataFrame) -> DataFrame:
    """source, nth, place, parts, total: the slots of one period, earliest deadline first.

    The weights table holds one row per source; it is the only thing gathered
    in one row, and its period has sum(parts) slots. Ties of deadlines go to
    the source that comes first by name.
    """
    one = weights.where("parts > 0").agg(F.array_sort(F.collect_list(F.struct("source", "parts"))).alias("s"))
    one = one.withColumn("total", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["parts"]))

    def slot(state, t):
        # The next block of each source, if it is released and in this period: (deadline, source number).
        ready = F.transform("s", lambda x, i: F.when(
            (F.get(state["had"], i) < x["parts"]) & (F.floor(F.get(state["had"], i) * F.col("total") / x["parts"]) <= t),
            F.struct(F.ceil((F.get(state["had"], i) + 1) * F.col("total") / x["parts"]).alias("due"), i.alias("i"))))
        first = F.array_min(F.filter(ready, lambda r: r.isNotNull()))["i"]
        return F.struct(F.transform(state["had"], lambda n, i: F.when(i == first, n + 1).otherwise(n)).alias("had"),
                        F.array_append(state["order"], first).alias("order"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("bigint")).alias("had"), F.array().cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1), start, slot, lambda state: state["order"])
    slots = one.where("total > 0").select("s", "total", F.posexplode(order).alias("place", "i"))
    slots = slots.select(F.get("s", F.col("i"))["source"].alias("source"), F.get("s", F.col("i"))["parts"].alias("parts"), "total", "place")
    return slots.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("place")) - 1)


def blocks(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of docs as struct `row`, with source, rank in the source and block number."""
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                        F.xxhash64(F.lit("mix"), id_col).alias("h"), F.xxhash64(*docs.columns).alias("tie"))
    total = keyed.agg((F.floor(F.count(F.lit(1)) / chunk_rows) + 1).alias("chunks"))
    sizes = keyed.join(total, F.lit(True)).groupBy("source", F.pmod("h", "chunks").alias("chunk")).count()
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = keyed.join(total, F.lit(True)).withColumn("chunk", F.pmod("h", "chunks")).join(offsets, ["source", "chunk"])
    inside = Window.partitionBy("source", "chunk").orderBy("h", f"row.{id_col}", "tie")
    rank = (F.col("offset") + F.row_number().over(inside) - 1).alias("rank")
    return placed.select("row", "source", rank).withColumn("block", F.floor(F.col("rank") / block_rows))


def mixed_order(docs: DataFrame, weights: DataFrame | None = None, *, source_col: str = "source", id_col: str = "doc_id",
                block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All rows of docs as struct `row`, with source, block, slot, released, due and place.

    Reading by slot, then place, interleaves the sources. A null source is the
    source with the empty name. Sources without weight, and all rows if the
    weights are empty, come after the others, in the order of their blocks
    (slot null). Once a source has run out its slots stay unused and the
    others go on. Equal ids are ordered by a hash of the row; equal rows are
    interchangeable.
    """
    weights = sqrt_weights(docs, source_col) if weights is None else weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("parts").cast("bigint"))
    dealt = blocks(docs, source_col=source_col, id_col=id_col, block_rows=block_rows, chunk_rows=chunk_rows)
    slots = period(weights)
    quota = slots.select("source", "parts", "total").distinct()
    lap = F.floor(F.col("block") / F.col("parts"))
    out = (dealt.join(quota, "source", "left").withColumn("nth", (F.col("block") % F.col("parts")).cast("int"))
           .join(slots.select("source", "nth", F.col("place").alias("at")), ["source", "nth"], "left"))
    return out.select("row", "source", "block", (lap * F.col("total") + F.col("at")).alias("slot"),
                      F.floor(F.col("block") * F.col("total") / F.col("parts")).alias("released"),
                      F.ceil((F.col("block") + 1) * F.col("total") / F.col("parts")).alias("due"),
                      (F.col("rank") % block_rows).alias("place"))
