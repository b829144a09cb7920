"""Prefix trie of conversations by fixed-length block hashing.

Turns are reduced to a digest and a length before anything moves. Each
conversation is cut into blocks of BLOCK_TURNS turns, and a block gets a digest
of its turns. What comes before a block is a running sum of its block hashes
(two sums of 62-bit numbers, each hashed with the block's number), so a
conversation of any length is scanned in chunks and no list of its turns is
ever built.

1. Conversations are grouped by (blocks before, block). Copies, however many,
   are one row from then on: a block with its members' number and smallest id.
2. Blocks that follow the same blocks are siblings. A block without siblings
   has only turn boundaries with the same members: it is spelled out as it
   stands. Where siblings diverge, and only there, their turn prefixes are
   grouped again.
3. A node belongs to its smallest member. A conversation owns the nodes of its
   path from some depth on, down to its end, so sums over a subtree are sums
   over its members of what each of them owns: no walk over levels, whatever
   the depth of the trie.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written

BLOCK_TURNS = 8
CHUNK_BLOCKS = 512
PIECE_IDS = 1 << 16

_BLOCK = ["k", "before", "digest"]


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256, as hex."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0, by turn, null first), digest of role and text, bytes of the text.

    Turns of one number are ordered by digest; rows without conv_id belong to no
    conversation. Rows are placed by ranges of (conv_id, turn), so that a
    conversation with most of all rows is numbered by many tasks.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = conversations.where("conv_id is not null").select(
        "conv_id", "turn", _digest(F.octet_length(role).cast("string"), role, text).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = small.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    dealt = written(conversations.sparkSession, dealt, "turns")
    sizes = dealt.groupBy("part", "conv_id").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "conv_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1)
    return inside.join(offsets, ["part", "conv_id"]).select("conv_id", (F.col("offset") + F.col("nth")).alias("i"), "digest", "n_bytes")


def spliced(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, i, digest, n_bytes) and all conversations (conv_id).

    Conversation c starts with the first h turns of conversation c - c % family
    (all if fewer, none if absent), h = crc32(c) % most, and goes on with its own
    turns after its first h. A conversation may end up without turns.
    """
    sizes = turns.groupBy("conv_id").agg((F.max("i") + 1).alias("n"))
    plan = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n")), "head", "left")
    plan = plan.withColumn("front", F.least("h", F.coalesce("head_n", F.lit(0))))
    own = turns.join(plan.select("conv_id", "h", "front"), "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("front")).alias("i"), "digest", "n_bytes")
    first = turns.where(F.col("i") < most - 1).withColumnRenamed("conv_id", "head")
    heads = first.join(plan.select("conv_id", "h", "head"), "head").where("i < h").select("conv_id", "i", "digest", "n_bytes")
    return own.unionByName(heads), sizes.select("conv_id")


def _blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """A row for each block: what comes before and after it, its turns, and the length of the whole conversation."""
    packed = turns.groupBy("conv_id", F.floor(F.col("i") / block_turns).alias("k")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "n_bytes"))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    hashed = packed.select("conv_id", "k", F.transform("turns", lambda t: F.struct(t["digest"], t["n_bytes"])).alias("turns"), _digest(joined).alias("digest"),
                           F.floor(F.col("k") / CHUNK_BLOCKS).alias("chunk"))
    hashed = hashed.select("*", F.size("turns").cast("bigint").alias("len"), F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["n_bytes"]).alias("bytes"),
                           *(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k", "digest"), 2).cast("decimal(20,0)").alias(name) for name, seed in (("x", 1), ("y", 2))))
    summed = ["x", "y", "bytes", "len"]
    chunks = hashed.groupBy("conv_id", "chunk").agg(*(F.sum(c).alias(c) for c in summed))
    whole, earlier = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("conv_id", "chunk", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in summed[:3]),
                            F.sum("len").over(whole).alias("all_turns"), F.sum("bytes").over(whole).alias("all_bytes"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    scanned = hashed.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}1") for c in summed[:3])).join(offsets, ["conv_id", "chunk"])
    x, y = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    return scanned.select("conv_id", "k", "turns", "digest", "len", _path(F.col("k"), x, y).alias("before"), _path(F.col("k") + 1, x + F.col("x"), y + F.col("y")).alias("after"),
                          (F.col("bytes0") + F.col("bytes1")).alias("bytes_before"), "all_turns", "all_bytes")


def _path(k: Column, x: Column, y: Column) -> Column:
    """Key of the path over the first k blocks; of the root if k is 0."""
    return _digest(F.lit("blocks"), k.cast("string"), x.cast("string"), y.cast("string"))


def _root() -> Column:
    return _path(F.lit(0), F.lit(0), F.lit(0))


def _node(n: Column, block_turns: int, prefix: Column) -> Column:
    """Key of the node of the first n turns of a block, a block's last one being the path after it."""
    return F.when(n == block_turns, F.col("after")).otherwise(_digest(F.lit("turns"), "before", n.cast("string"), prefix))


def _nodes(groups: DataFrame, sums: list[str], block_turns: int) -> DataFrame:
    """One row for each node but the root, from blocks; siblings' turn prefixes are grouped, other blocks spelled out."""
    prefix = lambda n: _digest(F.array_join(F.transform(F.slice("turns", 1, n), lambda t: t["digest"]), ""))
    key = lambda n: F.when(n == 0, F.col("before")).otherwise(_node(n, block_turns, prefix(n)))
    steps = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda n: F.struct(
        key(n).alias("node"), key(n - 1).alias("parent"), (F.col("k") * block_turns + n).alias("depth"), F.element_at("turns", n)["n_bytes"].alias("n_bytes"),
        (F.col("bytes_before") + F.aggregate(F.slice("turns", 1, n), F.lit(0).cast("bigint"), lambda a, t: a + t["n_bytes"])).alias("path_bytes")))
    about = ["parent", "depth", "n_bytes", "path_bytes"]
    spelled = groups.select("siblings", "owner", *sums, F.explode(steps).alias("s")).select("siblings", "s.*", "owner", *sums)
    alone = spelled.where("not siblings").select("node", *about, "owner", *sums)
    refined = spelled.where("siblings").groupBy("node").agg(*(F.min(c).alias(c) for c in [*about, "owner"]), *(F.sum(c).alias(c) for c in sums))
    return alone.unionByName(refined)


def _ends(spark, ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of ids in ascending order, fed piece by piece; a piece has PIECE_IDS ids at most."""

    def pieces(batches):
        node, ids, nth = None, [], 0
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or len(ids) == PIECE_IDS:
                    if ids:
                        yield pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "text": [",".join(map(str, ids))]})
                    node, ids = n, []
                ids.append(c)
        if ids:
            yield pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "text": [",".join(map(str, ids))]})

    def hashed(batches):
        node, state, done, values = None, None, [], []
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != node:
                    if state is not None:
                        done.append(node)
                        values.append(state.hexdigest())
                    node, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if len(done) > 4096:
                yield pa.RecordBatch.from_pydict({"node": done, "ends_sha256": values})
                done, values = [], []
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": [*done, node], "ends_sha256": [*values, state.hexdigest()]})

    cut = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node string, first bigint, text string")
    cut = written(spark, cut, "ends")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of turns (conv_id, i, digest, n_bytes), over the distinct ids of convs.

    One row for each node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations without
    turns are members of the root only; without any conversation there is no
    node. Conversations equal in all turns share all nodes; equal turns of one
    conversation stay apart by their place.
    """
    spark = turns.sparkSession
    blocks = written(spark, _blocks(turns, block_turns), "blocks")
    some = blocks.groupBy("conv_id").agg(F.max("all_bytes").alias("all_bytes"))
    everyone = written(spark, convs.join(some, "conv_id", "left").select("conv_id", F.coalesce("all_bytes", F.lit(0)).alias("all_bytes")), "convs")

    about = ["turns", "after", "bytes_before"]
    groups = blocks.groupBy(*_BLOCK).agg(*(F.first(c).alias(c) for c in about), F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
    groups = written(spark, groups, "groups")
    branched = groups.groupBy("before").count().where("count > 1").select("before", F.lit(True).alias("siblings"))
    groups = groups.join(branched, "before", "left").withColumn("siblings", F.coalesce("siblings", F.lit(False)))
    groups = written(spark, groups, "siblings")

    # Who owns what: of each owner its first node, the one above it, and its last node.
    root = everyone.groupBy().agg(F.min("conv_id").alias("owner")).where("owner is not null").select(
        _root().alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("path_bytes"), "owner")
    owned = written(spark, _nodes(groups, [], block_turns).unionByName(root), "owned")
    children = owned.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    at = F.struct("depth", "node", "parent", "n_bytes", "path_bytes")
    owners = owned.groupBy(F.col("owner").alias("conv_id")).agg(F.min(at).alias("top"), F.max(at).alias("end"))
    owners = owners.select("conv_id", F.col("top.depth").alias("from_depth"), F.col("top.parent").alias("parent"), F.col("end.node").alias("node"),
                           F.col("end.path_bytes").alias("all"), (F.col("end.path_bytes") - F.col("top.path_bytes") + F.col("top.n_bytes")).alias("own_bytes"))
    owners = owners.join(children, "node", "left").withColumn("leaf", F.col("n_children").isNull().cast("bigint")).drop("node", "n_children")
    owners = owners.join(owned.select(F.col("node").alias("parent"), F.col("owner").alias("above")), "parent", "left").drop("parent")
    owners = written(spark, owners, "owners")

    # The same nodes with sums over members.
    sums = ["n_convs", "all_bytes", "own_bytes", "leaves"]
    member = everyone.join(owners.select("conv_id", "own_bytes", F.col("leaf").alias("leaves")), "conv_id", "left").na.fill(0)
    member = written(spark, member, "members")
    weighed = blocks.select(*_BLOCK, "conv_id").join(member, "conv_id").groupBy(*_BLOCK).agg(*(F.sum(c).alias(c) for c in sums[1:]))
    nodes = _nodes(groups.join(weighed, _BLOCK), sums, block_turns)
    totals = member.agg(F.count(F.lit(1)).alias("n_convs"), *(F.sum(c).alias(c) for c in sums[1:])).withColumn("node", _root())
    nodes = nodes.unionByName(root.join(totals, "node"))

    last = blocks.where(F.col("k") * block_turns + F.col("len") == F.col("all_turns")).select(_node(F.col("len"), block_turns, F.col("digest")).alias("node"), "conv_id")
    empty = convs.join(some, "conv_id", "left_anti").select(_root().alias("node"), "conv_id")
    ends = _ends(spark, last.unionByName(empty))

    above = F.col("path_bytes") - F.col("n_bytes")
    distinct = F.col("own_bytes") - F.col("o.own_bytes") + F.col("o.all") - above
    full = nodes.withColumnRenamed("owner", "conv_id").join(owners.select("conv_id", F.struct("from_depth", "own_bytes", "all", "above").alias("o")), "conv_id")
    full = full.join(children, "node", "left").join(ends, "node", "left")
    return full.select("conv_id", "depth", F.when(F.col("depth") == F.col("o.from_depth"), F.col("o.above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                       "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
                       (F.col("all_bytes") - F.col("n_convs") * above - distinct).cast("bigint").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
