"""Product codes of vectors, learned exactly over anchors-hierarchy metric trees.

Vectors become integers and are cut into equal parts; each part position has a
codebook. Rows are packed, where they lie, into blocks of some thousand vectors,
and each block gets one metric tree for each part position, once:

* Middle-out: about sqrt(n) anchors are placed, each at the point farthest from
  the widest anchor so far. A new anchor takes points from the others; each keeps
  its points by falling distance, and those nearer to it than half the distance
  between the two are not even looked at. Anchors are split again by the same
  rule below, and merged pair by pair, smallest ball first, above.
* A ball caches the sum and number of its points, and its radius.

In a round the root starts with all distinct entries of the codebook. A ball
hands to its children the entries that may be nearest to some point in it; the
list shrinks on the way down. Once one entry is left the ball is wholly owned,
and its cached sum and number go to that entry without a look at its points.
Only points of leaves with several entries left are compared, in whole numbers.
Tasks add up sums and numbers for each entry; Spark adds those up over tasks,
and what reaches the driver is as large as the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import written

SCALE = 1024
LARGEST = 1 << 27  # of a component times SCALE: squared distances then fit a long
BLOCK_BYTES = 1 << 20
LEAF = 24

_TREE = ("order", "first", "n", "kids", "radius", "sums")
_BLOCK = f"ids array<bigint>, points binary, trees array<struct<{', '.join(f'{k}: binary' for k in _TREE)}>>"


# -- trees

class Tree:
    """Balls of one block and part: points `order[first:first + n]`, their sums, a radius, and two children or -1."""

    def __init__(self, order, first, n, kids, radius, sums):
        self.order, self.first, self.n, self.kids, self.radius, self.sums = order, first, n, kids, radius, sums

    def packed(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k in _TREE}

    @staticmethod
    def unpacked(row: dict, dims: int) -> Tree:
        ints = {k: np.frombuffer(row[k], dtype=np.int32) for k in ("order", "first", "n")}
        return Tree(**ints, kids=np.frombuffer(row["kids"], dtype=np.int32).reshape(-1, 2), radius=np.frombuffer(row["radius"], dtype=np.float64),
                    sums=np.frombuffer(row["sums"], dtype=np.int64).reshape(-1, dims))


def anchors(points: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """Cut the points named by `at` into at most `most` groups around anchors; one group if all are equal."""
    def away(rows, pivot):
        return np.sqrt(((points[rows] - points[pivot]) ** 2).sum(axis=1))

    far = away(at, at[0])
    by = np.argsort(-far, kind="stable")
    pivots, owned, reach = [at[0]], [at[by]], [far[by]]
    while len(pivots) < most:
        widest = max(range(len(pivots)), key=lambda a: reach[a][0])
        if reach[widest][0] == 0:
            break
        pivot = owned[widest][0]
        gaps = away(np.array(pivots), pivot)
        won, won_far = [], []
        for a, gap in enumerate(gaps):
            near = np.searchsorted(-reach[a], -gap / 2, side="right")  # the others are nearer to their anchor than half the gap
            if not near:
                continue
            now = away(owned[a][:near], pivot)
            lost = now < reach[a][:near]
            if lost.any():
                won.append(owned[a][:near][lost])
                won_far.append(now[lost])
                stay = np.concatenate((~lost, np.ones(len(owned[a]) - near, dtype=bool)))
                owned[a], reach[a] = owned[a][stay], reach[a][stay]
        rows, far = np.concatenate(won), np.concatenate(won_far)
        by = np.argsort(-far, kind="stable")
        pivots.append(pivot)
        owned.append(rows[by])
        reach.append(far[by])
    return owned


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of all points (whole numbers as float64)."""
    order, first, n, kids, radius, sums = [], [], [], [], [], []

    def ball(rows: np.ndarray) -> tuple:
        total = points[rows].sum(axis=0)
        return rows, total, np.sqrt(((points[rows] - total / len(rows)) ** 2).sum(axis=1).max())

    def grown(rows: np.ndarray) -> tuple:
        """Nested (ball, left, right) of some points."""
        own = ball(rows)
        if len(rows) <= leaf or own[2] == 0:
            return own, None, None
        groups = anchors(points, rows, max(2, int(np.sqrt(len(rows)))))
        return own if len(groups) == 1 else _merged([grown(g) for g in groups])

    def _merged(nodes: list) -> tuple:
        """Join two nodes after another: those whose common ball is smallest."""
        centers = np.array([b[1] / len(b[0]) for b, _, _ in nodes])
        sizes = np.array([len(b[0]) for b, _, _ in nodes], dtype=float)
        radii = np.array([b[2] for b, _, _ in nodes])
        alive = np.ones(len(nodes), dtype=bool)

        def common(i: int) -> np.ndarray:
            """Radius of the ball around node i and each other one, infinite for dead ones and itself."""
            gap = np.sqrt(((centers - centers[i]) ** 2).sum(axis=1))
            out = np.maximum(gap * sizes / (sizes + sizes[i]) + radii[i], gap * sizes[i] / (sizes + sizes[i]) + radii)
            out[~alive] = np.inf
            out[i] = np.inf
            return out

        width = np.array([common(i) for i in range(len(nodes))])
        for _ in range(len(nodes) - 1):
            i, j = sorted(np.unravel_index(np.argmin(width), width.shape))
            left, right = nodes[i], nodes[j]
            nodes[i] = (ball(np.concatenate((left[0][0], right[0][0]))), left, right)
            centers[i], sizes[i], radii[i] = nodes[i][0][1] / len(nodes[i][0][0]), len(nodes[i][0][0]), nodes[i][0][2]
            alive[j] = False
            width[j, :] = width[:, j] = np.inf
            width[i, :] = width[:, i] = common(i)
        return nodes[i] if len(nodes) > 1 else nodes[0]

    # Balls are laid out before their children, points in the order of the leaves.
    stack = [(grown(np.arange(len(points))), None)]
    while stack:
        (own, left, right), slot = stack.pop()
        number = len(n)
        if slot is not None:
            kids[slot[0]][slot[1]] = number
        n.append(len(own[0]))
        kids.append([-1, -1])
        radius.append(own[2])
        sums.append(own[1])
        first.append(len(order))
        if left is None:
            order.extend(own[0].tolist())
        else:
            stack += [(right, (number, 1)), (left, (number, 0))]
    return Tree(np.array(order, dtype=np.int32), np.array(first, dtype=np.int32), np.array(n, dtype=np.int32), np.array(kids, dtype=np.int32).reshape(-1, 2),
                np.array(radius) * (1 + 1e-9), np.array(sums).astype(np.int64).reshape(len(n), -1))


class Codebook:
    """Entries of one part position, with what every ball asks of them."""

    def __init__(self, entries: np.ndarray):
        self.whole, self.real = entries, entries.astype(np.float64)
        self.distinct = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries the lowest index wins every tie
        self.apart = np.sqrt(np.maximum(0, ((self.real[:, None, :] - self.real[None, :, :]) ** 2).sum(axis=2)))
        self.small = np.abs(entries).max(initial=0) < 1 << 21

    def nearest(self, points: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Index of each point's nearest entry, in whole numbers; `among` ascends, so ties go to the lower index."""
        if self.small and np.abs(points).max(initial=0) < 1 << 21:  # products of floats are whole numbers below 2^53 here
            e = self.real[among]
            return among[((e ** 2).sum(axis=1)[None, :] - 2 * (points.astype(np.float64) @ e.T)).argmin(axis=1)]
        return among[((points.astype(np.int64)[:, None, :] - self.whole[among][None, :, :]) ** 2).sum(axis=2).argmin(axis=1)]


def assign(tree: Tree, points: np.ndarray, book: Codebook, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums and numbers of the points of each entry, and with `each` the entry of every point."""
    sums, counts = np.zeros_like(book.whole), np.zeros(len(book.whole), dtype=np.int64)
    codes = np.empty(len(points), dtype=np.int64) if each else None
    stack = [(0, book.distinct)]
    while stack:
        b, among = stack.pop()
        radius, n = tree.radius[b], int(tree.n[b])
        if len(among) > 1:
            gaps = ((book.real[among] - tree.sums[b] / n) ** 2).sum(axis=1)
            best = int(gaps.argmin())
            # The largest value over the ball of (distance to the best)^2 - (distance to the other)^2.
            worst = gaps[best] - gaps + 2 * radius * book.apart[among[best]][among]
            among = among[worst >= -1e-9 * (gaps + gaps[best] + radius * radius + 1)]
        rows = tree.order[tree.first[b]:tree.first[b] + n]
        if len(among) == 1:
            sums[among[0]] += tree.sums[b]
            counts[among[0]] += n
            if each:
                codes[rows] = among[0]
        elif tree.kids[b, 0] >= 0:
            stack += [(int(tree.kids[b, 1]), among), (int(tree.kids[b, 0]), among)]
        elif radius == 0:
            code = book.nearest(points[rows[:1]], among)[0]
            sums[code] += tree.sums[b]
            counts[code] += n
            if each:
                codes[rows] = code
        else:
            inside = points[rows]
            found = book.nearest(inside, among)
            np.add.at(sums, found, inside.astype(np.int64))
            counts += np.bincount(found, minlength=len(counts))
            if each:
                codes[rows] = found
    return sums, counts, codes


# -- Spark

def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE)


def _blocks(kept: DataFrame, dims: int, parts: int) -> DataFrame:
    """Rows packed into blocks with their trees, in the tasks that read them."""
    schema = StructType.fromDDL(_BLOCK).add("labels", kept.select(F.array("label")).schema[0].dataType)
    tree_type = pa.list_(pa.struct([(k, pa.binary()) for k in _TREE]))
    most, cut = max(256, BLOCK_BYTES // (4 * dims)), dims // parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            vectors = rows.column("vector").chunk(0)
            points = _whole(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
            trees = [build(np.ascontiguousarray(points[:, p * cut:(p + 1) * cut])).packed() for p in range(parts)]
            return pa.RecordBatch.from_pydict({"ids": [rows.column("vec_id").to_pylist()], "points": [points.astype(np.int32).tobytes()], "trees": pa.array([trees], tree_type),
                                               "labels": pa.array([rows.column("label").to_pylist()], pa.list_(rows.schema.field("label").type))})

        for batch in batches:
            waiting.append(batch)
            have = pa.Table.from_batches(waiting)
            while have.num_rows >= most:
                yield block(have.slice(0, most))
                have = have.slice(most)
            waiting = have.to_batches()
        if sum(b.num_rows for b in waiting):
            yield block(pa.Table.from_batches(waiting))

    return kept.mapInArrow(pack, schema)


def _unpacked(batch: pa.RecordBatch, dims: int, parts: int) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        points = np.frombuffer(row.column("points")[0].as_py(), dtype=np.int32).reshape(-1, dims)
        yield row, points, [Tree.unpacked(t, dims // parts) for t in row.column("trees")[0].as_py()]


def _round(blocks: DataFrame, books: list[np.ndarray], dims: int, parts: int) -> list[np.ndarray]:
    """Codebooks after one round: entries with points move to their floored mean, the others stay."""
    cut, entries = dims // parts, len(books[0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        sums, counts = np.zeros((parts, entries, cut), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for _, points, trees in _unpacked(batch, dims, parts):
                for p, tree in enumerate(trees):
                    s, c, _ = assign(tree, points[:, p * cut:(p + 1) * cut], ready[p], False)
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": counts[p, e], "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

    found = blocks.select("points", "trees").mapInArrow(add_up, "part int, entry int, n bigint, sums array<bigint>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(cut))).alias("sums"))
    after = [b.copy() for b in books]
    for row in total.collect():  # as many rows as the codebooks have entries
        after[row.part][row.entry] = [int(s) // row.n for s in row.sums]
    return after


def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256,
                 rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, codes (array of entry numbers, one for each part) and error of all codable vectors; and the codebooks.

    Codebooks start as the `entries` vectors with the smallest ids (null ids
    last, equal ids by vector). Dropped are vectors that are null or hold nulls or
    numbers that are not finite; also those of another length than the vector with
    the smallest id, of a length that `parts` does not divide, and with a component
    of 131,072 or more, whose squared distances exceed a long. Repeated rows count
    each time. Without vectors there are no rows and no codebooks. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    out = "vec_id bigint, codes array<int>, error bigint"
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(x.cast("double") * SCALE) < LARGEST) & (F.floor(x.cast("double") * SCALE) >= -LARGEST))
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    kept = kept.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0)).where(sound)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*order).limit(1).select(F.size("vector").alias("dims")).collect()
    schema = StructType.fromDDL(out).add("label", kept.schema["label"].dataType)
    if not first:
        return spark.createDataFrame([], schema), []
    dims = first[0].dims
    kept = kept.where(F.size("vector") == dims)
    start = [r.vector for r in kept.orderBy(*order).limit(entries).select("vector").collect()]
    cut = dims // parts
    whole = _whole(np.array(start)).astype(np.int64)
    books = [np.ascontiguousarray(whole[:, p * cut:(p + 1) * cut]) for p in range(parts)]
    blocks = written(spark, _blocks(kept, dims, parts), "vector-blocks")
    for _ in range(rounds):
        books = _round(blocks, books, dims, parts)
    final = books

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in final]
        for batch in batches:
            for row, points, trees in _unpacked(batch, dims, parts):
                codes, error = np.empty((len(points), parts), dtype=np.int32), np.zeros(len(points), dtype=np.int64)
                for p, tree in enumerate(trees):
                    part = points[:, p * cut:(p + 1) * cut]
                    found = assign(tree, part, ready[p], True)[2]
                    codes[:, p] = found
                    error += ((part.astype(np.int64) - final[p][found]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([row.column("ids")[0].values, pa.array(list(codes), pa.list_(pa.int32())), pa.array(error), row.column("labels")[0].values],
                                                 names=["vec_id", "codes", "error", "label"])

    return blocks.mapInArrow(code, schema), final


def hex_codes(codes: str):
    """Two hexadecimal digits for each part."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")), "")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
