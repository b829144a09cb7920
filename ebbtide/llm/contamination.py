"""Benchmark decontamination by a multi-pattern search of the Wu-Manber kind.

The patterns are windows of benchmark words. For each pattern length m a shift
table says, for every block of two words that occurs in a pattern, how far the
nearest pattern end can be; a block in no pattern lets the search jump m - 1
words at once. Where the shift is 0 the block is the end of some pattern: the
bucket of that suffix is looked up and its windows are compared word by word.

Benchmarks are read in blocks of bounded size. Each block is broadcast and adds
its findings to every document in the same row, so no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import rest_of, row_again, words_of

WINDOW = 10
BLOCK_BYTES = 1 << 20  # of benchmark text broadcast at once; items are never cut


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    block, size = [], 0
    for item, text in items.select(F.col(id_col), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, bytes(text)))
        size += len(text)
    if block:
        yield block


def search_tables(items: list[tuple[int | None, bytes]], window: int) -> list[tuple[int, int, dict, dict]]:
    """For each pattern length: (length, block size, shifts, buckets by suffix block)."""
    found: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            found.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set()).add(item)
    groups = []
    for m, windows in sorted(found.items()):
        size = min(2, m)
        shifts: dict[tuple, int] = {}
        buckets: dict[tuple, list] = {}
        for words, owners in windows.items():
            for end in range(size, m + 1):
                block = words[end - size:end]
                shifts[block] = min(shifts.get(block, m), m - end)
            buckets.setdefault(words[-size:], []).append((list(words), sorted(owners, key=lambda x: (x is None, x or 0))))
        groups.append((m, size, shifts, buckets))
    return groups


def find_windows(words: list[bytes], groups: list) -> tuple[list[int], set]:
    """Merged [start, end, start, end ...] of words inside occurrences, and the items met."""
    spans: list[tuple[int, int]] = []
    owners: set = set()
    n = len(words)
    for m, size, shifts, buckets in groups:
        if m > n:
            continue
        jump, at = m - size + 1, m - 1
        while at < n:
            block = (words[at - 1], words[at]) if size == 2 else (words[at],)
            shift = shifts.get(block, jump)
            if shift:
                at += shift
                continue
            piece = words[at - m + 1:at + 1]
            for pattern, items in buckets[block]:
                if pattern == piece:
                    spans.append((at - m + 1, at + 1))
                    owners.update(items)
            at += 1
    return merged(spans), owners


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """Each row of docs as struct `row`, with n_words, spans and items (sorted ids).

    spans lists starts and ends (exclusive) of maximal hit runs, as word numbers.
    Null and wordless texts have no words and no hits. An item without words
    matches nothing; an item whose id is null marks words but is not listed.
    Repeated items count once, repeated documents each get their row; empty
    tables of either kind are fine. `with_text=False` leaves the text out of row.
    """
    context = docs.sparkSession.sparkContext
    frame = docs.select(rest_of(docs, text_col).alias("rest"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                        F.array().cast("array<int>").alias("spans"), F.array().cast("array<bigint>").alias("items"))
    blocks = [context.broadcast(b) for b in item_blocks(items, item_id, item_text, block_bytes)] or [context.broadcast([])]
    for block in blocks:
        keep = with_text or block is not blocks[-1]
        names = ["rest", *["text"] * keep, "n_words", "spans", "items"]
        frame = frame.mapInArrow(_finder(block, window, keep), StructType([frame.schema[n] for n in names]))
    row = row_again(docs, text_col) if with_text else F.col("rest").alias("row")
    return frame.select(row, "n_words", "spans", "items")


def _finder(block, window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = search_tables(block.value, window)
        for batch in batches:
            n_words, all_spans, all_items = [], [], []
            for text, spans, items in zip(batch.column("text"), batch.column("spans"), batch.column("items"), strict=True):
                words = words_of(text.as_py() or b"")
                found, owners = find_windows(words, groups)
                old = spans.as_py() or []
                n_words.append(len(words))
                all_spans.append(merged([*zip(old[::2], old[1::2]), *zip(found[::2], found[1::2])]))
                all_items.append(sorted({*(items.as_py() or []), *(x for x in owners if x is not None)}))
            columns = {"rest": batch.column("rest")} | ({"text": batch.column("text")} if with_text else {}) | {
                "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(all_spans, pa.list_(pa.int32())), "items": pa.array(all_items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def hit_words(spans="spans"):
    """Number of words inside the spans."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: (F.get(spans, i + 1) - F.get(spans, i)).cast("bigint"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x))


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs; same columns."""
    return contamination(docs, items, **options).where(F.size("spans") == 0).select("row.*")
