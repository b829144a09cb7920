"""Repeated passages of several lines, found by windows of two lines.

Every two lines that follow each other (blank lines between them included) are a
candidate, named by a digest. A window whose bytes occur elsewhere in the corpus is
kept at its first place (smallest document, then position) and removed at all
others. A run of lines that two places share is the union of its windows, so it
goes line by line to both of its ends, however unlike its neighbours are.

Digests alone are shuffled over the whole corpus. Only documents with a repeated
digest get a list of candidates, and only the bytes of candidates are then compared
with the bytes at the first place, before anything is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import extended, rest_of, row_again, text_key, written

SPAN = 2        # lines whose hash chooses a candidate
DIVISOR = 1     # one window in so many is a candidate; only 1 finds every repeated run
LEAST_LINES = 2  # lines of a window, blank ones not counted


def pieces(data: bytes, span: int, divisor: int, least: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, first line, lines, bytes) of every candidate; windows overlap, and blank lines neither begin nor end one."""
    lines = data.split(b"\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for number, (start, last) in enumerate(zip(filled, filled[least - 1:], strict=False)):
        if divisor == 1 or xxhash.xxh3_64_intdigest(b"\n".join(lines[start:start + span])) % divisor == 0:
            yield number, start, last + 1 - start, b"\n".join(lines[start:last + 1])


def repeated_lines(data: bytes, hits: list[dict], span: int, divisor: int, least: int) -> set[int]:
    """Lines of the windows that have their first place elsewhere. A window that overlaps its own first place takes none of it."""
    at = {number: (start, start + count) for number, start, count, _ in pieces(data, span, divisor, least)}
    first = {h["digest"]: at[h["number"]] for h in hits if h["owner"]}
    gone: set[int] = set()
    for h in hits:
        if not h["owner"]:
            gone.update(set(range(*at[h["number"]])) - set(range(*first.get(h["digest"], (0, 0)))))
    return gone


def _digests(span: int, divisor: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, numbers, digests = [], [], [], []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                for number, _, _, body in pieces(text.as_py() or b"", span, divisor, least):
                    ids.append(doc)
                    keys.append(key)
                    numbers.append(number)
                    digests.append(xxhash.xxh3_128_digest(body))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())],
                                             names=["doc_id", "key", "number", "digest"])
    return run


def _bodies(span: int, divisor: int, least: int):
    """The bytes of listed windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "key": [], "number": [], "digest": [], "body": []}
            for doc, key, hits, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("hits"), batch.column("text"), strict=True):
                wanted = {h["number"]: h["digest"] for h in hits.as_py()}
                for number, _, _, body in pieces(text.as_py() or b"", span, divisor, least):
                    if number in wanted:
                        for name, value in zip(out, (doc, key, number, wanted[number], body), strict=True):
                            out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
    return run


def _removed(span: int, divisor: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_out, n_chunks = [], [], [], []
            for hits, text in zip(batch.column("hits"), batch.column("text"), strict=True):
                data, gone = text.as_py(), {h["number"] for h in hits.as_py() or () if not h["owner"]}
                lines = (data or b"").split(b"\n")
                out = repeated_lines(data, hits.as_py(), span, divisor, least) if gone else ()
                if out:
                    data = b"\n".join(x for i, x in enumerate(lines) if i not in out)
                texts.append(None if data is None else data.decode("utf-8"))
                n_lines.append(len(lines))
                n_out.append(len(out))
                n_chunks.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_out, pa.int64()),
                                              pa.array(n_chunks, pa.int64())], names=["rest", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])
    return run


def without_repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, divisor: int = DIVISOR,
                            least_lines: int = LEAST_LINES) -> DataFrame:
    """Each row of docs as struct `row`, its text replaced by what is left of it, and the counts.

    Columns: row, n_lines, n_removed_lines, n_removed_chunks (windows with their
    first place elsewhere). A null text stays null and has one line, as an empty
    one has. Single lines are never removed, nor blank ones outside a window. Ties
    between equal windows of one document go to the first. The first place of a
    line always stays; where a passage runs on from a repeat into new lines, only
    the repeat goes. Rows equal in id and text count as one document: both keep or
    both lose a line. Null ids come before all others. Empty tables give no rows.
    """
    spark, how = docs.sparkSession, (span, divisor, least_lines)
    place = F.struct("doc_id", "key", "number")
    keyed = docs.select(rest_of(docs, text_col).alias("rest"), F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                        F.col(text_col).cast("binary").alias("text"))
    seen = written(spark, keyed.select("doc_id", "key", "text").mapInArrow(_digests(*how), "doc_id bigint, key bigint, number int, digest binary"), "chunk-digests")
    repeated = seen.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    hits = seen.join(repeated.select("digest", "first"), "digest").select("doc_id", "key", "number", "digest", (place == F.col("first")).alias("owner"))

    listed = written(spark, keyed.transform(_with_hits, hits), "chunk-docs")
    bodies = listed.where("hits is not null").select("doc_id", "key", "hits", "text").mapInArrow(
        _bodies(*how), "doc_id bigint, key bigint, number int, digest binary, body binary")
    # Grouping by the bytes compares them in full; equal ones are reduced in each task first.
    same = bodies.groupBy("digest", "body").agg(F.min(place).alias("first"))
    unlike = written(spark, same.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "chunk-unlike")
    if not unlike.isEmpty():  # different bytes under one digest: the bytes decide
        exact = bodies.join(unlike, "digest").join(same, ["digest", "body"]).select("doc_id", "key", "number", "digest", (place == F.col("first")).alias("owner"))
        hits = hits.join(unlike, "digest", "left_anti").unionByName(exact)
        listed = keyed.transform(_with_hits, hits)
    rest_type = listed.select("rest").schema
    done = listed.select("rest", "text", "hits").mapInArrow(
        _removed(*how), extended(rest_type, "text string, n_lines bigint, n_removed_lines bigint, n_removed_chunks bigint"))
    return done.select(row_again(docs, text_col), "n_lines", "n_removed_lines", "n_removed_chunks")


def _with_hits(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """Each document with the list of its repeated windows: no longer than the document."""
    lists = hits.groupBy(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key")).agg(F.collect_set(F.struct("number", "digest", "owner")).alias("hits"))
    match = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("key") == F.col("hit_key"))
    return keyed.join(lists, match, "left").select("rest", "doc_id", "key", "hits", "text")
