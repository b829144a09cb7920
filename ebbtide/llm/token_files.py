"""Token ids in binary files of compressed bit or byte planes.

Documents are dealt to files by ranges of their id and encoded in id order. A
file is written by one task as it goes: ids gather until a block of BLOCK_IDS is
full, the block is transposed into planes (plane p holds byte p, or bit p, of
all its ids), and each plane is compressed by zstandard on its own. The planes
of high bits are nearly constant and vanish. Layout:

    magic
    planes of block 0, planes of block 1, ...
    document index: ids, null marks and token counts, each compressed
    chunk index: for each block its offset, number of ids and length of each plane
    footer: lengths of both indexes, counts, block size, kind of planes, magic

Any run of ids is found by the chunk index and read by decoding its blocks only.

A file counts once its row is in the manifest, a table that Spark commits task
by task. A task that is tried again writes another file, so a lost executor
leaves at most a file that nobody lists. Files are written and read through
pyarrow's file systems: any shared store with a scheme it knows.

Null texts are empty documents; every document ends with the end id. Null ids
come first; rows equal in id are ordered by a hash of the text. An empty table
makes no files. Columns besides id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .base import written

MAGIC = b"EBBPLN01"
FOOTER = "<6q8s"
BLOCK_IDS = 1 << 16
FILE_TEXT_BYTES = 32 << 20
CACHED_PIECES = 600_000
PIECE_BYTES = 64
PORTION_BYTES = 4 << 20
JOINED_PIECES = 256
LEVEL = 3

#: Stands between new pieces that are encoded in one call; pieces that hold it are encoded by themselves.
MARK = "\U000F8FF0"

# Bytes before which a piece may start: 1 for white space, 2 for . , : ; and after which bytes that is so.
OPENS, CLOSES = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
OPENS[list(b" \t\r\n")], OPENS[list(b".,:;")] = 1, 2
CLOSES[0x21:0x7F] = 1
CLOSES[[b for b in range(128) if chr(b).isalnum()]] = 3
CLOSES[0x80:0xC0] = 3  # second bytes of letters from U+00C0 to U+00FF, but for the signs of times and division
CLOSES[[0x97, 0xB7]] = 0


# -- encoding

def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where a byte-level tokenizer always starts a new piece of UTF-8 text.

    Before white space after a visible character of ASCII or a letter of Latin-1, and
    before . , : ; after letters of both and digits.
    """
    at = np.flatnonzero(OPENS[data])
    at = at[at > 0]
    last = data[at - 1]
    fits = (OPENS[data[at]] & CLOSES[last]) != 0
    return at[fits & ((last < 0x80) | (data[at - 2] == 0xC3))]


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts without nulls as slices of their bytes, and the number of pieces before each text and after the last."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype="<i8")[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype="<i8")
    data = np.frombuffer(data or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    starts = np.zeros(len(data), dtype=bool)
    starts[piece_starts(data)] = True
    starts[ends[ends < len(data)]] = True
    starts = np.flatnonzero(starts)
    offsets = np.append(starts, len(data)).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, ends)


def encoder(tokenizer_json: str, end_id: int) -> Callable[[pa.Array | list], list[bytes]]:
    """Function from texts to their ids, each as little-endian unsigned 32-bit integers, with the end id.

    Byte-level tokenizers without a normaliser never join what `piece_starts` parts, so
    the distinct pieces of some texts are encoded by themselves, and recent ones only
    once; ids of texts are then taken from those of pieces. New pieces go to the tokenizer
    many in one call, with a special token between them. Other tokenizers get whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer

    spec = json.loads(tokenizer_json)
    own = Tokenizer.from_str(tokenizer_json)
    own.no_truncation()
    own.no_padding()
    before = spec.get("pre_tokenizer") or {}
    separate = (spec.get("normalizer") is None and spec.get("post_processor") is None and spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
                and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or MARK in t["content"] or len(piece_starts(np.frombuffer(t["content"].encode(), dtype=np.uint8)))
                            for t in spec.get("added_tokens", [])))
    end, mark = struct.pack("<I", end_id), MARK.encode()
    parted = Tokenizer.from_str(own.to_str())
    parted.add_special_tokens([AddedToken(MARK, normalized=False, special=True)])
    mark_id = parted.token_to_id(MARK)

    def ids_of(texts: list[str], by: Tokenizer = own) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_pieces(pieces: list[bytes]) -> dict[bytes, bytes]:
        alone = [p for p in pieces if mark in p]
        rest = [p for p in pieces if mark not in p] if alone else pieces
        out = {p: ids.tobytes() for p, ids in zip(alone, ids_of([p.decode() for p in alone]))}
        groups = [rest[lo:lo + JOINED_PIECES] for lo in range(0, len(rest), JOINED_PIECES)]
        for group, ids in zip(groups, ids_of([mark.join(g).decode() for g in groups], parted)):
            marks, data = (np.flatnonzero(ids == mark_id) * 4).tolist(), ids.tobytes()
            out.update((p, data[lo:hi]) for p, lo, hi in zip(group, [0, *(m + 4 for m in marks)], [*marks, len(data)], strict=True))
        return out

    young: dict[bytes, bytes] = {}
    old: dict[bytes, bytes] = {}

    def encode(texts: pa.Array | list) -> list[bytes]:
        nonlocal young, old
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not separate:
            return [ids.tobytes() + end for ids in ids_of(texts.to_pylist())]
        if len(young) > CACHED_PIECES:
            young, old = {}, young
        pieces, bounds = pieces_of(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # a list of bytes, made faster than by to_pylist
        found = list(map(young.get, distinct))
        missing = [p for p, v in zip(distinct, found) if v is None]
        known = {p: old[p] for p in missing if p in old}
        known.update(ids_of_pieces([p for p in missing if p not in known]))
        young.update((p, v) for p, v in known.items() if len(p) <= PIECE_BYTES)
        values = pa.array([*(known[p] if v is None else v for p, v in zip(distinct, found)), end], pa.large_binary())
        # After the pieces of each text the end id, as one piece more.
        taken = values.take(pa.array(np.insert(coded.indices.to_numpy(), bounds[1:], len(distinct))))
        _, offsets, data = taken.buffers()
        cuts = np.frombuffer(offsets, dtype="<i8")[bounds + np.arange(len(bounds))].tolist() if len(texts) else [0]
        ids = memoryview(data) if data else b""
        return [bytes(ids[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]

    return encode


# -- planes

def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids, lowest first."""
    cells = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        cells = np.packbits(np.unpackbits(cells, axis=1, bitorder="little"), axis=0)
    return [column.tobytes() for column in np.ascontiguousarray(cells.T)]


def ids_from(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    cells = np.frombuffer(b"".join(planes), dtype=np.uint8).reshape(len(planes), -1).T
    if kind == "bit":
        cells = np.packbits(np.unpackbits(cells, axis=0, count=n), axis=1, bitorder="little")
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)


class PlaneWriter:
    """One file: documents are added in order; memory holds a block of ids and the indexes."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, kind: str = "byte"):
        self.stream, self.block_ids, self.kind = stream, block_ids, kind
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.waiting, self.n_waiting = [], 0
        self.chunks, self.docs, self.counts = [], [], []
        self.at = stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        n = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for lo in range(0, n, self.block_ids):
            block = ids[lo:min(n, lo + self.block_ids)]
            packed = [self.pack(p) for p in planes_of(block, self.kind)]
            self.chunks.append([self.at, len(block), *map(len, packed)])
            self.at += self.stream.write(b"".join(packed))
        self.waiting, self.n_waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(True)
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        parts = [self.pack(a.tobytes()) for a in (np.array([d or 0 for d in self.docs], dtype="<i8"), known, np.array(self.counts, dtype="<i8"))]
        index = struct.pack("<3q", *map(len, parts)) + b"".join(parts)
        chunks = self.pack(np.array(self.chunks, dtype="<i8").tobytes())
        n_ids = sum(self.counts)
        self.stream.write(index + chunks + struct.pack(FOOTER, len(index), len(chunks), n_ids, len(self.docs), self.block_ids, 32 if self.kind == "bit" else 4, MAGIC))
        self.stream.close()
        return n_ids, len(self.docs)


class PlaneReader:
    """One file, opened for random access; only the indexes are read ahead."""

    def __init__(self, stream):
        size = stream.size()
        self.stream, self.unpack = stream, zstandard.ZstdDecompressor().decompress
        tail = self._at(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER))
        n_index, n_chunks, self.n_ids, self.n_docs, self.block_ids, self.planes, magic = struct.unpack(FOOTER, tail)
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a whole file of token planes")
        self.kind = "bit" if self.planes == 32 else "byte"
        both = self._at(size - struct.calcsize(FOOTER) - n_chunks - n_index, n_index + n_chunks)
        self.chunks = np.frombuffer(self.unpack(both[n_index:]), dtype="<i8").reshape(-1, 2 + self.planes)
        sizes, place, parts = struct.unpack_from("<3q", both), 24, []
        for n in sizes:
            parts.append(self.unpack(both[place:place + n]))
            place += n
        self.doc_ids = np.ma.array(np.frombuffer(parts[0], dtype="<i8"), mask=np.frombuffer(parts[1], dtype=np.uint8) == 0)
        self.counts = np.frombuffer(parts[2], dtype="<i8")

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def block(self, number: int) -> np.ndarray:
        offset, n, *sizes = (int(v) for v in self.chunks[number])
        data, place, planes = self._at(offset, sum(sizes)), 0, []
        for size in sizes:
            planes.append(self.unpack(data[place:place + size]))
            place += size
        return ids_from(planes, n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids from a place of the file on, from as few blocks as hold them."""
        first, last = start // self.block_ids, -(-(start + n) // self.block_ids)
        found = [self.block(b) for b in range(first, last)] or [np.empty(0, dtype="<u4")]
        return np.concatenate(found)[start - first * self.block_ids:][:n]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in this file, ids, crc32 of the ids) in order, with one block in memory."""
        blocks = (self.block(b) for b in range(len(self.chunks)))
        have, start = np.empty(0, dtype="<u4"), 0
        for doc, n in zip(self.doc_ids.tolist(), self.counts.tolist()):
            crc, left = 0, n
            while left:
                if not len(have):
                    have = next(blocks)
                crc = zlib.crc32(have[:left].tobytes(), crc)
                taken = min(left, len(have))
                have, left = have[taken:], left - taken
            yield doc, start, n, crc
            start += n


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about PORTION_BYTES bytes; one text may be longer."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while lo < len(texts):
        had = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, had + PORTION_BYTES, side="right")))
        yield lo, hi
        lo = hi


def _opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


# -- Spark

def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
                      block_ids: int = BLOCK_IDS, kind: str = "byte", file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write the files; their manifest: part, file, n_ids, n_docs. Files in the order of `part` hold documents by ascending id.

    `tokenizer` is the path of a tokenizers JSON file on the driver, sent along
    with the job; ids must be integers.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast({"json": f.read()})  # a tokenizer's own file: some MB, whatever the corpus
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(size // file_text_bytes + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        # A worker keeps broadcast values, and so its tokenizer, from task to task.
        encode = spec.value.get("encode") or spec.value.setdefault("encode", encoder(spec.value["json"], end_id))
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                part = TaskContext.get().partitionId()
                name = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}.planes"
                store, path = _opened(name)
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                writer = PlaneWriter(store.open_output_stream(path), block_ids, kind)
            for lo, hi in portions(batch.column(1)):
                some = batch.slice(lo, hi - lo)
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    writer.add(doc, ids)
        if writer is not None:
            n_ids, n_docs = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_ids": [n_ids], "n_docs": [n_docs]})

    return written(spark, dealt.mapInArrow(write, "part bigint, file string, n_ids bigint, n_docs bigint"), "manifest")


def with_starts(manifest: DataFrame, span: int = 1024) -> DataFrame:
    """The manifest with the number of ids in all files before; files are summed in spans first."""
    spans = manifest.groupBy(F.floor(F.col("part") / span).alias("span")).agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row for a span of files
    offsets = spans.select("span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("span").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("span", F.floor(F.col("part") / span)).withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return placed.join(offsets, "span").select("part", "file", "n_ids", "n_docs", (F.col("offset") + F.col("inside")).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _opened(file)
                with store.open_input_file(path) as stream:
                    rows = []
                    for row in PlaneReader(stream).documents():
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _batch(rows, before)
                            rows = []
                    if rows:
                        yield _batch(rows, before)

    def _batch(rows, before):
        doc, start, n, crc = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.array(start, dtype=np.int64) + before), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = with_starts(manifest).select("file", "start")
    n_files = manifest.count()
    return files.repartition(max(1, n_files), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
