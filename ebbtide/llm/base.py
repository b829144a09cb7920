"""What the operators share: row keys, written tables, words and their hashes."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

#: A-Z to a-z; every other ASCII character outside words to a blank. UTF-8 bytes
#: of other characters belong to words and stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Shuffle files of a finished write serve nobody: its table is read from then on.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the cluster's shared folder."""
    path = scratch_path(spark, name)
    with settings(spark, CLEAN_UP):
        frame.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs started inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def extended(schema: StructType, fields: str) -> StructType:
    """A schema and the fields of a DDL string."""
    return StructType(schema.fields + StructType.fromDDL(fields).fields)


def rest_of(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text, which then travels once, in one struct: no name can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))


def row_again(docs: DataFrame, text_col: str) -> Column:
    """The struct `row` with the columns of docs, from `rest` and `text`."""
    return F.struct(*(F.col("text").cast("string").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns)).alias("row")


def text_key(text: Column | str) -> Column:
    """With the id, the key of a row: the same in every scan, after any lost executor.

    Rows equal in id and text are one document to the operators that use it.
    """
    return F.xxhash64(F.lit("row"), text)


BITMAP_WORDS = 1 << 20  # of 64 bits: 8 MB, whatever the corpus


def bitmap_of(values: DataFrame, name: str) -> np.ndarray:
    """A bit for each value of one bigint column; at most BITMAP_WORDS rows reach the driver."""
    where = F.col(name).bitwiseAND(BITMAP_WORDS - 1).alias("word")
    bit = F.expr(f"shiftleft(1L, cast((shiftright({name}, 20) & 63) as int))")
    out = np.zeros(BITMAP_WORDS, dtype=np.int64)
    rows = values.groupBy(where).agg(F.bit_or(bit).alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values may be among those of the bitmap; never False for one that is."""
    return (bitmap[values & (BITMAP_WORDS - 1)] >> ((values >> 20) & 63)) & 1 == 1


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_TABLE).split()


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE, _PLACE, _STEP = _multipliers(256, 1), _multipliers(64, 2), _multipliers(16, 3)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, equal for equal words in any process."""
    raw = np.frombuffer(data.translate(WORD_TABLE), dtype=np.uint8)
    inside = raw != 32
    if not inside.any():
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    where = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(where)) - np.repeat(first, lengths)
    lap = (place >> 6).astype(np.uint64)  # words of over 64 bytes use the multipliers again, shifted
    part = _BYTE[raw[where]] * (_PLACE[place & 63] + (lap << np.uint64(1)))
    return mixed(np.add.reduceat(mixed(part), first) + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of n consecutive words, sorted; a shorter text, not empty, is one shingle."""
    k = min(n, len(hashes))
    if not k:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        total += hashes[j:len(hashes) - k + 1 + j] * _STEP[j]
    return np.unique(mixed(total + np.uint64(k)))
