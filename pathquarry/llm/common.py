"""What the operators share: byte-level views of Arrow text columns, hashes of byte spans, and the labelled sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, join_hot, numbered, shared_path  # noqa: F401  (for the operators)

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(SPACES)] = False
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_split(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2: rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all rows laid end to end; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text takes at most limit bytes, one row at least: bounds a worker's scratch arrays."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(start, stop - start)
            start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each row the index of its first word (rows + 1 entries)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = WORD_BYTE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.full(m, np.uint64(base % (1 << 64)), np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if n <= 8 << 20:
            _POWERS[base] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


class SpanHash:
    """64-bit polynomial hashes of any byte spans of one buffer, after one pass over it."""

    def __init__(self, data: np.ndarray, base: int = _P):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = 32 << 20) -> DataFrame:
    """(text, y) of at most per_class labelled ids of each class, chosen by a hash of the id, never from the held-out split.

    An id with several labels counts as 1 if any is 1. The sample's ids are few by construction, so they are broadcast. Texts are
    whole; if those of a class are more than class_bytes, the last of them by the hash are left out (one stays in any case).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~labelled_split())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = some[0].union(some[1]).select(F.col("doc_id").alias("__k"), "y")
    rows = docs.select(F.col("doc_id").alias("__d"), "text").join(F.broadcast(ids), F.col("__d") == F.col("__k"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    before = F.sum(size).over(Window.partitionBy("y").orderBy(F.xxhash64("__k"), "__k", "text").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__b", F.coalesce(before, F.lit(0))).where(F.col("__b") < class_bytes).select("text", "y")
