"""Token-id output: ORC files of token ids in ascending doc_id order, read back by stripes.

Documents are dealt to range partitions of doc_id and encoded there, so each partition becomes one file whose rows are in doc_id
order. The ids are an integer column, which ORC run-length encodes; row indexes and a Bloom filter on doc_id let a reader skip
stripes. `rel_start` counts the ids before a document in its file; `read_back` adds what the files before it in doc_id order hold.

Texts are cut into pieces before each blank or line feed that no white space precedes. The vocabulary's pre-tokenizer never joins
such a place to what stands before it, so a piece's ids depend on the piece alone: a batch's pieces are dictionary-encoded by Arrow,
the library encodes those that are not in the worker's table yet, in long runs, and the ids are gathered by numpy. The table is
bounded in bytes; the pieces that were used longest ago leave it. The strings of special tokens are ordinary text.

Null and empty texts have only the end id. Repeated rows are repeated in the files, next to each other. A null doc_id sorts first.
Texts of any length are encoded whole, one text at least at a time. An empty table gives no rows. Only doc_id and text are read, so
further columns can't clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_path, text_bytes

END_ID = 0
#: Bytes of pieces and ids that a worker remembers, and bytes that the library encodes in one text.
TABLE_BYTES = 24 << 20
RUN = 1 << 15
#: Bytes that are white space, or may be to some reader: no cut behind them.
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), *range(28, 33)]] = True
#: ORC settings: stripes of 16 MB, a row index entry every 1,000 documents, Bloom filters on doc_id, one file for each task.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD", "maxRecordsPerFile": "0"}


def _behind_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place (at least 1) is white space. Some other characters of U+2000 to U+200F count, too."""
    one = data[at - 1]
    out = SPACE[one]
    wide = np.flatnonzero(one >= 0x80)
    if len(wide):
        a = at[wide]
        one, two, three = data[a - 1], data[np.maximum(a - 2, 0)], data[np.maximum(a - 3, 0)]
        latin = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        general = (three == 0xE2) & (two == 0x80) & ((one <= 0x8F) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
        other = ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        other |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
        out[wide] = latin | general | other
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at the start of each text, and at blanks and line feeds that stand behind no white space."""
    mark = (data == 32) | (data == 10)
    starts = offsets[:-1][np.diff(offsets) > 0]
    mark[starts] = False
    at = np.flatnonzero(mark)
    mark[at] = ~_behind_space(data, at)
    mark[starts] = True
    return np.flatnonzero(mark)


class Encoder:
    """Texts to unsigned 32-bit ids with the tokenizers library; every text is followed by the end id."""

    def __init__(self, vocabulary: str, end_id: int = END_ID, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = True
        self.n_bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.n_bytes[i] = len(token)  # byte-level: one character stands for one byte
        self.table_bytes = table_bytes
        # The table: pieces, and ids[at[k] : at[k + 1]] of the k-th. No piece is empty, so the empty one stands for a text's end.
        self.pieces = pa.array([b""], pa.binary())
        self.ids, self.at = np.array([end_id], np.uint32), np.array([0, 1])
        self.used, self.turn = np.zeros(1, np.int64), 0

    def _library(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _one_by_one(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._library(new.to_pylist()) if len(new) else []
        return np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.uint32), np.array([len(x) for x in found], np.int64)

    def _in_runs(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces that may follow each other; the library's ids are dealt back by their bytes."""
        if not len(new):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, offsets = text_bytes(new)
        first = np.unique(np.searchsorted(offsets[:-1], np.arange(0, offsets[-1], RUN)).clip(max=len(new) - 1))
        first[0] = 0
        bounds = [*first.tolist(), len(new)]
        runs = self._library([data[offsets[i] : offsets[j]].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
        ids, ends, bad = np.concatenate(runs), offsets[1:], False
        done = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(done, ends)
        bad = len(done) == 0 or last[-1] >= len(done) or (done[last] != ends).any()
        if bad:  # not a byte-level vocabulary
            return self._one_by_one(new)
        return ids, np.diff(last + 1, prepend=0)

    def _learn(self, new: pa.Array) -> None:
        data, offsets = text_bytes(new)
        joins = ((data[offsets[:-1]] == 32) | (data[offsets[:-1]] == 10)) & ~_behind_space(data, offsets[1:])
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        (a, n), (b, m) = self._in_runs(new.filter(pa.array(joins))), self._one_by_one(new.filter(pa.array(~joins)))
        ids, count = np.concatenate([a, b]), np.concatenate([n, m])
        begin = np.cumsum(count) - count
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # back into the order of new
        self.ids = np.concatenate([self.ids, gather(ids, begin[place], count[place])])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count[place])])
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.used = np.concatenate([self.used, np.full(len(new), self.turn)])

    def _forget(self) -> None:
        """Keeps the half of the table that was used last."""
        if self.pieces.nbytes + self.ids.nbytes + self.at.nbytes + self.used.nbytes <= self.table_bytes:
            return
        keep = self.used > np.median(self.used)
        keep[0] = True
        count = np.diff(self.at)
        self.ids = gather(self.ids, self.at[:-1][keep], count[keep])
        self.at = np.concatenate([[0], np.cumsum(count[keep])])
        self.pieces, self.used = self.pieces.filter(pa.array(keep)), self.used[keep]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; ids of each text)."""
        self._forget()
        self.turn += 1
        starts = cuts(data, offsets)
        bounds = np.concatenate([starts, [len(data)]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        row = pc.fill_null(pc.index_in(words.dictionary, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.pieces) + np.arange(len(new))
            self._learn(words.dictionary.take(pa.array(new)))
        self.used[row] = self.turn
        first = np.searchsorted(starts, offsets)
        rows = np.insert(row[words.indices.to_numpy()], first[1:], 0)
        count = np.diff(self.at)[rows]
        total = np.concatenate([[0], np.cumsum(count)])
        return gather(self.ids, self.at[:-1][rows], count), np.diff(total[first + np.arange(len(first))])


def gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[begin : begin + count] of all ranges, laid end to end."""
    shift = begin - (np.cumsum(count) - count)
    return values[np.repeat(shift, count) + np.arange(count.sum())]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """One encoder in each worker, whichever vocabulary came last."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """vocabulary: path of a byte-level tokenizer file that every worker can read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = _encoder(vocabulary, end_id), 0
        for b in pieces(batches, "text", 4 << 20):
            ids, counts = encoder.encode(*text_bytes(b.column("text")))
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total + ends - counts), pa.array(counts), lists], ["doc_id", "rel_start", "n_tokens", "ids"])
            total += int(ends[-1])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, "doc_id long, rel_start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: file, n_docs, n_tokens, first and last doc_id, and base, the ids in the files before it by doc_id.

    All rows of a doc_id, and all without one, are in one file (the first, for these), so first ids tell the order of the files.
    """
    files = spark.read.orc(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("base", base)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the files; splits of a file (stripes) are read in parallel.

    The manifest has a row for each file, that is for each write task, so it is small enough to broadcast at any input size.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view("<u4")
            at = ids.offsets.to_numpy()
            crc = np.array([zlib.crc32(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rel_start"), b.column("file"), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(crc)], ["doc_id", "rel_start", "file", "n_tokens", "ids_crc32"])

    rows = spark.read.orc(path).select("doc_id", "rel_start", F.col("_metadata.file_name").alias("file"), "ids")
    rows = rows.mapInArrow(check, "doc_id long, rel_start long, file string, n_tokens long, ids_crc32 long")
    rows = rows.join(F.broadcast(manifest(spark, path).select("file", "base")), "file")
    return rows.select("doc_id", (F.col("base") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, *doc_ids: int) -> DataFrame:
    """The ids of a few documents; the filter reaches the ORC reader, which prunes by row index and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "ids")


def encode_and_read(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, vocabulary, **how)
    return read_back(spark, path)
