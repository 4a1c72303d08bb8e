"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most `distance` bits differ in at most that many bytes, so they
share at least 8 - distance bytes at equal positions: the guaranteed minimum of matches. Lists of single positional bytes would hold
1/256 of all documents each, and a tally over them would meet nearly all pairs; so the index lists every fingerprint under each
combination of that minimum's many positions with its bytes there. To be in one list is to have reached the count: the tally is made
by the key, and what it decides within a list is in which one of its lists a pair is taken (the first combination among its shared
positions). Pairs that reach the count are verified by their differing bits. Only links enough to connect a list's fingerprints
leave it, not all pairs; equal fingerprints are one entry from the start.

Null and empty texts have fingerprint zero and are linked like others. Repeated rows (equal ids) keep their rows. A null doc_id
keeps its row, is never a representative, and gets a component only through documents with an id. An empty table gives no rows.
Texts of any length are read whole, a batch of at least one at a time. Columns of the input named fp or component_id are replaced by
the results; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_text
from .common import LOWER, cut, join_hot, pieces, text_bytes, word_spans
from .components import components

SEED = 42
WIDTH = 4
DISTANCE = 4
#: Lists with more distinct fingerprints are compared in blocks of this size by many tasks.
BLOCK = 2048


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The 64-bit fingerprint of each text's width-word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    # All words again, one blank behind each: a shingle is then one slice.
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    plain = np.full(at[-1], 32, np.uint8)
    fill = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    blank = at[1:] - 1
    fill[blank] = 0
    plain[:] = data[fill] if len(data) else 32
    plain[blank] = 32
    plain = plain.tobytes()
    at = at.tolist()
    out = np.zeros(len(first) - 1, np.uint64)
    for row in range(len(out)):
        i, j = int(first[row]), int(first[row + 1])
        if i == j:
            continue
        last = max(j - width + 1, i + 1)
        cuts = zip(at[i:last], at[min(i + width, j) : j + 1], strict=False)
        h = np.array([xxh64_intdigest(plain[s : e - 1], seed) for s, e in cuts], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[row] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED, text: str = "text") -> DataFrame:
    """docs without text, with fp: the signed 64-bit fingerprint of the width-word shingles, repeats included."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            out = fingerprints_of(*text_bytes(b.column(text)), width, seed)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out.view(np.int64))], [*rest, "fp"])

    return docs.select(*[f"`{c}`" for c in [*rest, text]]).mapInArrow(work, schema)


def _differ(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, 8-bit mask of the equal bytes) of all pairs of two arrays."""
    x = a[:, None] ^ b[None, :]
    same = np.packbits(x.reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, ::-1] == 0, axis=1).reshape(x.shape)
    return np.bitwise_count(x), same


class _Lists:
    """Compares the fingerprints of one list: groups that are linked, as links to each group's smallest representative."""

    def __init__(self, distance: int):
        self.distance = distance
        self.least = 8 - distance
        self.combos = list(combinations(range(8), self.least))
        self.masks = np.array([sum(128 >> p for p in c) for c in self.combos], np.uint8)
        first = np.full(256, 255, np.int64)  # the first combination whose positions a mask of equal bytes contains
        for k in reversed(range(len(self.combos))):
            first[(np.arange(256) & self.masks[k]) == self.masks[k]] = k
        self.first = first

    def links(self, combo: int, fa: np.ndarray, ra: np.ndarray, fb: np.ndarray, rb: np.ndarray) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        step = max(1, (1 << 20) // max(1, len(fb)))
        for i in range(0, len(fa), step):
            bits, same = _differ(fa[i : i + step], fb)
            x, y = np.nonzero((bits <= self.distance) & (self.first[same] == combo) & (ra[i : i + step, None] != rb[None, :]))
            for p, q in zip(ra[i + x].tolist(), rb[y].tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        return [(x, r) for x in parent if (r := root(x)) != x]


def links(reps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """reps(fp, rep) with distinct fp to (a, b): representatives whose links connect all that differ in at most distance bits."""
    lists = _Lists(distance)
    least, combos = lists.least, lists.combos

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 20_000):
                b = big.slice(at, 20_000)
                fp = b.column("fp").to_numpy().view(np.uint64)
                by = fp.astype(">u8").view(np.uint8).reshape(-1, 8)
                for k, c in enumerate(combos):
                    key = np.zeros(len(fp), np.int64)
                    for p in c:
                        key = key << 8 | by[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int8)), pa.array(key), b.column("fp"), b.column("rep")], ["combo", "key", "fp", "rep"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list; lists of up to BLOCK entries are compared, longer ones handed on in numbered blocks."""
        names = ["a", "b", "combo", "key", "block", "fp", "rep"]

        def links_of(combo, fp, rep):
            pairs = lists.links(combo, fp, rep, fp, rep)
            return [p for p, _ in pairs], [q for _, q in pairs]

        carry: list[tuple] = []  # parts of the list that the batch before ended in
        block = 0

        def close() -> Iterator[tuple]:
            nonlocal carry, block
            if carry:
                combo, key = carry[0][:2]
                fp, rep = np.concatenate([c[2] for c in carry]), np.concatenate([c[3] for c in carry])
                if block:
                    yield ("block", combo, key, block, fp, rep)
                elif len(fp) > 1:
                    yield ("links", *links_of(combo, fp, rep))
            carry, block = [], 0

        def spill() -> Iterator[tuple]:
            nonlocal carry, block
            while sum(len(c[2]) for c in carry) > BLOCK:
                combo, key = carry[0][:2]
                fp, rep = np.concatenate([c[2] for c in carry]), np.concatenate([c[3] for c in carry])
                block += 1
                yield ("block", combo, key, block - 1, fp[:BLOCK], rep[:BLOCK])
                carry = [(combo, key, fp[BLOCK:], rep[BLOCK:])]

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            a = [x for f in found if f[0] == "links" for x in f[1]]
            b = [x for f in found if f[0] == "links" for x in f[2]]
            if a:
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int8()), none, none, none, none], names)
            for f in found:
                if f[0] == "block":
                    _, combo, key, number, fp, rep = f
                    n, none = len(fp), pa.nulls(len(fp), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(n, combo, np.int8)), pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, number, np.int64)), pa.array(fp.view(np.int64)), pa.array(rep)], names)

        for b in batches:
            if not b.num_rows:
                continue
            combo, key = b.column("combo").to_numpy(), b.column("key").to_numpy()
            fp, rep = b.column("fp").to_numpy().view(np.uint64), b.column("rep").to_numpy()
            new = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = [0, *new.tolist(), len(key)]
            single = np.diff(cuts) == 1
            found: list[tuple] = []
            for n, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if carry and (carry[0][0], carry[0][1]) != (combo[i], key[i]):
                    found += close()
                if single[n] and j < len(key) and not carry:
                    continue  # nothing to compare it with
                carry.append((combo[i], key[i], fp[i:j], rep[i:j]))
                found += spill()
            yield from rows(found)
        yield from rows(list(close()))

    entries = reps.mapInArrow(index, "combo byte, key long, fp long, rep long")
    schema = "a long, b long, combo byte, key long, block long, fp long, rep long"
    found = cut(entries.repartition("combo", "key").sortWithinPartitions("combo", "key").mapInArrow(compare, schema), "simhash")
    near = found.where("a is not null").select("a", "b")
    long = found.where("combo is not null")
    if long.isEmpty():
        return near
    # Long lists: each block meets each block of its list in a task of its own.
    blocks = long.groupBy("combo", "key").agg(F.max("block").alias("most"))
    long = long.select("combo", "key", "block", "fp", "rep").join(blocks, ["combo", "key"])
    meets = long.select("combo", "key", "block", "fp", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("other"))
    meets = meets.select("combo", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "fp", "rep")

    def meet(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy()
        fp, rep = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        f, g = ~second, second if second.any() else ~second
        pairs = lists.links(table.column("combo")[0].as_py(), fp[f], rep[f], fp[g], rep[g])
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    return near.union(meets.groupBy("combo", "key", "i", "j").applyInArrow(meet, "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without text, with fp and component_id, the smallest id reachable by links."""
    rows = cut(fingerprints(docs.drop("component_id"), width, seed, text), "fingerprints")
    counted = cut(rows.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("rep"), F.count("*").alias("__n")), "fingerprints")
    reps = counted.where("rep is not null")
    found = components(links(reps.select("fp", "rep"), distance))
    ids = counted.join(found, counted.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "__n")
    ids = cut(ids, "fingerprints")
    return join_hot(rows, ids, "fp", "__n", rows.count()).select(*rows.columns, "component_id")


def keep_one(docs: DataFrame, by: str = "fingerprints", text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that represent their component: those with its smallest id. Rows without an id stay.

    by="fingerprints" links as near_duplicates does; by="shingles" links five-word shingle sets of Jaccard similarity 0.8 or more:
    what the index of fingerprints of these shingles links is verified on the sets, and near_text adds the links that no number of
    equal positional bytes is guaranteed for, between texts that are not connected yet. What stays or goes is a text of an id: of rows with
    equal ids but different texts each is judged by its own text's component. Equal rows of the smallest id stay together.
    """
    own = docs.select(*dict.fromkeys((f"`{doc_id}`", f"`{text}`")))
    if by == "shingles":
        found = near_text.near_duplicates(own, text, doc_id, lambda data, offsets: fingerprints_of(data, offsets, near_text.WIDTH, SEED), links)
    else:
        found = near_duplicates(own.withColumn("__t", near_text.text_hash(F.col(f"`{text}`"))), text=text, doc_id=doc_id, **how)
        found = found.select(F.col(f"`{doc_id}`").alias("id"), F.col("__t").alias("text_hash"), "component_id")
    gone = found.where("id <> component_id").select("id", "text_hash").distinct()
    same = (docs[f"`{doc_id}`"] == gone["id"]) & (near_text.text_hash(docs[f"`{text}`"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")
