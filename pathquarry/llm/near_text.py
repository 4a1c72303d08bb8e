"""Near-duplicates by the Jaccard similarity of five-word shingle sets: an exact join, no sampling of pairs.

What SimHash's operator does with positional bytes is done here with shingles, since no bound on the bits of a fingerprint holds all
pairs of similarity 0.8: an inverted index, a guaranteed minimum of matches, and a verification. Shingles are put in one order for
all texts. Two sets whose similarity is SIMILAR or more share a shingle among the first n - ceil(SIMILAR * n) + 1 of each (prefix
filter), so only these are indexed. Within a list, pairs go that can't be similar by their sizes, by their places in the order, or by
the differing bits of parity maps of 128 and then of 1,024 bits (differing bits never outnumber the shingles that only one of two sets
has), and of sets with more shingles of maps as long as these, since short ones tell no two large sets apart. What is left is verified on the whole sets. The order puts shingles last that are frequent in a sample of texts; a poor sample makes lists longer
and loses nothing.

simhash.keep_one gives near_duplicates its fingerprints and their index: the links that these find are verified first, and the lists
then only serve texts that they leave apart.

Next every entry of a list is paired with one that it may be similar to, by preference one whose shingles are nearly all found
elsewhere: in a family of copies that is the text they were made from, and it connects them. Then all pairs of a list whose ends the
links of the first pairs don't connect are verified. So a large group of copies is connected without comparing all its pairs, and
the components are those of all similar pairs.

Texts of fewer than five words have one shingle, null and empty ones none; equal sets (64-bit sums of mixed hashes) are one node, and
a task lists each set once, so copies make no long lists. Repeated rows keep their rows. Rows with a null doc_id stay and link
nothing. Texts of any length are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SpanHash, cut, join_hot, mix64, pieces, text_bytes, word_spans
from .components import components

WIDTH = 5
#: SIMILAR = UP / DOWN, in whole numbers so that a similarity of exactly 0.8 counts.
UP, DOWN = 4, 5
#: Texts that the order of shingles is made from, the share of them that makes a shingle frequent, and how many are noted at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 0.0005, 200_000
#: Lists of up to this many entries are compared many at once.
SHORT = 32
#: 64-bit words of a set's wide parity map.
WORDS = 16
#: Bits of the map of texts to verify.
MAP_BITS = 1 << 24
_LIST = ("token", "key", "n", "pos", "even", "odd")
_LIST_SCHEMA = "token long, key long, n int, pos int, even long, odd long"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, first): each text's distinct shingles as sorted 63-bit hashes, and where each text's begin."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets)
    size = np.diff(at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = np.concatenate([SpanHash(data)(starts, ends), np.zeros(WIDTH, np.uint64)])
    row = np.repeat(np.arange(len(size)), size)
    here = np.arange(len(row))
    width = np.minimum(size, WIDTH)[row]
    keep = here + width <= at[1:][row]
    here, row, width = here[keep], row[keep], width[keep]
    h = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            h = np.where(k < width, h * np.uint64(0x9E3779B97F4A7C15) + words[here + k], h)
    token = mix64(h) & np.uint64((1 << 63) - 1)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (row[1:] != row[:-1])])
    return token[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[first[1:]] - total[first[:-1]]


def _keys(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; 0 for the empty one."""
    return _sums(mix64(token ^ np.uint64(0x5E75A11)), first).view(np.int64)


def _maps(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit parity maps of each set: a shingle turns one bit of one of them."""
    out = []
    half, bit = (token >> np.uint64(6)) & np.uint64(1), np.uint64(1) << (token & np.uint64(63))
    for k in (0, 1):
        turns = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(half == k, bit, np.uint64(0)))])
        out.append((turns[first[1:]] ^ turns[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _wide(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity maps of WORDS * 64 bits for each set, by other bits of the shingles."""
    bit = (token >> np.uint64(7)) & np.uint64(64 * WORDS - 1)
    out = np.zeros((len(first) - 1, WORDS), np.uint64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _full(token: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """Parity maps of n to 2 n bits, by other bits again, for sets that have too many shingles for the wide ones to tell apart."""
    out: list[bytes | None] = [None] * (len(first) - 1)
    for row in np.flatnonzero(np.diff(first) > 64 * WORDS):
        own = token[first[row] : first[row + 1]]
        bits = 1 << (len(own) - 1).bit_length()
        turned = np.bincount(((own >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[row] = np.packbits(turned.astype(np.uint8), bitorder="little").tobytes()
    return out


def _near_full(a: bytes, b: bytes, most: int) -> bool:
    """Whether maps of _full differ in at most `most` bits, the larger folded to the size of the smaller."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= most


def _most_bits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles at most only one of two similar sets of these sizes has, and so how many bits of their maps differ."""
    total = n + m
    return total - 2 * -(-UP * total // (UP + DOWN))


def _near_maps(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of wide maps (rows of a and b) differ in at most `most` bits."""
    differ = np.zeros(len(a), np.int64)
    for k in range(WORDS):
        differ += np.bitwise_count(a[:, k] ^ b[:, k])
    return differ <= most


def _maps_of(column: pa.Array) -> np.ndarray:
    """Fixed-size binary values as rows of words."""
    data, _ = text_bytes(column if isinstance(column, pa.Array) else column.combine_chunks())
    return np.frombuffer(data.tobytes(), np.uint64).reshape(-1, WORDS)


def _new_sets(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token, first, key) of the sets that this task has not met before: eight bytes are kept of each."""
    met: set[int] = set()
    for b in pieces(batches, text):
        token, first = shingles(*text_bytes(b.column(text)))
        key = _keys(token, first)
        new = np.zeros(len(key), bool)
        new[np.unique(key, return_index=True)[1]] = True
        new &= np.fromiter((k not in met for k in key.tolist()), bool, len(key))
        met.update(key[new].tolist())
        if new.any():
            n = np.diff(first)
            yield token[np.repeat(new, n)], np.concatenate([[0], np.cumsum(n[new])]), key[new]


def _frequent(docs: DataFrame, text: str, rows: int) -> np.ndarray:
    """Shingles frequent in a sample, rarest first. At most MOST_FREQUENT."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(*text_bytes(b.column(text)))[0].view(np.int64))], ["token"])

    some = docs.select(F.col(f"`{text}`")).sample(min(1.0, SAMPLE / max(rows, 1)), seed=42)
    counts = some.mapInArrow(work, "token long").groupBy("token").count().where(F.col("count") >= max(8, int(FREQUENT * min(rows, SAMPLE))))
    found = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()
    return np.array([r["token"] for r in reversed(found)], np.uint64)


def _postings(docs: DataFrame, text: str, frequent: np.ndarray) -> DataFrame:
    """One row for each shingle in the prefix of each text."""
    by = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by], by.astype(np.uint64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for token, first, key in _new_sets(batches, text):
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            place = token.copy()
            if len(known):
                at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                hot = known[at] == token
                place[hot] = np.uint64(1 << 63) + rank[at[hot]]
            order = np.lexsort((place, row))
            pos = np.arange(len(token)) - first[:-1][row]
            keep = pos < (n + (-UP * n) // DOWN + 1)[row]
            row, pos, order = row[keep], pos[keep], order[keep]
            even, odd = _maps(token, first)
            columns = [token[order].view(np.int64), key[row], n[row].astype(np.int32), pos.astype(np.int32), even[row], odd[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_LIST))

    return docs.select(F.col(f"`{text}`")).mapInArrow(work, _LIST_SCHEMA)


def _may(a: dict, b: dict) -> np.ndarray:
    """Whether entries of one list may be similar if this is the first shingle that they share: never False for similar ones."""
    total = a["n"] + b["n"]
    need = -(-UP * total // (UP + DOWN))  # the least overlap of similar sets of these sizes
    rest = np.minimum(a["n"] - a["pos"], b["n"] - b["pos"])
    # As unsigned: of signed integers the bits of the absolute value would be counted.
    even, odd = ((a[k] ^ b[k]).view(np.uint64) for k in ("even", "odd"))
    differ = np.bitwise_count(even).astype(np.int64) + np.bitwise_count(odd)
    return (np.minimum(a["n"], b["n"]) >= need) & (rest >= need) & (differ <= _most_bits(a["n"], b["n"]))


def _places(c: dict, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of whole lists that may be similar, as places, between two parts: for each entry the first before it in the
    list, or every one."""
    cuts = np.flatnonzero(np.concatenate([[True], c["token"][1:] != c["token"][:-1], [True]]))
    size = np.diff(cuts)
    a, b = [], []
    begin = np.repeat(cuts[:-1], size)
    place = np.arange(len(begin)) - begin
    open_ = np.repeat(size <= SHORT, size)
    for r in range(int(size[size <= SHORT].max(initial=1)) - 1):  # the r-th of each list with all behind it
        j = np.flatnonzero(open_ & (place > r))
        i = begin[j] + r
        other = c["part"][i] != c["part"][j]
        i, j = i[other], j[other]
        ok = _may({k: v[i] for k, v in c.items()}, {k: v[j] for k, v in c.items()})
        a.append(i[ok])
        b.append(j[ok])
        if not every:
            open_[j[ok]] = False
    for k in np.flatnonzero(size > SHORT):
        s, e = int(cuts[k]), int(cuts[k + 1])
        step = max(1, (1 << 19) // (e - s))
        for i in range(s, e, step):
            stop = min(i + step, e)
            ok = _may({k: v[i:stop, None] for k, v in c.items()}, {k: v[None, s:stop] for k, v in c.items()})
            ok &= np.arange(i, stop)[:, None] > np.arange(s, stop)[None, :]
            ok &= c["part"][i:stop, None] != c["part"][None, s:stop]
            if every:
                x, y = np.nonzero(ok)
            else:
                x = np.flatnonzero(ok.any(axis=1))
                y = ok[x].argmax(axis=1)
            a.append(x + i)
            b.append(y + s)
    return tuple(np.concatenate([*z, np.zeros(0, np.int64)]).astype(np.int64) for z in (a, b))


def _pairs(c: dict, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs as keys, each once."""
    a, b = _places(c, every)
    if "wide" in c and len(a):
        near = np.concatenate([_near_maps(c["wide"][a[i : i + 65536]], c["wide"][b[i : i + 65536]], _most_bits(c["n"][a[i : i + 65536]], c["n"][b[i : i + 65536]])) for i in range(0, len(a), 65536)])
        a, b = a[near], b[near]
    found = np.sort(np.stack([c["key"][a], c["key"][b]], axis=1), axis=1)
    found = np.unique(found, axis=0) if len(found) else found
    return found[:, 0], found[:, 1]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows sorted by token, as whole lists."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        c = {name: _maps_of(b.column(name)) if name == "wide" else b.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in b.schema.names}
        if carry is not None:
            c = {k: np.concatenate([carry[k], c[k]]) for k in c}
        last = int(np.searchsorted(c["token"], c["token"][-1]))
        carry = {k: v[last:] for k, v in c.items()}
        if last:
            yield {k: v[:last] for k, v in c.items()}
    if carry is not None:
        yield carry


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and key: each key of a list once, and only lists of several keys."""
    for c in _lists(batches):
        new = np.concatenate([[True], (c["token"][1:] != c["token"][:-1]) | (c["key"][1:] != c["key"][:-1])])
        c = {k: v[new] for k, v in c.items()}
        same = c["token"][1:] == c["token"][:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[k][keep]).cast(pa.int32() if k in ("n", "pos") else pa.int64()) for k in _LIST], list(_LIST))


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _lists(batches):
        a, b = _pairs(c, every=False)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _open_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries that may be similar to one of another part in their list."""
    for c in _lists(batches):
        keep = np.unique(np.concatenate(_places(c, every=True)))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(c[k][keep]).cast(pa.int32() if k in ("n", "pos") else pa.int64()) for k in (*_LIST, "part")], [*_LIST, "part"])


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _lists(batches):
        a, b = _pairs(c, every=True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _similar(pairs: DataFrame, maps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs whose whole sets are similar. Pairs go first by their wide maps; a bitmap of fixed size then tells most texts that
    are in no pair."""
    spark = docs.sparkSession

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
                most = _most_bits(n, m)
                ok = _near_maps(_maps_of(b.column("wide_a")), _maps_of(b.column("wide_b")), most)
                full_a, full_b = b.column("full_a"), b.column("full_b")
                for i in np.flatnonzero(ok & full_a.is_valid().to_numpy(zero_copy_only=False) & full_b.is_valid().to_numpy(zero_copy_only=False)):
                    ok[i] = _near_full(full_a[i].as_py(), full_b[i].as_py(), most[i])
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    for k in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}"), F.col("full").alias(f"full_{k}")), k)
    pairs = cut(pairs.mapInArrow(near, "a long, b long"), "tried")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).select(F.col("key").bitwiseAND(MAP_BITS - 1).alias("k"))
    words = wanted.groupBy(F.shiftright("k", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits")).collect()
    bitmap = np.zeros(MAP_BITS >> 6, np.int64)
    bitmap[[w["at"] for w in words]] = [w["bits"] for w in words]
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, first, key in _new_sets(batches, text):
            k = key & (MAP_BITS - 1)
            take = np.flatnonzero((shared.value[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1))
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(token.view(np.int64))).take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(key[take]), sets], ["key", "own"])

    sets = docs.select(F.col(f"`{text}`")).mapInArrow(work, "key long, own array<long>").groupBy("key").agg(F.first("own").alias("own"))
    left, right = (sets.select(F.col("key").alias(k), F.col("own").alias(f"own_{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("own_a", "own_b"))
    return cut(both.where((UP + DOWN) * overlap >= UP * (F.size("own_a") + F.size("own_b"))).select("a", "b"), "similar")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fingerprint: Callable | None = None, link: Callable | None = None) -> DataFrame:
    """(id, text_hash, component_id) of the rows that have an id: the smallest id reachable by pairs of similarity 0.8 or more.

    fingerprint(data, offsets) gives 64 bits for each text, link(reps(fp, rep)) pairs of reps that are near by them: verified first.
    """
    docs = docs.where(F.col(f"`{doc_id}`").isNotNull())
    kind = docs.schema[doc_id].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            token, first = shingles(*text_bytes(b.column("text")))
            wide = pa.array([x.tobytes() for x in _wide(token, first)], pa.binary())
            fp = np.zeros(b.num_rows, np.uint64) if fingerprint is None else fingerprint(*text_bytes(b.column("text")))
            columns = [b.column("id"), b.column("text_hash"), pa.array(_keys(token, first)), pa.array(np.diff(first).astype(np.int32)), wide, pa.array(_full(token, first), pa.binary()), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "key", "n", "wide", "full", "fp"])

    named = docs.select(F.col(f"`{doc_id}`").alias("id"), text_hash(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    rows = cut(named.mapInArrow(name, f"id {kind}, text_hash long, key long, n int, wide binary, full binary, fp long"), "sets")
    counted = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.max("n").alias("n"), F.max("wide").alias("wide"), F.max("full").alias("full"), F.min("fp").alias("fp")), "sets")
    maps = counted.select("key", "n", "wide", "full")
    total = rows.count()
    tried = links = docs.sparkSession.createDataFrame([], "a long, b long")
    if link is not None:
        tried = cut(_by_fingerprints(counted, link), "tried")
        links = _similar(tried, maps, docs, text)
    by_list = lambda df, *order: df.repartition("token").sortWithinPartitions("token", *order)
    lists = cut(by_list(_postings(docs, text, _frequent(docs, text, total)), "key").mapInArrow(_several, _LIST_SCHEMA), "lists")
    # How many of the indexed shingles of a set no other has: few in a text that others were made from.
    alone = lists.groupBy("key").agg((F.max(F.col("n") + 1 - F.expr(f"floor(({UP} * n + {DOWN - 1}) / {DOWN})")) - F.count("*")).alias("alone"))
    known = alone.join(_parts(links), "key", "left").withColumn("part", F.coalesce("part", "key"))
    once = by_list(lists.join(known, "key"), "alone", "key").mapInArrow(_first_round, "a long, b long").distinct()
    once = cut(once.join(tried, ["a", "b"], "left_anti"), "tried")
    links, tried = links.union(_similar(once, maps, docs, text)), tried.union(once)
    parts = cut(_parts(links), "parts")
    left = by_list(lists.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "key").mapInArrow(_open_entries, f"{_LIST_SCHEMA}, part long")
    rest = by_list(cut(left, "lists").join(maps.select("key", "wide"), "key"), "key").mapInArrow(_second_round, "a long, b long").distinct()
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"), "tried")
    if not rest.isEmpty():
        parts = _parts(links.union(_similar(rest, maps, docs, text)))
    # Sets to parts to smallest ids, and these back to sets and rows: a part or a set may be that of very many.
    sets = cut(counted.select("key", "least", "rows").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "sets")
    least = cut(sets.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "sets")
    found = cut(join_hot(sets, least, "part", "m", total).select("key", "component_id", "rows"), "sets")
    return join_hot(rows.select("id", "text_hash", "key"), found, "key", "rows", total).select("id", "text_hash", "component_id")


def _by_fingerprints(counted: DataFrame, link: Callable) -> DataFrame:
    """Pairs of sets to verify: those with equal fingerprints, as pairs with the smallest key, and what link finds between these."""
    reps = cut(counted.groupBy("fp").agg(F.min("key").alias("rep")), "fingerprints")
    equal = counted.select("fp", "key").join(reps, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    near = link(reps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(near).distinct()


def _parts(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("key"), F.col("component").alias("part"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
