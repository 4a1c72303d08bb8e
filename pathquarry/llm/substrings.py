"""Exact substring deduplication by bucket-pointer refinement of byte q-grams.

Every string of LENGTH bytes that also starts earlier (in a smaller doc_id, or earlier in its document) is found, and the bytes
it covers are removed. As in bucket-pointer refinement, positions are first put into buckets of equal q-grams; the bucket of 2q
bytes is named by the pair of bucket identifiers at the position and q bytes later, and names once made are used again (8, 16,
32, 64, and 100 = 64 and 64 at offset 36). Pointers are then dealt by their bucket and sorted on its identifiers: buckets with one
member are dropped, the others refined by the identifiers of what stands at later offsets, and sorted on these in turn. Three things
keep the refinement from seeing every position:

1. Of the 69 q-grams of 32 bytes in a string, the one with the least name (the first of equals) stands for it: equal strings have
   equal pointers. Neighbouring strings share theirs, so about one position in 35 is dealt out.
2. All strings of one pointer make a snippet. Snippets repeated as a whole are settled by their first occurrence.
3. Only first snippets whose q-gram also occurs in another snippet are refined to single strings: eight neighbours at a time share
   the bucket of their common 93 bytes, and with it go the 14 bytes around, seven of which belong to each string.

Identifiers are not ranks but 64-bit mixes of the identifiers that make them, so that tasks agree on them without exchanging tables,
and strings are never compared byte by byte. A string counts as repeated if two independent names agree (128 bits), a whole snippet
if its q-gram's name and a name of all its bytes do; of snippets that do share their q-gram only the latter's 64 bits decide.

Tasks stream what Spark has sorted, and hold no partition. Before each shuffle a task keeps one record of each bucket, so a bucket
with a third of all rows arrives as one record a task; a core that very many different strings share is taken in parts, whose
strings are dealt again by their own names.

Null and empty texts have no bytes. Rows of one doc_id are taken in the order of their text, equal rows in any order; a null
doc_id comes first. Texts of any length are cut into overlapping segments. Only doc_id and text are read, so other columns can't
clash. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, cut, mix64, numbered, pieces, text_bytes

LENGTH = 100
GRAM = 32
#: Starts of strings per segment of a long text, and records per local pre-aggregation.
SEGMENT = 1 << 20
GATHER = 1 << 20
#: n in at * PACK + n: strings of one pointer.
PACK = 128
PROBE, KNOWN, GONE, STRING = 0, 1, 2, 3
#: Blocks of one core that a task takes at once.
MANY = 1 << 15
SCHEMA = "kind byte, h long, s long, doc long, span long"
NAMES = ["kind", "h", "s", "doc", "span"]
#: Strings of a block, and n in (first * BLOCK + place in the block) * BITS + n.
BLOCK, BITS = 8, 16
DEEP_NAMES = [*NAMES, "l", "r"]


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The bucket identifier of a pair of bucket identifiers."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + (b << np.uint64(31) | b >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


def buckets(data: np.ndarray, upto: int, salt: int) -> np.ndarray:
    """Identifiers of the buckets of upto (32 or 64) bytes at each position that has them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    name = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))[: max(0, len(data) - 7)].copy()
    size = 8
    while size < upto:
        name = _pair(name[: max(0, len(name) - size)], name[size:], salt)
        size *= 2
    return name


def _least(name: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least of name[i : i + width] for each i, by doubling."""
    value, at, span = name, np.arange(len(name), dtype=np.int32), 1
    while span * 2 <= width:
        later = value[span:] < value[:-span]
        value, at = np.where(later, value[span:], value[:-span]), np.where(later, at[span:], at[:-span])
        span *= 2
    if (rest := width - span) > 0:
        later = value[rest:] < value[:-rest]
        at = np.where(later, at[rest:], at[:-rest])
    return at


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, q-gram name, snippet name) of all pointers."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    name = buckets(data, GRAM, 1)
    at = _least(name, LENGTH - GRAM + 1)  # one for each string of the buffer
    size = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + offsets[:-1][row]
    if not len(row):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    point = at[start]
    new = np.concatenate([[True], (point[1:] != point[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(row)]]))
    a = start[first]
    with np.errstate(over="ignore"):
        snippet = mix64(SpanHash(data)(a, a + count + LENGTH - 1) + (point[first] - a).astype(np.uint64))
    return row[first], a - offsets[:-1][row[first]], count, name[point[first]], snippet


def segments(data: np.ndarray, offsets: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bases, bytes, offsets): neighbouring short texts together, long ones in segments that overlap by LENGTH - 1."""
    size = np.diff(offsets)
    i = 0
    while i < len(size):
        if size[i] > segment + LENGTH - 1:
            for base in range(0, int(size[i]) - LENGTH + 1, segment):
                part = data[offsets[i] + base : min(offsets[i] + base + segment + LENGTH - 1, offsets[i + 1])]
                yield np.array([i]), np.array([base]), part, np.array([0, len(part)])
            i += 1
            continue
        j = i + 1
        while j < len(size) and size[j] <= segment + LENGTH - 1 and offsets[j + 1] - offsets[i] <= 2 * segment:
            j += 1
        yield np.arange(i, j), np.zeros(j - i, np.int64), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _batch(kind: int, h, s, doc, span) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc), pa.array(span)], NAMES)


def _settle(h, s, doc, span) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each (h, s)'s first occurrence, by h, and of all later ones (which are gone)."""
    order = np.lexsort((span, doc, s, h))
    hh, ss = h[order], s[order]
    new = np.concatenate([[True], (hh[1:] != hh[:-1]) | (ss[1:] != ss[:-1])]) if len(order) else np.zeros(0, bool)
    # Repeats of one and the same record are no later occurrences.
    d, p = doc[order], span[order]
    twin = np.concatenate([[False], ~new[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1])]) if len(order) else new
    return order[new], order[~new & ~twin]


def _deal(h, s, doc, span) -> Iterator[pa.RecordBatch]:
    """Firsts, sorted by h: one probe of each h; where an h has several here, all of them are known to be repeated."""
    if not len(h):
        return
    new = np.concatenate([[True], h[1:] != h[:-1]])
    several = np.repeat(np.diff(np.concatenate([np.flatnonzero(new), [len(h)]])) > 1, np.diff(np.concatenate([np.flatnonzero(new), [len(h)]])))
    yield _batch(PROBE, h[new], s[new], doc[new], span[new])
    if several.any():
        yield _batch(KNOWN, h[several], s[several], doc[several], span[several])


def _gathered(parts: Iterator[tuple], work, most: int) -> Iterator[pa.RecordBatch]:
    """work(*columns) on about `most` records at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= most:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _some(b: pa.RecordBatch, which: np.ndarray) -> pa.RecordBatch:
    """Chosen rows, with the schema of _batch: what comes from Spark can differ from it in nullability."""
    return pa.RecordBatch.from_arrays(b.filter(pa.array(which)).columns[: len(NAMES)], NAMES)


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    h, s, doc, span = (b.column(c).to_numpy() for c in NAMES[1:])
    return h.view(np.uint64), s.view(np.uint64), doc, span


def _find_pointers(batches: Iterator[pa.RecordBatch], segment: int, gather: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for b in pieces(batches, "text", segment):
            doc = b.column("doc").to_numpy()
            for rows, bases, data, offsets in segments(*text_bytes(b.column("text")), segment):
                row, a, n, h, s = pointers(data, offsets)
                yield h, s, doc[rows[row]], (a + bases[row]) * PACK + n

    def work(h, s, doc, span):
        first, gone = _settle(h, s, doc, span)
        if len(gone):
            yield _batch(GONE, h[gone], s[gone], doc[gone], span[gone])
        yield from _deal(h[first], s[first], doc[first], span[first])

    return _gathered(parts(), work, gather)


class _Deal:
    """Firsts in the order of h, in any number of parts: one probe of each h, and all of an h that has several here as known."""

    def __init__(self):
        self.last, self.seen = None, False  # the last row so far, which the next one tells about, and whether its h came before it

    def add(self, *columns: np.ndarray, probes: bool = True) -> Iterator[pa.RecordBatch]:
        if not len(columns[0]):
            return
        if self.last is not None:
            columns = tuple(np.concatenate(x) for x in zip(self.last, columns, strict=True))
        same = columns[0][1:] == columns[0][:-1]
        before = np.concatenate([[self.seen], same])
        yield from self._rows(columns, ~before[:-1] & probes, before[:-1] | same)
        self.last, self.seen = tuple(x[-1:].copy() for x in columns), bool(before[-1])

    def close(self, probes: bool = True) -> Iterator[pa.RecordBatch]:
        if self.last is not None:
            yield from self._rows(self.last, np.array([not self.seen and probes]), np.array([self.seen]))

    @staticmethod
    def _rows(columns, probe: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind, which in ((PROBE, np.flatnonzero(probe)), (KNOWN, np.flatnonzero(known))):
            if len(which):
                yield _batch(kind, *(x[which] for x in columns))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and h. Probes that meet another of their h are known to be repeated, others are dropped; the rest passes."""
    deal = _Deal()
    for b in batches:
        probe = b.column("kind").to_numpy() == PROBE
        yield from deal.add(*(x[probe] for x in _columns(b)), probes=False)
        if not probe.all():
            yield _some(b, ~probe)
    yield from deal.close(probes=False)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows sorted by bucket identifiers h and s, then by place: (columns, first of its bucket, later occurrence)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = _columns(b)
        both = columns if last is None else tuple(np.concatenate(x) for x in zip(last, columns, strict=True))
        equal = [x[1:] == x[:-1] for x in both]
        if last is None:
            equal = [np.concatenate([[False], x]) for x in equal]
        first = ~(equal[0] & equal[1])
        # Repeats of one and the same record are no later occurrences.
        yield columns, first, ~first & ~(equal[2] & equal[3])
        last = tuple(x[-1:].copy() for x in columns)


def _first_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of an (h, s) are in one task: later occurrences are gone, first ones are dealt by h again."""
    deal = _Deal()
    for columns, first, gone in _firsts(batches):
        if gone.any():
            yield _batch(GONE, *(x[gone] for x in columns))
        yield from deal.add(*(x[first] for x in columns))
    yield from deal.close()


def _last_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a string are in one task: every one but the first is gone."""
    for columns, _, gone in _firsts(batches):
        if gone.any():
            yield _batch(GONE, *(x[gone] for x in columns))


def blocks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(core names 1 and 2, block start, first string, strings, 7 bytes before the core, 7 bytes behind it) of strings by their sorted starts.

    Strings are put in blocks of eight by their distance from their pointer, so equal strings are in equal places of their blocks.
    All strings of a block hold its core of 93 bytes; what else a string holds are seven of the 14 bytes around it.
    """
    name = buckets(data, GRAM, 1)
    point = _least(name, LENGTH - GRAM + 1)[starts]
    block = point + (starts - point) // BLOCK * BLOCK
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    block = block[first]
    core, more = block + BLOCK - 1, LENGTH - BLOCK + 1 - 64
    one, two = (_pair(n[core], n[core + more], k) for k in (1, 2) for n in (buckets(data, 64, k),))
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 17,), "<u8", padded.tobytes(), strides=(1,))
    seven = np.uint64((1 << 56) - 1)
    return one, two, block, starts[first], count, words[block + 8] & seven, words[block + 8 + LENGTH] & seven


def _names(h, s, at, left, right) -> tuple[np.ndarray, np.ndarray]:
    """Both names of the at-th string of a block: its core's names with the bytes it holds around the core."""
    bits = (8 * at).astype(np.uint64)
    with np.errstate(over="ignore"):
        own = (at.astype(np.uint64) + np.uint64(1)) << np.uint64(58)
        return _pair(h + own, left >> bits, 3), _pair(s + own, right & ((np.uint64(1) << bits) - np.uint64(1)), 4)


def _unfold(h, s, doc, span, left, right):
    """(row, name 1, name 2, doc, packed start) of every string of the blocks."""
    n = span % BITS
    row = np.repeat(np.arange(len(h)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = span // BITS
    one, two = _names(h[row], s[row], (first % BLOCK)[row] + step, left[row], right[row])
    return row, one, two, doc[row], ((first // BLOCK)[row] + step) * PACK + 1


def _runs(doc: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    """Gone strings, neighbouring ones put together."""
    order = np.lexsort((span, doc))
    doc, start = doc[order], span[order] // PACK
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    count = np.diff(np.concatenate([new, [len(doc)]]))
    part = -(-count // (PACK - 1))
    row = np.repeat(np.arange(len(new)), part)
    k = (np.arange(len(row)) - np.repeat(np.cumsum(part) - part, part)) * (PACK - 1)
    return _deep(GONE, np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64), doc[new][row], (start[new][row] + k) * PACK + np.minimum(count[row] - k, PACK - 1), None, None)


def _deep(kind: int, h, s, doc, span, left, right) -> pa.RecordBatch:
    flat = _batch(kind, h, s, doc, span)
    ends = [pa.nulls(len(doc), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (left, right)]
    return pa.RecordBatch.from_arrays([*flat.columns, *ends], DEEP_NAMES)


def _deep_columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return *_columns(b), *(b.column(c).to_numpy().view(np.uint64) for c in DEEP_NAMES[-2:])


def _refine(batches: Iterator[pa.RecordBatch], segment: int, gather: int) -> Iterator[pa.RecordBatch]:
    """The strings of the snippets in question, in blocks; strings that come later within the task are gone."""

    def parts():
        for b in pieces(batches, "text", segment):
            data, offsets = text_bytes(b.column("text"))
            doc, spans = b.column("doc").to_numpy(), b.column("spans")
            at = spans.offsets.to_numpy()
            runs = spans.values.to_numpy()[at[0] : at[-1]]  # a slice's values are those of the whole
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            n = runs % PACK
            of = np.repeat(np.arange(len(runs)), n)
            starts = np.unique((runs // PACK + offsets[row])[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
            for low in range(0, len(data), 2 * segment):  # one turn but for very long texts
                own = starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + 2 * segment)]
                if not len(own):
                    continue
                left = max(0, low - BLOCK)
                h, s, block, first, count, before, behind = blocks(data[left : low + 2 * segment + 3 * LENGTH], own - left)
                row_of = np.searchsorted(offsets, first + left, "right") - 1
                yield h, s, doc[row_of], ((first + left - offsets[row_of]) * BLOCK + first - block) * BITS + count, before, behind

    def work(h, s, doc, span, left, right):
        row, one, two, docs, starts = _unfold(h, s, doc, span, left, right)
        first, gone = _settle(one, two, docs, starts)
        if len(gone):
            yield _runs(docs[gone], starts[gone])
        keep = np.unique(row[first])
        yield _deep(KNOWN, h[keep], s[keep], doc[keep], span[keep], left[keep], right[keep])

    return _gathered(parts(), work, gather // BLOCK)


def _later_strings(batches: Iterator[pa.RecordBatch], most: int = MANY) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by core: every string but its first occurrence is gone.

    A core with more than `most` blocks is taken in parts; what is first in its part is handed on as a string, to be dealt by its own
    names, so no task holds a whole core however many blocks share it.
    """
    held: list[tuple] = []  # blocks of the last core so far
    parted = False

    def settle(columns: tuple, hand_on: bool) -> Iterator[pa.RecordBatch]:
        _, one, two, docs, starts = _unfold(*columns)
        first, gone = _settle(one, two, docs, starts)
        if len(gone):
            yield _flat(_runs(docs[gone], starts[gone]))
        if hand_on:
            yield _batch(STRING, one[first], two[first], docs[first], starts[first])

    for b in batches:
        gone = b.column("kind").to_numpy() == GONE
        if gone.any():
            yield _some(b, gone)
        if gone.all():
            continue
        columns = _deep_columns(b.filter(pa.array(~gone)))
        if held:
            columns = tuple(np.concatenate(x) for x in zip(*held, columns, strict=True))
            held = []
        h, s = columns[:2]
        new = np.flatnonzero((h[1:] != h[:-1]) | (s[1:] != s[:-1])) + 1
        if parted and len(new):  # the end of a core of which parts were handed on
            yield from settle(tuple(x[: new[0]] for x in columns), True)
            columns, parted = tuple(x[new[0] :] for x in columns), False
            new = new[1:] - new[0]
        last = int(new[-1]) if len(new) else 0
        if last:
            yield from settle(tuple(x[:last] for x in columns), False)
        rest = tuple(x[last:] for x in columns)
        if len(rest[0]) > most:
            yield from settle(rest, True)
            parted = True
        elif len(rest[0]):
            held = [rest]
    if held:
        yield from settle(held[0], parted)


def _flat(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(b.columns[: len(NAMES)], NAMES)


def _cover(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes of packed spans of removed strings."""
    spans = np.sort(spans)
    a, b = spans // PACK, spans // PACK + spans % PACK + LENGTH - 1
    b = np.maximum.accumulate(b)
    cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[cut].tolist(), b[np.concatenate([cut[1:], [len(a)]]) - 1].tolist(), strict=True))


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT, gather: int = GATHER, many: int = MANY) -> DataFrame:
    """doc_id, text, and runs: array of (start, end) in bytes, the maximal runs to remove."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows, ids = own.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        own = own.withColumn("doc", F.col("doc_id"))
    else:
        own = cut(numbered(own, [F.col("doc_id").asc_nulls_first(), F.col("text")], "doc"), "substring-rows")

    def dealt(df: DataFrame, by, work, *order: str) -> DataFrame:
        """Rows of one bucket in one task, sorted by bucket identifiers (Spark spills what doesn't fit), streamed through work."""
        return cut(df.repartition(by).sortWithinPartitions(*order).mapInArrow(work, SCHEMA), "substrings")

    both, place = F.xxhash64("h", "s"), ("h", "s", "doc", "span")
    # What is settled only passes through, so it is spread by place, however many share a bucket.
    by_gram = F.when(F.col("kind") == PROBE, F.col("h")).when(F.col("kind") == GONE, F.xxhash64("doc", "span")).otherwise(both)
    found = own.where(F.octet_length("text") >= LENGTH).select("doc", "text").mapInArrow(partial(_find_pointers, segment=segment, gather=gather), SCHEMA)
    found = dealt(found, by_gram, _repeated, "kind", "h")
    snippets = dealt(found.where(F.col("kind") == KNOWN), both, _first_snippets, *place)
    doubt = dealt(snippets.where(F.col("kind") != GONE), by_gram, _repeated, "kind", "h")
    doubt = doubt.groupBy("doc").agg(F.collect_list("span").alias("spans"))
    strings = own.select("doc", "text").join(doubt, "doc").mapInArrow(partial(_refine, segment=segment, gather=gather), f"{SCHEMA}, l long, r long")
    strings = dealt(strings, F.when(F.col("kind") == GONE, F.xxhash64("doc", "span")).otherwise(both), partial(_later_strings, most=many), "h", "s")
    gone = [x.where(F.col("kind") == GONE).select("doc", "span") for x in (found, snippets, strings)]
    parted = strings.where(F.col("kind") == STRING)
    if not parted.isEmpty():
        gone.append(dealt(parted, both, _last_strings, *place).select("doc", "span"))
    gone = reduce(DataFrame.union, gone).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    return own.join(gone, "doc", "left").select("doc_id", "text", "spans")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **sizes) -> DataFrame:
    """doc_id, kept (the remaining bytes; no longer text where a character was cut), runs (array of start, end), n_bytes."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, runs, sizes = b.column("spans"), [], [], []
            for r, value in enumerate(b.column("text").cast(pa.large_binary())):
                data = value.as_py()
                own = _cover(np.array(spans[r].as_py(), np.int64), len(data)) if spans[r].is_valid else []
                at = [0, *(x for run in own for x in run), len(data)]
                kept.append(b"".join(data[i:j] for i, j in zip(at[::2], at[1::2], strict=True)))
                runs.append([{"start": i, "end": j} for i, j in own])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(runs, kind), pa.array(sizes, pa.int64())], ["doc_id", "kept", "runs", "n_bytes"])

    return removed(docs, text, doc_id, **sizes).mapInArrow(work, "doc_id long, kept binary, runs array<struct<start:long,end:long>>, n_bytes long")
