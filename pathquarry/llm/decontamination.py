"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names (capitalised words inside a sentence; neighbours make one name) become typed slots, all
other words are lower-cased. Windows of WIDTH tokens are hashed and looked up in a hash table of the benchmark's windows (whole
items where these are shorter). Matching windows of a document and an item at one distance are put together, and their slots are
compared: an item's value must stand for one value in the document wherever it occurs, and a name for one name only. What passes
is an exact leak or a re-parameterised one, and counts if it covers half of the item's tokens, or LONG of them.

Slots need literal words around them: windows with fewer than LITERALS, and items with fewer than LEAST tokens, have no template.
So every item is also looked up as said: windows of plain tokens, lower-cased, no slots and no joined names. A run of equal tokens
counts if it is half of the item or LONG tokens, and no shorter than WIDTH tokens or the item. An item of one word is thus found in
every text that has this word. Characters of scripts written without spaces (Han, kana, Thai, Lao, Burmese, Khmer, Tibetan) are
tokens of their own, so LONG is 25 characters there.

The table of a benchmark is broadcast in blocks of at most `most_windows` windows, each with a pass of its own over the documents.
Null and empty texts hold nothing; items without a letter or digit can't be found. Repeated rows are found alike. Texts are used
whole. `flag` keeps all columns (a column named `leaks` is replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SpanHash, cut, mix64, pieces, text_bytes

WIDTH = 8
LEAST = 4
#: Literal words that a window needs, so that slots alone never match.
LITERALS = 3
SHARE = 0.5
LONG = 25
# Unit words that may follow a number.
UNITS = """
km m cm mm mile miles foot feet inch inches yard yards kg g mg t ton tons lb lbs pound pounds ounce ounces l ml litre litres liter liters gallon gallons
s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent
kmh mph kph celsius fahrenheit degree degrees watt watts kw kwh volt volts joule joules hz khz mhz ghz kb mb gb tb byte bytes bit bits meter meters metre metres
""".split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA11CE5A11CE50001, 0xA11CE5A11CE50002, 0xA11CE5A11CE50003))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n\"")] = True
#: Second bytes with which these lead bytes begin a character of a script written without spaces.
_UNSPACED = np.zeros((256, 256), bool)
for _lead, _low, _high in ((0xE0, 0xB8, 0xBF), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xEF, 0xA4, 0xAB), (0xEF, 0xBC, 0xBE), (0xF0, 0xA0, 0xB3), *((x, 0x80, 0xBF) for x in range(0xE3, 0xEA))):
    _UNSPACED[_lead, _low : _high + 1] = True
#: Their punctuation, as the last two bytes behind 0xE3 and 0xEF.
_SIGNS = {0xE3: np.zeros(1 << 16, bool), 0xEF: np.zeros(1 << 16, bool)}
_SIGNS[0xE3][[0x8080 + x for x in (*range(5), *range(8, 33), 48)]] = True
_SIGNS[0xEF][[*range(0xBC81, 0xBC90), *range(0xBC9A, 0xBCA1), *range(0xBCBB, 0xBCC0), 0xBD80, *range(0xBD9B, 0xBDA6)]] = True
_LEAK = T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("windows", "covered", "tokens")), T.StructField("share", T.DoubleType()), T.StructField("verbatim", T.BooleanType())])
_LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("windows", pa.int32()), ("covered", pa.int32()), ("tokens", pa.int32()), ("share", pa.float64()), ("verbatim", pa.bool_())]))


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.cumsum([0, *(len(w.encode()) for w in words)])
    return SpanHash(data)(at[:-1], at[1:])


_UNIT_HASHES = np.sort(_hash(UNITS))


def _unspaced(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where characters of unspaced scripts begin; their bytes become kind 3, those of their punctuation kind 0."""
    lead = np.flatnonzero(data[:-2] >= 0xE0)
    lead = lead[_UNSPACED[data[lead], data[lead + 1]]]
    begins = np.zeros(len(data) + 1, bool)
    begins[lead] = True
    sign = np.zeros(len(lead), bool)
    for byte, signs in _SIGNS.items():
        own = data[lead] == byte
        sign[own] = signs[data[lead[own] + 1].astype(np.int64) << 8 | data[lead[own] + 2]]
    for k in range(3):
        kind[lead + k] = np.where(sign, 0, 3)
    long = lead[data[lead] == 0xF0]
    kind[long + 3] = 3
    return begins


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, value, first, plain, plain's first): token hashes with slots, as said, and each text's first token; then
    token hashes as said without joined names, and each text's first of these."""
    n = len(data)
    none, zeros = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if not n:
        return none, none, zeros, none, zeros
    digit, letter = _DIGIT[data], _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    # A point or comma between digits belongs to the number.
    inner = np.zeros(n, bool)
    inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:] & ~edge[1 : n - 1] & ~edge[2:n]
    kind = np.where(digit | inner, 1, np.where(letter, 2, 0)).astype(np.int8)
    begins = _unspaced(data, kind)
    before = np.concatenate([[0], kind])[:n]
    starts = np.flatnonzero((kind > 0) & ((kind != before) | edge[:n] | begins[:n]))
    after = np.concatenate([kind, [0]])[1:]
    ends = np.flatnonzero((kind > 0) & ((kind != after) | edge[1:] | begins[1:])) + 1
    if not len(starts):
        return none, none, zeros, none, zeros
    hashes = SpanHash(LOWER[data])
    value = hashes(starts, ends)
    row = np.searchsorted(offsets, starts, "right")
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = new_row | np.concatenate([[True], stops[starts[1:]] > stops[ends[:-1]]])
    number = kind[starts] == 1
    follows = np.concatenate([[False], number[:-1]]) & ~new_row
    unit = follows & ~number & np.isin(value, _UNIT_HASHES)
    # Capitalised: an upper-case letter (ASCII, or the two-byte ones from A with grave to Thorn) before a lower-case byte.
    second = np.minimum(starts + 1, n - 1)
    accented = (data[starts] == 0xC3) & (data[second] >= 0x80) & (data[second] <= 0x9E)
    later = np.minimum(starts + np.where(accented, 2, 1), n - 1)
    capital = (_UPPER[data[starts]] | accented) & (later < ends) & ~_UPPER[data[later]]
    name = capital & ~opens
    template = value.copy()
    template[number], template[unit], template[name] = NUMBER, UNIT, NAME
    plain, plain_first = value, np.searchsorted(starts, offsets)
    goes_on = np.concatenate([[False], name[1:] & name[:-1]])
    if goes_on.any():  # neighbouring names are one slot
        head = np.flatnonzero(~goes_on)
        last = np.concatenate([head[1:], [len(starts)]]) - 1
        template, value, starts = template[head], hashes(starts[head], ends[last]), starts[head]
    return template, value, np.searchsorted(starts, offsets), plain, plain_first


def _windows(template: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of literals) of the windows that begin at each token; windows that leave their text are the caller's matter."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + template[k : k + n]
    slot = (template == NUMBER) | (template == UNIT) | (template == NAME)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    return mix64(h), literal[width:] - literal[:-width]


class Table:
    """The windows of some benchmark items by hash."""

    BITS = 22

    def __init__(self, items: list[tuple[int | None, str | None]]):
        items = [(i, t) for i, t in items if t]
        texts = [t.encode() for _, t in items]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        self.ids = [i for i, _ in items]
        self.template, self.value, self.first, plain, self.plain_first = canonical(data, offsets)
        self.by_width = self._index(self.template, self.first, LEAST, LITERALS)
        self.plain_by_width = self._index(plain, self.plain_first, 1, 0)

    @classmethod
    def _index(cls, token: np.ndarray, first: np.ndarray, least: int, literals: int) -> dict[int, tuple]:
        """width -> (hash, item, place in the item, filter) of the windows of items with `least` tokens, sorted by hash."""
        size = np.diff(first)
        out = {}
        for width in sorted({int(min(WIDTH, n)) for n in size if n >= least}):
            hashes, literal = _windows(token, width)
            item = np.searchsorted(first, np.arange(len(hashes)), "right") - 1
            at = np.arange(len(hashes)) - first[item]
            ok = (at + width <= size[item]) & (np.minimum(size[item], WIDTH) == width) & (literal >= literals)
            hashes, item, at = hashes[ok], item[ok], at[ok]
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << cls.BITS, bool)
            maybe[hashes & np.uint64((1 << cls.BITS) - 1)] = True
            out[width] = hashes[order], item[order], at[order], maybe
        return out

    @classmethod
    def _look_up(cls, by_width: dict[int, tuple], token: np.ndarray, first: np.ndarray) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
        """(text, item, distance) -> (place in the item, width) of the windows they share."""
        found: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for width, (hashes, item, at, maybe) in by_width.items():
            own, _ = _windows(token, width)
            pos = np.flatnonzero(maybe[own & np.uint64((1 << cls.BITS) - 1)])
            low, high = np.searchsorted(hashes, own[pos], "left"), np.searchsorted(hashes, own[pos], "right")
            row = np.searchsorted(first, pos, "right") - 1
            ok = (high > low) & (pos + width <= first[row + 1])
            for p, r, i, j in zip(pos[ok].tolist(), row[ok].tolist(), low[ok].tolist(), high[ok].tolist(), strict=True):
                for k in range(i, j):
                    found[r, int(item[k]), p - int(at[k])].append((int(at[k]), width))
        return found

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[dict]]:
        """The items found in each text that holds any."""
        template, value, first, plain, plain_first = canonical(data, offsets)
        found = self._look_up(self.by_width, template, first)
        parts: dict[tuple[int, int], list] = defaultdict(list)
        for (r, i, shift), spans in found.items():
            covered = sorted({q for a, width in spans for q in range(a, a + width)})
            here = np.array(covered)
            theirs = self.first[i] + here
            if self._consistent(theirs, value[shift + here]):
                parts[r, i].append((len(spans), covered, bool((self.value[theirs] == value[shift + here]).all())))
        out: dict[int, list[dict]] = defaultdict(list)
        for (r, i), runs in parts.items():
            tokens = int(self.first[i + 1] - self.first[i])
            covered = len({q for _, c, _ in runs for q in c})
            if covered >= SHARE * tokens or covered >= LONG:
                out[r].append({"item": i, "item_id": self.ids[i], "windows": sum(n for n, _, _ in runs), "covered": covered, "tokens": tokens, "share": covered / tokens, "verbatim": all(v for _, _, v in runs)})
        self._add_plain(out, self._look_up(self.plain_by_width, plain, plain_first))
        return out

    def _add_plain(self, out: dict[int, list[dict]], found: dict[tuple[int, int, int], list[tuple[int, int]]]) -> None:
        """Adds the items of which a text has a long enough run as said, if they aren't there yet."""
        have = {(r, x["item"]) for r, leaks in out.items() for x in leaks}
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (r, i, _), spans in found.items():
            if (r, i) in have:
                continue
            places, width = sorted(a for a, _ in spans), spans[0][1]
            begin = 0
            for k in range(1, len(places) + 1):
                if k == len(places) or places[k] > places[k - 1] + 1:
                    run = places[k - 1] + width - places[begin]
                    best[r, i] = max(best.get((r, i), (0, 0)), (run, k - begin))
                    begin = k
        for (r, i), (run, windows) in best.items():
            tokens = int(self.plain_first[i + 1] - self.plain_first[i])
            if run >= SHARE * tokens or run >= LONG:
                out[r].append({"item": i, "item_id": self.ids[i], "windows": windows, "covered": run, "tokens": tokens, "share": run / tokens, "verbatim": True})

    def _consistent(self, theirs: np.ndarray, said: np.ndarray) -> bool:
        """One value of the item is one value of the text; names also the other way round."""
        kind = self.template[theirs]
        for slot in (NUMBER, UNIT, NAME):
            pairs = set(zip(self.value[theirs[kind == slot]].tolist(), said[kind == slot].tolist(), strict=True))
            if len({a for a, _ in pairs}) < len(pairs) or (slot == NAME and len({b for _, b in pairs}) < len(pairs)):
                return False
        return True


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = True, most_windows: int = 2_000_000) -> DataFrame:
    """docs with leaks: the benchmark items found in each text (item_id, windows, covered, tokens, share, verbatim)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("__t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("__t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // (2 * most_windows)))  # two windows a token, which takes four bytes or so with what stands behind it
    docs = docs.drop("leaks").withColumn("leaks", F.lit(None).cast(T.ArrayType(_LEAK)))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "__t"), F.lit(blocks)) == k).collect()  # bounded by most_windows
        table = spark.sparkContext.broadcast(Table(sorted(((r[0], r[1]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))))
        rest = [c for c in docs.columns if c != "leaks" and (c != text or keep_text or k < blocks - 1)]
        take = list(dict.fromkeys([*rest, text, "leaks"]))
        schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("leaks", T.ArrayType(_LEAK))])

        def work(batches: Iterator[pa.RecordBatch], table=table, rest=rest) -> Iterator[pa.RecordBatch]:
            own = table.value
            for b in pieces(batches, text):
                leaks = own.leaks(*text_bytes(b.column(text)))
                have = b.column("leaks").to_pylist()
                both = [(have[r] or []) + sorted(leaks.get(r, []), key=lambda x: (x["item_id"] is None, x["item_id"] or 0)) for r in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(both, _LEAK_ARROW)], [*rest, "leaks"])

        docs = docs.select(*[f"`{c}`" for c in take]).mapInArrow(work, schema)
        if k < blocks - 1:
            docs = cut(docs)
    return docs


def pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row for each document and item found in it."""
    found = flag(docs, benchmark, keep_text=False, **how).where(F.size("leaks") > 0)
    return found.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode("leaks").alias("x")).select("doc_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    return flag(docs, benchmark, **how).where(F.size("leaks") == 0).drop("leaks")
