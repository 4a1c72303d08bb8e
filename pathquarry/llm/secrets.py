"""Secret scans: all rules in one minimal automaton, one pass over the bytes of every text.

A rule's matches are leftmost, longest and non-overlapping, as regular expression search finds them; a match whose body is too
short is dropped (and still ends where it ended). The pass tells whether a text holds any match; only in those texts are spans
located, by reading backwards from an accepting byte to the earliest start and forwards to the latest end.

Null and empty texts have no spans. Repeated rows give the same spans. Spans count code points, ends exclusive. Texts of any
length are read whole; memory grows with the longest text only. An empty table gives no rows. Other columns pass through, whatever
their names; `spans` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import compile_rules


@dataclass(frozen=True)
class Rule:
    """A match is head followed by body; it counts if the body has `least` bytes."""

    kind: str
    body: str
    head: str = ""
    least: int = 1

    @property
    def pattern(self) -> str:
        fold = "(?i)" if self.head.startswith("(?i)") else ""
        return f"{fold}{self.head.removeprefix('(?i)')}{self.body}"


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
#: What else is looked for: well-known published token formats. Bodies are open runs whose length is asked for afterwards: all eight
#: rules make 3,007 states (five made 737). A body of a fixed length would count its bytes in the states, beside those of hex, and
#: multiply them by its length, so tokens without a prefix of their own (as JSON web tokens are) are left out.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", least=32),
)
RULES = BASE + MORE
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.whole = compile_rules([r.pattern for r in rules])
        self.ahead = [compile_rules([r.pattern], anchored=True) for r in rules]
        self.back = [compile_rules([r.pattern], anchored=True, backwards=True) for r in rules]
        self.heads = [compile_rules([r.head], anchored=True) if r.head else None for r in rules]
        self._rows = self._lists = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None, "_lists": None, "_sink": None}

    def any(self, text: bytes) -> bool:
        """Each state is the list of the states that follow it, so one C loop runs the automaton; accepting leads to the sink."""
        if self._rows is None:
            a = self.whole
            self._sink: list = []
            self._sink.extend([self._sink] * a.step.shape[1])
            rows = [self._sink if m else [] for m in a.accept]
            for row, to in zip(rows, a.step.tolist(), strict=True):
                if row is not self._sink:
                    row.extend(rows[t] for t in to)
            self._rows = rows
        return reduce(getitem, text.translate(self.whole.classes), self._rows[self.whole.start]) is self._sink

    @staticmethod
    def _longest(a, codes: bytes, at: int, step: int, stop: int) -> int:
        """The farthest place where a run from `at` accepts, -1 if none."""
        s, best = a.start, at if a.accept[a.start] else -1
        rows, accept, dead = a.step, a.accept, a.dead
        while at != stop:
            s = rows[s, codes[at if step > 0 else at - 1]]
            at += step
            if accept[s]:
                best = at
            elif s == dead:
                break
        return best

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        if not self.any(text):
            return []
        a, n = self.whole, len(text)
        if self._lists is None:
            self._lists = a.step.tolist(), a.accept.tolist()
        rows, accept = self._lists
        done, coded, found = [0] * len(self.rules), {}, []
        s = a.start
        for i, c in enumerate(text.translate(a.classes), 1):
            s = rows[s][c]
            m = accept[s]
            while m:
                k = (m & -m).bit_length() - 1
                m &= m - 1
                if i <= done[k]:
                    continue
                if k not in coded:
                    coded[k] = text.translate(self.ahead[k].classes), text.translate(self.back[k].classes)
                start = self._longest(self.back[k], coded[k][1], i, -1, done[k])
                if start < 0:
                    continue
                done[k] = end = self._longest(self.ahead[k], coded[k][0], start, 1, n)
                body = start
                if (h := self.heads[k]) is not None:
                    body = start + self._longest(h, text[start:end].translate(h.classes), 0, 1, end - start)
                if end - body >= self.rules[k].least:
                    found.append((start, k, end))
        return sorted(found)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without text, with spans: array of (kind, start, end) by start, then in the order of the rules."""
    scanner = Scanner(rules)
    rest = [c for c in docs.columns if c not in (text, "spans")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("spans", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value in b.column(text).cast(pa.large_binary()):
                data = value.as_py() or b""
                spans = scanner.spans(data)
                if spans and not data.isascii():
                    ends = np.array([(s, e) for s, _, e in spans])
                    count = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[ends - 1]  # of the code points up to each end
                    count[ends == 0] = 0
                    spans = [(s, k, e) for (s, e), (_, k, _) in zip(count.tolist(), spans, strict=True)]
                out.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, kind)], [*rest, "spans"])

    return docs.select(*[f"`{c}`" for c in [*rest, text]]).mapInArrow(scan, schema)


def digest(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans of these kinds (None: all), comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
