"""The query language: text to a disjunction of conjunctions of terms. Pure Python, nothing here touches Spark.

    query := group { "|" group }      groups are alternatives; `or:` also begins one
    group := { term }                 all must hold; an empty group disappears
    term  := ["or:"] ["and:"] ["not:"] ["!"] body
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.derive import attribute_mask, fold, is_absolute
from .literals import date_bounds, size_bounds

WILD = set("*?[#")


@dataclass(frozen=True)
class Options:
    """What a search is told. now: Unix seconds; tz_offset: seconds that local time is ahead of UTC."""

    query: str = ""
    path: str | None = None
    exclude_path: str | None = None
    include_all: bool = False
    match_path: bool = False
    regex: bool = False
    match_case: bool = False
    match_whole_word: bool = False
    max_results: int = 100
    offset: int = 0
    sort: str = "name"
    content: tuple[str, ...] = ()
    content_paths: tuple[str, ...] | None = None
    now: int = 1_706_616_000
    tz_offset: int = 0
    glued_type_filter: bool = False
    bytewise: bool = True


@dataclass(frozen=True)
class Term:
    negated: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class Name(Term):
    pattern: str
    case: bool = False
    whole_word: bool = False
    start: bool = False
    end: bool = False
    literal: bool = False
    on_path: bool = False


@dataclass(frozen=True)
class Regex(Term):
    pattern: str
    case: bool = False


@dataclass(frozen=True)
class Scope(Term):
    path: str


@dataclass(frozen=True)
class Extension(Term):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Number(Term):
    """low <= column <= high."""

    column: str
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Time(Term):
    """low <= column < high, in local wall seconds."""

    column: str
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Kind(Term):
    is_dir: bool


@dataclass(frozen=True)
class Attributes(Term):
    mask: int


@dataclass(frozen=True)
class Duplicate(Term):
    """The lower-cased name occurs more than once."""


@dataclass(frozen=True)
class Never(Term):
    pass


Query = list[list[Term]]
# Attribute names after `is:`.
IS_ATTRIBUTE = {
    "hidden": 0x2, "system": 0x4, "readonly": 0x1, "archive": 0x20, "temporary": 0x100, "compressed": 0x800, "encrypted": 0x4000, "offline": 0x1000,
    "reparse": 0x400, "not-content-indexed": 0x2000, "nci": 0x2000, "normal": 0x80,
}


def content_terms(query: str) -> tuple[str, tuple[str, ...]]:
    """(query without them, needles): `content:word`, `content:"a phrase"` and `"content:a phrase"`, outside other quotes."""
    out, needles, i = [], [], 0
    while i < len(query):
        if query.startswith('"content:', i):
            end = query.find('"', i + 1)
            end = len(query) if end < 0 else end
            needles.append(query[i + 9 : end])
            i = end + 1
        elif query.startswith("content:", i) and (i == 0 or query[i - 1].isspace() or query[i - 1] == "|"):
            m = re.compile(r'"([^"]*)"?|(\S*)').match(query, i + 8)
            needles.append(m[1] if m[1] is not None else m[2])
            i = m.end()
        elif query[i] == '"':
            end = query.find('"', i + 1)
            end = len(query) if end < 0 else end + 1
            out.append(query[i:end])
            i = end
        else:
            out.append(query[i])
            i += 1
    return " ".join("".join(out).split(" ")).strip() if needles else query, tuple(needles)


def split_terms(query: str) -> list[list[str]]:
    """Groups of raw terms; quotes keep blanks and bars together and stay in the raw term."""
    groups, word, quoted = [[]], "", False
    for c in query + " ":
        if c == '"':
            quoted = not quoted
        if not quoted and (c.isspace() or c == "|"):
            if word:
                groups[-1].append(word)
            word = ""
            if c == "|":
                groups.append([])
        else:
            word += c
    if word.strip():  # an open quote runs to the end
        groups[-1].append(word[:-1])
    return groups


def _unquote(s: str) -> str:
    return s.replace('"', "")


def parse(options: Options) -> Query:
    """Groups of terms; no groups matches everything."""
    if options.regex:
        return [[Regex(options.query, options.match_case)]] if options.query else []
    groups: Query = []
    metric = False
    for raw_group in split_terms(options.query):
        group: list[Term] = []
        for raw in raw_group:
            body, negated = raw, False
            if body.lower().startswith("metric:"):
                metric, body = True, body[7:]
            if body.lower().startswith("or:"):
                body = body[3:]
                groups.append(group)
                group = []
            if body.lower().startswith("and:"):
                body = body[4:]
            if body.lower().startswith("not:"):
                body, negated = body[4:], True
            if body.startswith("!") and len(body) > 1:
                body, negated = body[1:], not negated
            if body:
                terms = _body(body, negated, metric, options)
                group += [replace(t, negated=t.negated != negated) for t in terms]
        groups.append(group)
    return [g for g in groups if g]


def _body(body: str, negated: bool, metric: bool, o: Options) -> list[Term]:
    low = body.lower()
    value = lambda n: _unquote(body[n:])
    plain = lambda p, **more: Name(p, case=o.match_case, whole_word=o.match_whole_word, **more)
    if body.startswith("regex:"):
        return [Regex(value(6), o.match_case)]
    if body.startswith("case:"):
        return [Name(value(5), case=True, whole_word=o.match_whole_word)]
    for key in ("ww:", "wholeword:"):
        if body.startswith(key):
            return [Name(value(len(key)), case=o.match_case, whole_word=True)]
    if body.startswith("path:"):
        return [Scope(value(5))]
    if body.startswith("ext:"):
        names = tuple(fold(x.strip().lstrip(".")) for x in value(4).split(",") if x.strip().lstrip("."))
        return [Extension(names) if names else Never()]
    if low.startswith("attrib:"):
        letters = value(7)
        inner = letters.startswith("!")
        mask = attribute_mask(letters[1:] if inner else letters)
        return [Attributes(mask, negated=inner) if mask else Never()]
    for key, is_dir in (("folder:", True), ("file:", False)):
        if body.startswith(key):
            glued = [plain(value(len(key)))] if o.glued_type_filter and value(len(key)) and not negated else []
            return [Kind(is_dir), *glued]
    if low.startswith("is:"):
        what = value(3).lower()
        if what in ("folder", "directory", "file"):
            return [Kind(what != "file")]
        return [Attributes(IS_ATTRIBUTE[what]) if what in IS_ATTRIBUTE else Never()]
    for key, column in (("size:", "size"), ("len:", "name_length"), ("frn:", "file_ref")):
        if low.startswith(key):
            bounds = size_bounds(value(len(key)), metric and column != "file_ref")
            return [Number(column, *bounds) if bounds else Never()]
    for key, column in (("dm:", "modified"), ("dc:", "created"), ("da:", "accessed")):
        if low.startswith(key):
            window = date_bounds(value(3), o.now + o.tz_offset)
            return [Time(column, *window) if window else Never()]
    if low == "dupe:filename":
        return [Duplicate()]
    if negated and body.startswith("<") and body.endswith(">"):
        return [plain(body[1:-1], literal=True)]
    if is_absolute(_unquote(body)):
        return [Scope(_unquote(body))]
    for key, ends in (("start-with:", "start"), ("prefix:", "start"), ("end-with:", "end"), ("suffix:", "end")):
        if low.startswith(key):
            return [plain(value(len(key)), **{ends: True})]
    if body.startswith('"'):
        return [plain(_unquote(body), literal=True)]
    body = _unquote(body)
    start, end = body.startswith("^") and len(body) > 1, body.endswith("$") and len(body) > 1
    text = body[start : len(body) - end]
    on_path = negated and any(c in text for c in "\\/")
    return [plain(text, start=start, end=end, literal=on_path, on_path=on_path)]
