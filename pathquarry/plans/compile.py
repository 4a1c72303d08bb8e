"""Parsed queries to column expressions. Everything comparable stays a bare column against a literal, so it can be pushed down."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import fold, name_length, trim_separators
from ..schema import EPOCH, TICKS
from . import language as L

_REJECTED = re.compile(r"\(\?[=!<>]|\(\?<[=!]|\\[1-9kGZ]|[*+?]\+|\{[\d,]*\}\+")


def byte_view(c: Column) -> Column:
    """One character for each UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def wildcard_regex(pattern: str, case: bool, bytewise: bool = True) -> str:
    """Java regex of a whole-string wildcard pattern; with bytewise over byte_view of the text."""

    def one(b: int) -> str:
        c = chr(b)
        if not case and c.isascii() and c.isalpha():
            return rf"[\x{{{ord(c.lower()):x}}}\x{{{ord(c.upper()):x}}}]"
        return rf"\x{{{b:x}}}"

    codes = list(pattern.encode()) if bytewise else [ord(c) for c in pattern]
    out, i = [], 0
    star, mark, hashed, opened, back = (ord(c) for c in "*?#[\\")
    while i < len(codes):
        b = codes[i]
        if b == star:
            j = i
            while j < len(codes) and codes[j] == star:
                j += 1
            out.append(r"[^\\]*" if j - i == 1 else ".*")
            i = j
            continue
        if b == back and i + 1 < len(codes) and codes[i + 1] in (star, mark, hashed, opened, back):
            out.append(one(codes[i + 1]))
            i += 2
            continue
        if b == opened and (found := _class(codes, i)):
            items, negated, i = found
            if not case:
                items |= {ord(v) for x in items if x < 128 and chr(x).isalpha() for v in (chr(x).lower(), chr(x).upper())}
            listed = "".join(rf"\x{{{x:x}}}" for x in sorted(items))
            out.append((f"[^{listed}]" if listed else ".") if negated else (f"[{listed}]" if listed else "(?!)"))
            continue
        out.append(r"[^\\]" if b == mark else "[0-9]" if b == hashed else one(b))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def _class(codes: list[int], i: int) -> tuple[set[int], bool, int] | None:
    """(members, negated, index behind it) of the class that opens at i; None if it does not close."""
    j = i + 1
    negated = j < len(codes) and codes[j] == ord("!")
    j += negated
    items, first = set(), True
    while j < len(codes):
        if codes[j] == ord("]") and not first:
            return items, negated, j + 1
        first = False
        if j + 2 < len(codes) and codes[j + 1] == ord("-") and codes[j + 2] != ord("]"):
            low, high = sorted((codes[j], codes[j + 2]))
            items |= set(range(low, high + 1))
            j += 3
        else:
            items.add(codes[j])
            j += 1
    return None


def java_regex(pattern: str, case: bool) -> str | None:
    """The pattern for rlike; None where the language has no such pattern, which then matches nothing."""
    if _REJECTED.search(pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        try:  # Unicode classes and the like are Java's, not Python's
            re.compile(re.sub(r"\\[pP]\{\w+\}|\\[pP]\w|\\x\{[0-9A-Fa-f]+\}|\\z", "x", pattern))
        except re.error:
            return None
    return ("(?U)" if case else "(?iuU)") + pattern


def under(key: Column, path: str, separators: str) -> Column:
    """key is path or continues with a separator; three prefix tests, which push down."""
    if path in ("/", "\\"):
        return key.startswith(path)
    return reduce(or_, [key == path, *(key.startswith(path + s) for s in separators)])


def _scope_text(path: str) -> str:
    """Separators as in the path's own style, folded, without a trailing one."""
    drive = re.match(r"[A-Za-z]:", path)
    path = path.replace("/", "\\") if drive or ("\\" in path and "/" not in path) else path.replace("\\", "/")
    return trim_separators(fold(path))


def filetime_window(c: Column, low: int | None, high: int | None, offset: int) -> Column:
    """low <= local seconds of c < high, with the column bare. Times before 1970 count as 1970."""
    tests = []
    if low is not None and low - offset > 0:
        tests.append(c >= EPOCH + (low - offset) * TICKS)
    if high is not None:
        tests.append(c < EPOCH + (high - offset) * TICKS if high - offset > 0 else F.lit(False))
    return reduce(and_, tests, F.lit(True))


def _name(t: L.Name, o: L.Options) -> Column:
    path = o.match_path or t.on_path
    p = t.pattern if t.case else fold(t.pattern)
    target = F.col(("path" if path else "name") if t.case else ("lower_path" if path else "lower_name"))
    if t.start and t.end:
        return target == p
    if t.start:
        return target.startswith(p)
    if t.end:
        return target.endswith(p)
    if t.whole_word:
        return F.array_contains(F.split(target, r"[^A-Za-z0-9_.\-]", -1), p)
    if t.literal or not L.WILD & set(p):
        return target.contains(p)
    raw = F.col("path" if path else "name")
    match = (byte_view(raw) if o.bytewise else raw).rlike(wildcard_regex(t.pattern, t.case, o.bytewise))
    # `*.x` without a further point implies the stored extension, which the reader can prune by.
    if not path and (m := re.fullmatch(r"\*\.([^*?\[#.\\/]+)", p)):
        match = ((F.col("extension") == fold(m[1])) | F.col("extension").isNull()) & match
    return match


def compile_term(t: L.Term, o: L.Options) -> Column:
    match t:
        case L.Never():
            out = F.lit(False)
        case L.Name():
            out = _name(t, o)
        case L.Regex(pattern, case):
            java = java_regex(pattern, case)
            target = ("path" if case else "lower_path") if o.match_path else "name"
            out = F.lit(False) if java is None else F.col(target).rlike(java)
        case L.Scope(path):
            out = under(F.col("lower_path"), _scope_text(path), "\\/:")
        case L.Extension(names):
            out = F.coalesce(F.col("extension").isin(*names), F.lit(False)) if t.negated else F.col("extension").isin(*names)
        case L.Number(column, low, high):
            c = name_length(F.col("name")) if column == "name_length" else F.col(column)
            out = reduce(and_, [*([c >= low] if low is not None else []), *([c <= high] if high is not None else [])], F.lit(True))
        case L.Time(column, low, high):
            out = filetime_window(F.col(column), low, high, o.tz_offset)
        case L.Kind(is_dir):
            out = F.col("is_dir") if is_dir else ~F.col("is_dir")
        case L.Attributes(mask):
            out = F.col("attributes").isin(0, 0x80) if mask == 0x80 else F.col("attributes").bitwiseAND(mask) == mask
        case L.Duplicate():
            out = F.col("__dupe")
    return ~out if t.negated else out


def predicate(query: L.Query, o: L.Options) -> Column:
    groups = [reduce(and_, [compile_term(t, o) for t in g]) for g in query]
    return reduce(or_, groups) if groups else F.lit(True)


def gates(o: L.Options) -> Column:
    """What must hold beside the query: default excludes, scope, excluded paths."""
    key, out = F.col("lower_path"), F.lit(True)
    if not o.include_all:
        out = out & ~F.col("excluded")
    if o.path:
        out = out & under(key, _scope_text(o.path), "\\/:")
    for entry in filter(None, (x.strip() for x in (o.exclude_path or "").split(";"))):
        text = _scope_text(entry)
        if L.is_absolute(entry):
            out = out & ~under(key, text, "\\/")
        else:
            out = out & ~key.rlike(rf"(^|[\\/:]){re.escape(text)}([\\/]|$)")
    return out


def apply(files: DataFrame, o: L.Options, contents: DataFrame | None = None) -> DataFrame:
    """The rows of files that options select. contents: (path_key, body), needed for content terms."""
    rest, needles = L.content_terms(o.query) if not o.regex else (o.query, ())
    needles = (*o.content, *needles)
    o = L.replace(o, query=rest)
    query = L.parse(o)
    out = files
    if any(isinstance(t, L.Duplicate) for g in query for t in g):
        # Counted over the whole catalog, with partial aggregation; only names that are repeated go on.
        names = files.groupBy("lower_name").agg(F.count("*").alias("__n")).where("__n > 1").select("lower_name", F.lit(True).alias("__dupe"))
        out = out.join(names, "lower_name", "left").withColumn("__dupe", F.coalesce("__dupe", F.lit(False)))
    out = out.where(gates(o)).where(predicate(query, o))
    if o.content_paths is not None:
        listed = files.sparkSession.createDataFrame([(p,) for p in o.content_paths], "lower_path string")
        out = out.join(listed, "lower_path", "left_semi")
    if needles:
        from ..operators.content import matching

        out = out.join(matching(contents, needles), F.col("lower_path") == F.col("path_key"), "left_semi")
    return out.drop("__dupe") if "__dupe" in out.columns else out
