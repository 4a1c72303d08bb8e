import datetime as dt

import pytest

from pathquarry.plans import language as L
from pathquarry.plans.compile import java_regex
from pathquarry.plans.literals import DAY, date_bounds, size_bounds, span

NOW = 1_785_600_000 + 5 * 3600
TODAY = NOW - NOW % DAY


def parse(text, **options):
    return L.parse(L.Options(query=text, **options))


def test_groups():
    assert parse("") == [] == parse(" | | ")
    assert [[t.pattern for t in g] for g in parse("a b|c or:d and:e")] == [["a", "b"], ["c"], ["d", "e"]]
    assert parse("or:and:not:x") == [[L.Name("x", negated=True)]]
    assert parse("!!x") == [[L.Name("!x", negated=True)]]


def test_words():
    assert parse('"a | b"') == [[L.Name("a | b", literal=True)]]
    assert parse("^a$ ^b c$ ^ $") == [[L.Name("a", start=True, end=True), L.Name("b", start=True), L.Name("c", end=True), L.Name("^"), L.Name("$")]]
    assert parse("case:Ab ww:c FILE:") == [[L.Name("Ab", case=True), L.Name("c", whole_word=True), L.Name("FILE:")]]
    assert parse("!<a>") == [[L.Name("a", literal=True, negated=True)]]
    assert parse("!a/b") == [[L.Name("a/b", literal=True, on_path=True, negated=True)]]
    assert parse(r"C:\x !/y") == [[L.Scope(r"C:\x"), L.Scope("/y", negated=True)]]
    assert parse('path:"C:/a b" ext:.RS,md,') == [[L.Scope("C:/a b"), L.Extension(("rs", "md"))]]
    assert parse("file:*.ts")[0] == [L.Kind(False)]
    assert parse("folder:src", glued_type_filter=True)[0] == [L.Kind(True), L.Name("src")]
    assert parse("start-with:ab end-with:c") == [[L.Name("ab", start=True), L.Name("c", end=True)]]


@pytest.mark.parametrize("text", ["size:garbage", "len:garbage", "frn:garbage", "dm:garbage", "dc:garbage", "da:garbage", "ext:", "attrib:q", "is:nothing", "dm:2024-99-01", "size:", "attrib:"])
def test_never(text):
    assert parse(text) == [[L.Never()]]


def test_attributes():
    assert parse("attrib:rh !attrib:!s is:nci") == [[L.Attributes(3), L.Attributes(4), L.Attributes(0x2000)]]
    assert parse("attrib:!d") == [[L.Attributes(16, negated=True)]]


def test_sizes():
    assert size_bounds("1mb") == (1 << 20, (2 << 20) - 1)
    assert size_bounds(">=1mb") == (1 << 20, None) and size_bounds(">1mb") == ((1 << 20) + 1, None) and size_bounds("<=1kb") == (None, 1024)
    assert size_bounds("1024") == (1024, 1024) and size_bounds("1kb..2kb") == (1024, 2048) and size_bounds("1.5kib") == (1536, 2559)
    assert size_bounds("1kb", True) == (1000, 1999) and size_bounds("1kib", True) == (1024, 2047) and size_bounds("tiny", True) == (None, 999)
    assert size_bounds("huge") == ((4 << 30) + 1, None) and size_bounds("empty") == (0, 0) and size_bounds("1xb") is None


def test_spans():
    unix = lambda y, m, d=1: (dt.date(y, m, d) - dt.date(1970, 1, 1)).days * DAY
    assert span("last7days", NOW) == (NOW - 7 * DAY, NOW + DAY) and span("prev7days", NOW) == (TODAY - 7 * DAY, TODAY) == span("previous7days", NOW)
    assert span("january", NOW) == (unix(2026, 1), unix(2026, 2)) and span("dec", NOW) == (unix(2026, 12), unix(2027, 1))
    assert span("mtd", NOW) == (unix(2026, 8), NOW) and span("ytd", NOW) == (unix(2026, 1), NOW) and span("qtd", NOW) == (unix(2026, 7), NOW)
    sunday = span("sunday", NOW)[0]
    assert dt.datetime.fromtimestamp(sunday, dt.UTC).weekday() == 6 and sunday <= TODAY < sunday + 7 * DAY
    assert span("last2hours", NOW) == (NOW - 7200, NOW) == span("2hours", NOW) and span("prev30minutes", NOW) == (TODAY - 1800, TODAY)
    assert span("prevmonth", NOW) == (unix(2026, 7), unix(2026, 8)) and span("lastmonth", NOW) == (NOW - 31 * DAY, NOW + DAY)
    assert date_bounds(">2026-08-01", NOW) == (unix(2026, 8, 2), None) and date_bounds("2026-08-01T10:00:00", NOW) == (unix(2026, 8), unix(2026, 8, 2))
    assert date_bounds("2026-07-01..2026-07-03", NOW) == (unix(2026, 7), unix(2026, 7, 3))


@pytest.mark.parametrize(("text", "rest", "needles"), [
    ("content:hello", "", ("hello",)), ('src content:"pub struct Foo" baz', "src  baz", ("pub struct Foo",)), ('"content:a b" x', "x", ("a b",)),
    ('content:"word" y', "y", ("word",)), ("!content:x", "!content:x", ()), ("a content:b|c content:d", "a  content:d", ("b|c",)), ('"x content:y"', '"x content:y"', ()),
])
def test_content(text, rest, needles):
    if text.startswith("a content"):
        assert L.content_terms(text)[1] == ("b|c", "d")
        return
    got = L.content_terms(text)
    assert (got[0].split(), got[1]) == (rest.split(), needles)


def test_regex_gate():
    assert java_regex("a(?=b)", False) is None and java_regex(r"(a)\1", False) is None and java_regex("(", False) is None and java_regex("a++", False) is None
    assert java_regex(r"\p{L}+", False) == r"(?iuU)\p{L}+"
