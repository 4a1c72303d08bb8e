import random
from itertools import combinations
from zlib import crc32

from pyspark.sql import functions as F

from pathquarry.llm import url_rules
from pathquarry.llm.url_rules import judge, mine, parts, tokens


def test_fixed_rules(spark):
    urls = {
        1: "http://a.example.ORG/es/1?x", 2: "https://example.org/en/19", 3: "https://example.org/en/2", 4: "x://b.com/fr/", 5: "x://b.com/de/#q", 6: "x://b.com/de",
        7: None, 8: "no scheme", 9: "http://org", 10: "http://borg/", 11: "a://b?c://d/", 12: "http://notexample.org/es/", 13: "ab\ncd://ex.com/de/\nz", 14: "",
    }
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = judge(spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("host", F.lit(1)), labels).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/19", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"),
        4: ("b.com", "/fr/", "com/fr/", "allow"), 5: ("b.com", "/de/", "com/de/", "block"), 6: ("b.com", "/de", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("org", "", None, "allow"), 10: ("borg", "/", None, "allow"), 11: ("b", "", None, "allow"),
        12: ("notexample.org", "/es/", "org/", "allow"), 13: ("ex.com", "/de/\nz", "com/de/", "block"), 14: ("", "", None, "allow"),
    }


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam' if i % 10 == 0 else 'fine'}.example.net/{'casino' if i % 2 == 0 else 'news'}/{i}") for i in range(1, 600)]
    pages = spark.createDataFrame([*rows, (9999, "http://spam.example.net/casino/7"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(1, 600)], "doc_id long, quality int")
    host, path = parts(F.col("url"))
    found = pages.select("page_id", tokens(F.col("url"), host, path).alias("__tokens"))
    mined, default = mine(found, labels)
    rules = {tuple(r.tokens): r for r in mined.collect()}
    assert default == "allow"
    assert set(rules) == {("host2:spam",)} and rules["host2:spam",].confidence == 1.0
    verdicts = {r.page_id: r.verdict for r in judge(pages, labels).collect()}
    assert verdicts[9999] == "block" and verdicts[20] == "block" and verdicts[21] == "allow" and verdicts[None] == "allow"


def test_whole_hosts_and_parameters(spark):
    long = "x" * 100
    rows = [(i, f"http://{'bad' if i % 10 == 0 else 'good'}.a.b.example.co.uk/?k={long}{'1' if i % 10 == 5 else '2'}") for i in range(1, 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(1, 300)], "doc_id long, quality int")
    assert {r.page_id for r in judge(pages, labels).where("verdict = 'block'").collect()} == {i for i, _ in rows if i % 5 == 0}


def test_rules_of_five_tokens(spark):
    words = "abcde"
    rows = [(i, "x://h.com/" + "/".join(w for k, w in enumerate(words) if i % 6 != k)) for i in range(1, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 6 == 5 else 1) for i in range(1, 400)], "doc_id long, quality int")
    host, path = parts(F.col("url"))
    rules, _ = mine(pages.select("page_id", tokens(F.col("url"), host, path).alias("__tokens")), labels, least_confidence=0.8)
    assert [r.tokens for r in rules.collect()] == [[f"path:{w}" for w in words]]


def _brute_force(rows, labels, support, confidence, lift):
    """All token sets of the bad baskets, counted one by one."""
    side = {k: [(t, labels[i] == 0) for i, t in rows if i in labels and crc32(str(i).encode()) % 4 in k] for k in ((0, 1), (3,))}
    fit, aside = side[0, 1], side[3,]
    base = sum(b for _, b in fit) / len(fit)
    least = max(confidence, lift * base)
    sets = {frozenset(c) for t, b in fit if b for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    rules = {}
    for s in sets:
        one, two = ([b for t, b in x if s <= t] for x in (fit, aside))
        if sum(one) >= support * len(fit) and sum(one) >= least * len(one) and two and sum(two) >= least * len(two):
            rules[s] = sum(one) / len(one)
    return {s: c for s, c in rules.items() if not any(o < s for o in rules)}


def test_miner_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, frozenset(f"path:{w}" for w in rng.sample("abcdefg", rng.randint(1, 4)))) for i in range(1500)]
    labels = {i: 0 if rng.random() < (0.75 if {"path:a", "path:b"} <= t or "path:g" in t else 0.1) else 1 for i, t in rows}
    found = spark.createDataFrame([(i, sorted(t)) for i, t in rows], "page_id long, __tokens array<string>")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for support, confidence, lift in ((0.01, 0.5, 1.5), (0.002, 0.3, 1.2), (0.05, 0.6, 2.0)):
        mined, _ = mine(found, known, support, confidence, lift)
        got = {frozenset(r.tokens): round(r.confidence, 9) for r in mined.collect()}
        want = {s: round(c, 9) for s, c in _brute_force(rows, labels, support, confidence, lift).items()}
        assert got == want and got


def test_verdicts_of_many_rules_and_the_default(spark):
    """More rules than are broadcast, a hot token set, repeated rows, and pages that are mostly bad."""
    rows = [(i % 4000, f"http://{'spam' if i % 8 == 0 else 'h'}{i % 40}.net/{i % 3}") for i in range(8000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("extra", F.lit("x"))
    labels = spark.createDataFrame([(i, 0 if i % 8 == 0 else 1) for i in range(4000)], "doc_id long, quality int")
    few = url_rules.FEW_RULES
    try:
        for url_rules.FEW_RULES in (0, few):
            out = judge(pages, labels)
            assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
            got = {(r.page_id, r.verdict) for r in out.collect()}
            assert got == {(i % 4000, "block" if i % 8 == 0 else "allow") for i in range(8000)} and out.count() == 8000
    finally:
        url_rules.FEW_RULES = few
    worse = labels.withColumn("quality", F.lit(0))
    assert {r.verdict for r in judge(pages, worse).collect()} == {"block"}


def test_empty_tables_and_long_urls(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert judge(spark.createDataFrame([], "page_id long, url string"), labels).collect() == []
    long = "HTTP://A." + "b" * 300_000 + ".org/" + "c" * 300_000
    got = judge(spark.createDataFrame([(1, long)], "page_id long, url string"), labels).first()
    assert (len(got.host), len(got.path), got.rule) == (300_006, 300_001, "org/")
