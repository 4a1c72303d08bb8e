import random
import re

import numpy as np
import xxhash

from pathquarry.llm import simhash
from pathquarry.llm.components import components
from pathquarry.llm.simhash import fingerprints, keep_one, links, near_duplicates


def brute_fp(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a", "a b", "A b c d", "é Ä ß ñ x", "x\x0by\x0cz"] + ["".join(rng.choice(["ab", "Cd", " ", "\t", "é", "z" * 40, "\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in rows} == {i: brute_fp(t) for i, t in enumerate(texts)}


def test_links_and_components(spark, monkeypatch):
    rng = random.Random(2)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 20)):
            for b in rng.sample(range(64), rng.randrange(5)):
                base ^= 1 << b
            fps.add(base)
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)
    want = brute_components(zip(x.tolist(), y.tolist()), range(len(fps)))
    reps = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    for block in (2048, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {i: i for i in range(len(fps))} | {r.node: r.component for r in components(links(reps)).collect()}
        assert got == want


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {501: 500}


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (2, text), (9, text + " more"), (7, "other words entirely here and there"), (1, None), (3, ""), (None, text), (2, text)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    fp = {i: brute_fp(t) for i, t in rows}
    near = 2 if bin(fp[9] ^ fp[2]).count("1") <= 4 else 9
    assert got == {(5, 2), (2, 2), (9, near), (7, 7), (1, 1), (3, 1), (None, 2)}
    assert sorted(r.doc_id or -1 for r in keep_one(docs).collect()) == sorted([2, 2, 7, 1, -1] + ([9] if near == 9 else []))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    text = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"else{i}" for i in range(300))
    docs = spark.createDataFrame([(2, text, 1), (5, text, 1), (5, other, 1), (5, other, 1), (None, text, 1)], "doc_id long, text string, fp int")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text[:4]) for r in kept.collect()) == [(0, "word"), (2, "word"), (5, "else"), (5, "else")]


def test_hot_fingerprint_and_hub(spark, monkeypatch):
    """Most rows have one text, and one node has most edges: both go through the broadcast of few keys."""
    rows = [(i, "same words in all of these" if i % 3 else f"text {i} of its own kind {i * i}") for i in range(4000)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 4000 and all(got[i] == 1 for i in range(4000) if i % 3)
    edges = spark.createDataFrame([(5, i) for i in range(10, 4000)] + [(5, 3), (9000, 9001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {5: 3, 9001: 9000} | {i: 3 for i in range(10, 4000)}


def test_very_long_text(spark):
    text = "Word " * 400_000
    got = fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.fp & (2**64 - 1) == brute_fp("word word word word")
