import random

import pytest

from pathquarry.llm import near_text, simhash
from tests.llm.test_simhash import brute_components


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("short", [32, 2])
def test_near_copies_against_brute_force(spark, monkeypatch, short):
    """Copies with one word in a hundred changed, and others around 0.8; op7's distance of four bits loses most of these."""
    monkeypatch.setattr(near_text, "SHORT", short)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts = [None, "", " ", "One two", "one TWO", "one two three four five", line, line + " x"]
    for n, changes in ((100, 1), (300, 3), (1000, 10), (100, 2), (60, 1), (40, 2)):
        for _ in range(12):
            words = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(words))
            for _ in range(2):
                for k in rng.sample(range(n), changes):
                    words[k] = rng.choice(vocabulary)
                texts.append(" ".join(words) + (" " + line if rng.random() < 0.2 else ""))
    words = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):  # one large group
        k = rng.randrange(120)
        texts.append(" ".join([*words[:k], "changed", *words[k + 1 :]]))
    rng.shuffle(texts)
    own = [sets(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    want = brute_components(pairs, range(len(texts)))
    assert len(set(want.values())) < len(texts) - 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in near_text.near_duplicates(docs).collect()} == want
    if short == 32:
        import corpus_pipeline

        kept = corpus_pipeline.near_duplicates(spark, docs.union(docs.limit(1).selectExpr("cast(null as long)", "text")), "")
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(want.values()), None], key=str)
        assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_fingerprints_link_near_copies_by_themselves(spark, monkeypatch):
    """what the index of fingerprints links is taken, also if no shingle is listed; pairs under 0.8 that it links are not."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(500)) for _ in range(400)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t + " end") for i, t in enumerate(texts)]
    rows += [(20, "same " * 300 + texts[0][:400]), (21, "same " * 300 + texts[1][:400])]  # one fingerprint if repeats count, few shared shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: r.fp for r in simhash.fingerprints(docs, near_text.WIDTH).collect()}
    near = {i for i in range(5) if bin((fp[i] ^ fp[10 + i]) & (2**64 - 1)).count("1") <= 4}
    assert near and fp[20] == fp[21]
    monkeypatch.setattr(near_text, "_postings", lambda docs, *_: docs.sparkSession.createDataFrame([], near_text._LIST_SCHEMA))
    kept = {r.doc_id for r in simhash.keep_one(docs, by="shingles").collect()}
    assert kept == {i for i, _ in rows} - {10 + i for i in near}


def test_unrelated_long_texts_are_told_apart_before_whole_sets_move(spark, monkeypatch):
    """pairs of long texts that share a passage (a third of their shingles) go by their maps; near copies among them stay."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50_000)}"
    passages = [[word() for _ in range(1500)] for _ in range(5)]
    texts = [[*passages[k % 5], *(word() for _ in range(1500))] for k in range(20)]
    texts += [[*texts[0], *(word() for _ in range(500))], [*texts[1][:-400]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    inside, moved, own_cut, own_similar = [], [], near_text.cut, near_text._similar

    def cut(df, tag="cut"):
        out = own_cut(df, tag)
        if inside and tag == "tried":
            moved.extend((r.a, r.b) for r in out.collect())
        return out

    def similar(*args):
        inside.append(1)
        try:
            return own_similar(*args)
        finally:
            inside.clear()

    monkeypatch.setattr(near_text, "cut", cut)
    monkeypatch.setattr(near_text, "_similar", similar)
    got = {r.id: r.component_id for r in near_text.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(20)} | {20: 0, 21: 1}
    assert len(set(moved)) == 2
