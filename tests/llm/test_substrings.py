import random

import pytest

from pathquarry.llm.substrings import deduplicate


def brute(texts):
    """texts in order -> runs of each."""
    seen, out = set(), []
    for t in texts:
        gone = set()
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                gone.update(range(s, s + 100))
            seen.add(w)
        runs = []
        for i in sorted(gone):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        out.append([tuple(r) for r in runs])
    return out


@pytest.mark.parametrize(("segment", "many"), [(1 << 20, 1 << 15), (150, 2)])
def test_brute_force(spark, segment, many):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [noise(rng.randrange(90, 400)) for _ in range(6)]
    texts = ["", None, "a" * 500, "ab" * 300, "short", "a" * 99, "a" * 100, noise(3000)]
    for _ in range(40):
        texts.append("".join(rng.choice([noise(rng.randrange(200)), rng.choice(passages), rng.choice(passages)[rng.randrange(80) :]]) for _ in range(rng.randrange(1, 8))))
    texts += [texts[-1], texts[-1][:50] + "X" + texts[-1][51:], texts[7]]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, spans int").repartition(3)
    got = {r.doc_id: r for r in deduplicate(docs, segment=segment, gather=min(segment, 100_000), many=many).collect()}
    order = sorted(zip(ids, texts))
    for (i, t), runs in zip(order, brute([(t or "").encode() for _, t in order])):
        data = (t or "").encode()
        assert [(x.start, x.end) for x in got[i].runs] == runs, i
        assert bytes(got[i].kept) == b"".join(data[p:q] for p, q in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)])) and got[i].n_bytes == len(data)


def test_repeated_rows_and_empty(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefgh ") for _ in range(210))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), len(r.runs)) for r in deduplicate(docs).collect())
    assert got[0] == ((False, 0), 0) and [g[1] for g in got[1:3]] == [1, 1]
    assert deduplicate(docs.limit(0)).count() == 0


def test_many_different_strings_around_one_core(spark):
    """A passage of 93 bytes between texts that all differ: no string is repeated, and the core is taken in parts."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    core = noise(93)
    texts = [noise(60) + core + noise(60) for _ in range(300)]
    texts += [texts[5][:170], texts[6][20:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: [(x.start, x.end) for x in r.runs] for r in deduplicate(docs, many=10).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))


def test_very_long_text(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh ") for _ in range(2_000_000))
    docs = spark.createDataFrame([(1, t), (2, t[1_000_000:1_500_000] + "!" + t[:300])], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.runs] for r in deduplicate(docs, segment=1 << 18).collect()}
    assert got == {1: [], 2: [(0, 500_000), (500_001, 500_301)]}
