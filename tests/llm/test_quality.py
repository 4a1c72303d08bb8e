"""Quality rules, the quality classifier, the toxicity classifier and mixing, on small frames."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathquarry.llm import common, mixing, quality_knn, quality_rules, toxicity
from tests.llm import naive

STOP = "the of and to in is that for it was on are as with".split()


def prose(rng, n):
    return " ".join(rng.choice(STOP) if rng.random() < 0.4 else "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t\x0b", "a " * 40, "x\x85y é ñ", "# a | b\n# a | b\n\n"] + [" ".join(rng.choice("ab cd\n ef | #".split(" ")) for _ in range(rng.randrange(60))) for _ in range(150)] + [prose(rng, 3000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    assert rows[len(texts) - 1].kept and quality_rules.judge(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text, bad = prose(rng, rng.randrange(30, 200)), i % 4 == 0
        if bad:
            text = " ".join(w + rng.choice(["$$$", "%%%"]) for w in text.split()) if i % 8 else (text.upper().replace(" ", "!! "))
        toxic = i % 5 == 0
        if toxic:
            words = text.split()
            for k in range(0, len(words), 20):
                words[k] = rng.choice(["grumpblat", "snorfelix", "grumpblats", "snorfeli"])
            text = " ".join(words)
        rows.append((i, text, 0 if bad else 1, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "x" * 100_000, None, None)]
    docs = spark.createDataFrame([(r[0], r[1], 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[2] is not None], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r for r in rows}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_classifier(labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r.score for r in quality_knn.score(docs, quality_knn.train(docs.drop("score"), labels)).collect()}
    test = [i for i in rows if i < 1000 and held_out(i)]
    assert sum((got[i] >= 0.7) == (rows[i][2] == 1) for i in test) >= 0.97 * len(test)
    assert got[1000] == got[1001] == 0.0 and all(0 <= x <= 1 for x in got.values())
    empty = quality_knn.score(docs, quality_knn.train(docs, labels.limit(0)))
    assert {r.score for r in empty.where("doc_id < 3").collect()} == {0.5}


def test_votes_against_brute_force(labelled):
    """Scores of a fitted model, one text at a time: naive features, cosines with every vector, and a sorted vote with ties."""
    docs, labels, rows = labelled
    docs = docs.where("doc_id % 7 = 1 or doc_id >= 1000").union(docs.sparkSession.createDataFrame([(1003, "Été, ß! 12 12 12 x\x0by", 0.0), (1003, "one", 0.0)], docs.schema))
    model = quality_knn.train(labelled[0].drop("score"), labels)
    model.vectors[3] = model.vectors[10] = model.vectors[200]  # ties
    for r in quality_knn.score(docs, model, keep_text=True).collect():
        assert abs(r.score - naive.vote(model, r.text)) < 2e-3, r.doc_id


def test_toxic_scores_against_brute_force(labelled):
    docs, labels, rows = labelled
    model = toxicity.train(docs.drop("score"), labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).where("doc_id % 7 = 1 or doc_id >= 1000").collect():
        assert abs(r.score - naive.toxic(model, text[r.doc_id])) < 1e-4, r.doc_id


def test_toxicity_learns_from_whole_texts(spark):
    """Toxic words at one place of texts of 3,000 words, which a few windows of each would miss."""
    rng = random.Random(4)
    rows = []
    for i in range(160):
        words = prose(rng, 3000).split()
        if i % 2:
            k = rng.randrange(len(words) - 8)
            words[k : k + 8] = [rng.choice(["grumpblat", "snorfelix", "dwazzle"]) for _ in range(8)]
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    test = [i for i, _, _ in rows if held_out(i)]
    assert sum((got[i] >= 0.3) == bool(rows[i][2]) for i in test) >= 0.9 * len(test)


def test_classifiers_with_clashing_names_repeated_rows_and_empty_tables(spark, labelled):
    docs, labels, rows = labelled
    more = docs.withColumns({"y": F.lit(1), "__k": F.lit("k"), "label": F.lit(0)})
    twice = labels.union(labels).withColumn("text", F.lit("t")).withColumn("y", F.lit(2))
    for part in (quality_knn, toxicity):
        model = part.train(more, twice)
        out = part.score(more.union(more.limit(3)), model)
        assert set(out.columns) == {"doc_id", "y", "__k", "label", "score"} and out.count() == len(rows) + 3
        assert all(len({r.score for r in same}) == 1 for same in ([x for x in out.collect() if x.doc_id == i] for i in range(3)))
        assert part.score(more.limit(0), model).count() == 0
        assert part.score(more.limit(2), part.train(more.limit(0), labels.limit(0))).first().score == 0.5


def test_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    size = lambda **how: Counter(r.y for r in common.labelled_sample(docs, labels, "quality", **how).collect())
    assert size(per_class=20) == {0: 20, 1: 20} and size(per_class=100, class_bytes=4500) == {0: 5, 1: 5}
    assert size(per_class=20, class_bytes=1) == {0: 1, 1: 1}


def test_toxicity(labelled):
    docs, labels, rows = labelled
    model = toxicity.train(docs.drop("score"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [i for i in rows if i < 1000 and held_out(i)]
    assert sum((got[i] >= 0.3) == (rows[i][3] == 1) for i in test) >= 0.9 * len(test)
    assert got[1000] == got[1001] < 0.3
    unseen = docs.sparkSession.createDataFrame([(1, "a grumpblatty thing and a xsnorfelix too")], "doc_id long, text string")
    assert toxicity.score(unseen, model).first().score > got[1001]
    assert toxicity.train(docs, labels.limit(0)).bias == 0.0


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", " ".join(["w"] * rng.randrange(60)) if i % 17 else None, 9) for i in range(600)] + [(5, "a", "w w w", 9), (5, "a", "w w w", 9), (None, "b", "w", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    assert all(size == source_size and abs(taken - target) <= 1 and target <= 2 * size for size, taken, target, source_size in by.values())
    assert abs(sum(s[2] for s in by.values()) - 1.5 * total) < 1e-6
    key = lambda rows: sorted((r.doc_id or -1, r.size, r.taken) for r in rows)
    assert key(out) == key(mixing.mix(docs.repartition(7)).collect())
    times = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    assert max(times.values()) <= 6 and mixing.mix(docs.limit(0)).count() == 0
    assert [r.target for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).limit(2).collect()] == [0.0, 0.0]


def test_mixing_of_rows_without_ids_and_long_texts(spark):
    rows = [(None, "a", f"text number {i}") for i in range(300)] + [(1, "b", "w " * 200_000), (2, "b", "w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("x"))
    out = mixing.mix(docs)
    assert out.where("doc_id = 1").first()["size"] == 200_000 and out.count() == 302
    times = Counter(r.text for r in mixing.repeat(docs).collect())
    assert len(set(times.values())) >= 1 and all(n in (1, 2) for n in times.values())
    assert mixing.repeat(docs).columns == docs.columns and mixing.repeat(docs.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path, labelled):
    """Every stage once more in plain Python, from the fitted classifier on: votes, shingles, templates, shares, and the library's ids."""
    import corpus_pipeline
    from pathquarry.llm.token_output import Encoder

    base, labels, rows = labelled
    rng = random.Random(11)
    item = "If a train leaves Paris with 120 passengers and drives 300 km to Lyon, then Paris lies how far from Lyon when the train returns?"
    long = prose(rng, 20_000)
    good = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    extra = [(2000 + k, t) for k, t in enumerate(good)]
    for k, t in enumerate(good[:12]):  # near copies: one word in sixty or so, and exact ones
        words = t.split()
        words[len(words) // 2] = "changed"
        extra += [(2100 + k, " ".join(words)), (2200 + k, t)]
    changed = item.replace("Paris", "Berlin").replace("Lyon", "Hamburg").replace("120", "77")
    extra += [(2300 + k, prose(rng, 80) + " " + t) for k, t in enumerate((item, changed, item[:40]))]
    extra += [(2400, long), (2401, long), (2400, good[30] + " end"), (2500, None), (2501, ""), (2502, " \n")]
    docs = base.select("doc_id", "text").where("doc_id < 120").union(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.withColumns({"source": F.concat(F.lit("s"), F.col("doc_id") % 2), "score": F.lit("x"), "fp": F.lit(1), "leaks": F.lit(2), "y": F.lit(3)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    all_rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = quality_knn.train(docs, labels)
    votes = {t: naive.vote(model, t) for t in {t for _, t, _ in all_rows}}
    assert all(abs(v - 0.7) > 0.002 for v in votes.values())
    kept = [r for r in all_rows if votes[r[1]] >= 0.7]
    sets = [naive.shingles(t) for _, t, _ in kept]
    pairs = [(i, j) for i in range(len(kept)) for j in range(i) if naive.similar(sets[i], sets[j])]
    group = naive.components(pairs, range(len(kept)))
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, kept[k][0]), kept[k][0])
    kept = [r for k, r in enumerate(kept) if r[0] == least[group[k]]]
    assert len(pairs) >= 20
    kept = [r for r in kept if not naive.leaks(r[1], item)]
    assert {2300, 2301}.isdisjoint({r[0] for r in kept}) and 2302 in {r[0] for r in kept}
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]
    assert [i for i, _ in got] == sorted(i for i, _ in got)
    encoder = Encoder(corpus_pipeline.VOCABULARY)
    tokens = {(i, len(encoder.library.encode(t, add_special_tokens=False).ids) + 1): len(t.split()) for i, t, _ in kept}
    times = Counter(got)
    assert set(times) <= set(tokens)
    # Two sources of weights 5 and 2 share 150 % of all words, neither beyond twice its own.
    size = Counter()
    for i, t, s in kept:
        size[s] += len(t.split())
    total, order = 1.5 * sum(size.values()), sorted(size)
    share = {s: total * w / 7 for s, w in zip(order, (5, 2))}
    for a, b in (order, order[::-1]):
        if share[a] > 2 * size[a]:
            share = {a: 2 * size[a], b: min(2 * size[b], total - 2 * size[a])}
    taken = Counter()
    source = {i: s for i, _, s in kept}
    for (i, n), k in times.items():
        taken[source[i]] += k * tokens[i, n]
    for s in order:
        longest = max(len(t.split()) for _, t, x in kept if x == s)
        assert abs(taken[s] - share[s]) <= longest
        whole = int(share[s] // size[s])
        assert all(times[k] in (whole, whole + 1) for k in tokens if source[k[0]] == s)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0
