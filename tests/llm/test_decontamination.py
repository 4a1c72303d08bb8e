import random
import re

from pathquarry.llm.decontamination import clean, flag, pairs
from tests.llm import naive

ITEM = "If a train leaves Paris with 120 passengers and drives 300 km to Lyon, then Paris lies how far from Lyon when the train returns?"
OTHER = "Which of these seven mountains in the southern range was climbed first by a party of four people in winter?"


def find(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (2, OTHER)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in pairs(docs, bench, **how).collect()}


def test_found_and_left_alone(spark):
    rng = random.Random(1)
    words = "the of and which these seven train in a with leaves to first party then was climbed people range".split()
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    changed = ITEM.replace("Paris", "Berlin").replace("Lyon", "Bad Hamburg").replace("120", "77").replace("300 km", "41 miles")
    mixed = ITEM.replace("Paris with", "Berlin with").replace("Lyon,", "Hamburg,")  # Paris twice: two names for one
    texts = [noise(300) + "\n" + ITEM + " " + noise(50), noise(50) + ". " + changed, mixed, OTHER.upper(), noise(20_000), None, "", ITEM[:40], OTHER + " " + ITEM]
    got = find(spark, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (8, 1), (8, 2)}
    assert got[0, 1].verbatim and not got[1, 1].verbatim
    assert set(find(spark, texts, most_windows=10)) == set(got)


def test_filter(spark):
    docs = spark.createDataFrame([(1, OTHER, 3), (1, "fine text", 4), (None, None, 5)], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(2, OTHER)], "item_id long, text string")
    assert [(r.doc_id, r.text) for r in clean(docs, bench).collect()] == [(1, "fine text"), (None, None)]
    assert clean(docs.limit(0), bench).count() == 0 and clean(docs, bench.limit(0)).count() == 3
    assert set(flag(docs, bench).columns) == {"doc_id", "text", "leaks"}


def test_every_item_is_found_as_said(spark):
    """Items with few literals, short ones, and scripts without spaces have no usable template; others keep theirs."""
    items = ["What is 12 + 30?", "Add 3 4 5 6 7 8 9 10 11 12 13 14", "too short", "Paris London Rome", "日本の首都はどこですか。それは東京です", "แมวนั่งอยู่บนเสื่อในบ้าน", "???"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [
        "He asked what is 12 + 30? and left", "add 3 4 5 6 7 8 9 10 11 12 13 14", "it was Too  short.", "from paris london rome", "問題、日本の首都はどこですか?それは東京です!", "เขาเห็นแมวนั่งอยู่บนเสื่อในบ้านใหญ่",
        "What is 12 + 31?", "add 3 4 5 6 7 9 8 10 11", "too very short", "a Paris and London", "日本の首都は大阪ではない", "แมวดำ", "??? and nothing", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in pairs(docs, bench).collect()]
    assert sorted(got) == [(i, i) for i in range(6)]
    assert sorted(r.doc_id for r in clean(docs, bench).collect()) == list(range(6, len(texts)))


CITIES = "Paris Lyon Berlin Hamburg Madrid Porto Vienna Dublin Oslo Athens".split()
WORDS = "train river bridge market garden window letter story engine basket winter summer teacher doctor farmer baker carries counts leaves finds paints sells near behind under over small large green quiet".split()


def _question(rng):
    """A question with names, numbers and units between words."""
    parts = []
    for _ in range(rng.randrange(6, 16)):
        parts += [rng.choice(WORDS) for _ in range(rng.randrange(2, 6))]
        parts.append(rng.choice([rng.choice(CITIES), str(rng.randrange(2, 999)), f"{rng.randrange(2, 99)} km", f"{rng.random() * 9:.2f}", rng.choice(WORDS)]))
    return "When " + " ".join(parts) + ", how many are left?"


def _another(rng, text):
    """The same question with other names and numbers, one for each."""
    names = dict(zip(CITIES, rng.sample(["Quito", "Lima", "Cairo", "Tunis", "Delhi", "Seoul", "Hanoi", "Perth", "Kyoto", "Osaka"], 10), strict=True))
    numbers: dict[str, str] = {}
    return re.sub(r"[A-Z][a-z]+|[0-9]+(?:[.][0-9]+)?", lambda m: names.get(m[0], m[0]) if m[0][0].isalpha() else numbers.setdefault(m[0], f"{len(numbers) + 1000}"), text)


def test_against_brute_force_with_recall(spark):
    """Verbatim, re-parameterised, mixed-up, cut and unrelated questions: the pairs of the plain matcher, and nearly all of those planted."""
    rng = random.Random(21)
    items = [_question(rng) for _ in range(40)]
    texts, planted = [], set()
    noise = lambda n: " ".join(rng.choice([*WORDS, "12", "Oslo"]) for _ in range(n)) + "."
    for k, item in enumerate(items):
        planted |= {(len(texts), k), (len(texts) + 1, k)}
        texts.append(noise(rng.randrange(100)) + " " + item + " " + noise(20))
        texts.append(noise(rng.randrange(100)) + " " + _another(rng, item) + " " + noise(20))
        words = item.split()
        texts.append(" ".join(words[: len(words) // 3]))
        texts.append(noise(5) + " " + " ".join(words[len(words) // 3 :]))
        texts.append(" ".join(w if rng.random() < 0.8 or w[0].islower() else rng.choice([*CITIES, "55"]) for w in words))
    texts += [noise(400) for _ in range(20)] + texts[:3] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in pairs(docs, bench).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if naive.leaks(t, item)}
    assert len(got & planted) == len(planted)


def test_very_long_text_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "the word goes on " * 60_000 + OTHER), (2, OTHER), (2, OTHER)], "doc_id long, text string")
    bench = spark.createDataFrame([(2, OTHER)], "item_id long, text string")
    assert sorted(r.doc_id for r in pairs(docs, bench).collect()) == [1, 2, 2]
