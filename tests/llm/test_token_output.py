import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pathquarry.llm.common import text_bytes
from pathquarry.llm.token_output import Encoder, encode_and_read, lookup, manifest, read_back, write

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


def whole(encoder, text):
    return encoder.library.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_library(encoder):
    rng = random.Random(5)
    parts = ["\u2003", "\u3000", "\u2014", "\u200b", "\x85", "the", "Étre", "can't", "we've", "<|endoftext|>", "123", "...", "a", " ", " ", " ", "\n", "\t", "\xa0", "\r\n", "  ", "'", "'s", "日本", "😀", "\x1c", ",", "!!"]
    texts = ["", " ", "\n", " a", "a ", "\na", "a\n", "\n\n"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    small = Encoder(VOCABULARY, table_bytes=2000)  # forgets all the time
    for chunk in range(0, len(texts), 500):
        part = texts[chunk : chunk + 500]
        for own in (encoder, small):
            ids, counts = own.encode(*text_bytes(pa.array(part)))
            for text, got in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert got.tolist() == [*whole(encoder, text), 0], repr(text)


def test_files(spark, encoder, tmp_path):
    rows = [(7, "of the words"), (3, None), (5, ""), (9, "long " * 30_000), (7, "of the words"), (-2, "x\n\ny"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, ids int, file int")
    got = encode_and_read(docs, VOCABULARY).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = np.array([*whole(encoder, text or ""), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = str(tmp_path / "tokens")
    write(docs, path, VOCABULARY)
    assert [r.ids for r in lookup(spark, path, 5).collect()] == [[0]]
    assert sum(r.n_docs for r in manifest(spark, path).collect()) == len(rows)


def test_empty(spark):
    assert encode_and_read(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def _rows_read(df):
    """Rows that the scan of an executed plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_lookup_skips_stripes_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.range(0, 40_000).selectExpr("id * 2 as doc_id", "concat('text number ', id) as text")
    write(docs.coalesce(1), path, VOCABULARY)
    found = lookup(spark, path, 31_000)
    assert len(found.collect()) == 1
    some = lookup(spark, path, 31_000)
    some._jdf.queryExecution().executedPlan()
    rows = some._jdf.collectToPython()  # noqa: F841  (runs this very plan, whose metrics are read)
    assert 0 < _rows_read(some) <= 2000


def test_files_are_ordered_by_id_not_by_name(spark, tmp_path):
    import os

    path = str(tmp_path / "tokens")
    docs = spark.range(0, 3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write(docs, path, VOCABULARY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(n for n in os.listdir(path) if n.endswith(".orc"))
    assert len(names) > 1
    for k, n in enumerate(names):  # names in the opposite order
        os.rename(f"{path}/{n}", f"{path}/part-{99 - k}.orc")
    start = 0
    for r in read_back(spark, path).orderBy("doc_id").collect():
        assert r.start == start
        start += r.n_tokens
