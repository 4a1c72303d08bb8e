"""The operN queries: each applies its operator to the whole table it is meant for and keeps the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_split, load


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import pairs

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pairs(docs, load(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import score, train

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", labelled_split().alias("held_out"), "score", predicted)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import encode_and_read

    return encode_and_read(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicate

    found = deduplicate(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed")
    spans = F.size("runs").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", removed, spans, F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, load(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, digest, find

    found = find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = tuple(r.kind for r in BASE)
    base = F.sha2(digest(F.col("spans"), kinds).cast("binary"), 256)
    return found.select("doc_id", *map(count, kinds), base.alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels"), threshold=0.3)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", labelled_split().alias("held_out"), "score", predicted)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_classifier, op3_mixing, op4_token_output, op5_substring_dedup, op6_url_rules, op7_simhash, op8_quality_rules, op9_secrets, op10_toxicity)}
