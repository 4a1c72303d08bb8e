"""Catalog, content and change frames built from the benchmark tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derive import ascii_lower, derive, from_unix
from ..operators.changes import walk
from ..operators.tree import ancestors
from ..schema import EPOCH

NOW = 1_706_616_000
SUFFIXES = [".rs", ".TXT", ".json", ".log", ".md", ".tar.gz", ""]
GIB = 1 << 30
#: (doc_ids that are multiples of, attribute bit)
BITS = ((29, 4), (31, 256), (37, 2048), (41, 16384), (43, 4096), (47, 1024), (53, 8192))
REASONS = {"signup": "CREATE", "click": "WRITE", "view": "RENAME", "purchase": "RENAME_NEW", "error": "DELETE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Catalog rows of documents(doc_id, lang, source, n_chars); further columns pass through."""
    i = F.col("doc_id")
    stem = F.when(i % 101 == 0, "café-").when(i % 73 == 0, "star*-").when(i % 79 == 0, "set[1]-").when(i % 83 == 0, "report-").when(i % 11 == 0, "Report ").otherwise("file-")
    inner = F.when(i % 17 == 0, "node_modules/").otherwise("")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (i % 7 + 1).cast("int"))
    digits = F.when(i < 100_000_000, F.lpad(i.cast("string"), 8, "0")).otherwise(i.cast("string"))
    bare = F.when(i % 89 == 0, "README").when(i % 97 == 0, "Makefile")  # in folders of their own
    size = F.when(i % 59 == 0, 0).when(i % 61 == 0, 2 * GIB + i).when(i % 67 == 0, 5 * GIB + i).when(i % 71 == 0, 20 * GIB + i).when(i % 13 == 0, F.col("n_chars") * 1000).otherwise(F.col("n_chars"))
    attributes = F.when(i % 19 == 0, 2).when(i % 23 == 0, 33)
    for prime, bit in BITS:
        attributes = attributes.when(i % prime == 0, bit)
    modified = NOW - 3607 * i
    return docs.select(
        F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"), inner, F.coalesce(F.concat(F.lit("d"), digits, F.lit("/"), bare), F.concat(stem, digits, suffix))).alias("path"),
        size.cast("long").alias("size"),
        from_unix(modified - 86_400 * (i % 30)).alias("created"), from_unix(modified).alias("modified"), from_unix(modified + 3600 * (i % 5)).alias("accessed"),
        F.lit(False).alias("is_dir"),
        attributes.otherwise(128).cast("long").alias("attributes"),
        i.cast("long").alias("file_ref"), F.lit("/").alias("volume"), *more,
    )


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows only, underived."""
    return _file_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows and directory rows, underived."""
    from pyspark.sql import Window

    files = base_files(spark, sf_dir)
    dirs = files.select("size", "modified", F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path")
    dirs = dirs.agg(F.sum("size").alias("size"), F.max("modified").alias("m"), F.min("modified").alias("c"))
    ref = 1_000_000_000 + F.row_number().over(Window.orderBy("path"))  # a few thousand directories
    dirs = dirs.select("path", F.col("size").cast("long"), F.col("c").alias("created"), F.col("m").alias("modified"), F.col("m").alias("accessed"), F.lit(True).alias("is_dir"),
                       F.lit(16).cast("long").alias("attributes"), ref.cast("long").alias("file_ref"), F.lit("/").alias("volume"))
    return files.unionByName(dirs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(entries(spark, sf_dir))


def windows_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as C:\\corpus\\..."""
    path = F.concat(F.lit("C:"), F.translate("path", "/", "\\"))
    return derive(entries(spark, sf_dir).withColumn("path", path).withColumn("volume", F.lit("C:")))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and body come from the same document, so one scan makes both."""
    rows = _file_rows(table(spark, sf_dir, "documents"), "text")
    size = F.octet_length("text").cast("long").alias("byte_count")
    return rows.select(ascii_lower(F.col("path")).alias("path_key"), F.col("text").alias("body"), size, F.col("modified").alias("source_modified"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    reason = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in REASONS.items()])
    rows = events.select(
        F.col("event_id").cast("long").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 10 + EPOCH).alias("timestamp"),
        reason.alias("reason"), F.floor(F.col("event_id") / 3).cast("long").alias("file_ref"), F.lit(False).alias("is_dir"),
    )
    files = base_files(spark, sf_dir).select("file_ref", "path")
    of = F.pmod("file_ref", F.lit(files.count())).alias("file_ref")  # three events in a row are of one file, files in turn
    return rows.select("seq", "timestamp", "reason", "is_dir", of).join(files, "file_ref").select("seq", "timestamp", "reason", "path", "is_dir", "file_ref")


#: Moves and deletions of directories, behind all other events: (old, new or None). Two are of one directory in turn.
STEPS = (("/corpus/fr", "/corpus/french"), ("/corpus/de/src2", None), ("/corpus/french/src1", "/corpus/french/first"), ("/corpus/es", "/moved"))


def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes, then STEPS as events of directories, then a WRITE of every fiftieth file below /corpus/french, under its new name."""
    rows = changes(spark, sf_dir)
    last, late = rows.agg(F.max("seq"), F.max("timestamp")).first()
    steps = []
    for k, (old, new) in enumerate(STEPS):
        steps.append((last + 10 * k + 1, late, "RENAME" if new else "DELETE", old, True, -k - 1))
        if new:
            steps.append((last + 10 * k + 2, late, "RENAME_NEW", new, True, -k - 1))
    steps.append((last + 90, late, "RENAME", "/corpus/en/src3", True, -90))  # its new name never comes
    files = base_files(spark, sf_dir).where("path like '/corpus/fr/%' and file_ref % 50 = 1")
    path = F.regexp_replace(F.regexp_replace("path", "^/corpus/fr/", "/corpus/french/"), "^/corpus/french/src1/", "/corpus/french/first/")
    after = files.select((F.col("file_ref") + last + 100).alias("seq"), F.lit(late).alias("timestamp"), F.lit("WRITE").alias("reason"), path.alias("path"), F.lit(False).alias("is_dir"), "file_ref")
    return rows.unionByName(spark.createDataFrame(steps, rows.schema)).unionByName(after)


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as it is after tree_changes, with a byte more; and the moved directories."""
    files = base_files(spark, sf_dir).withColumn("size", F.col("size") + 1).withColumn("path", walked(F.col("path")))
    dirs = entries(spark, sf_dir).where("is_dir").withColumn("path", walked(F.col("path"))).withColumn("size", F.lit(0).cast("long"))
    return files.unionByName(dirs).where("path is not null")


def walked(path):
    return walk(path, [(k, old, new) for k, (old, new) in enumerate(STEPS)])
