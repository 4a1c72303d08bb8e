"""The synthetic catalog of the benchmark, generated on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six searches that are timed on it.
SEARCHES = {"one_name": "file-00000123", "wildcard": "*.rs", "module": "module-0042", "size": "size:>512kb", "files": "file:*.json", "folders": "folder:*"}


def synthetic(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    i = F.col("id")
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    is_dir = i % 97 == 0
    root = F.when(i % 17 == 0, "node_modules").otherwise("src")
    folder = F.concat(F.lit("C:\\benchmark\\workspace-"), pad(i % 50, 3), F.lit("\\"), root, F.lit("\\module-"), pad(i % 10_000, 4))
    ext = F.element_at(F.array(*map(F.lit, ("rs", "txt", "json", "log", "md"))), (i % 5 + 1).cast("int"))
    name = F.concat(F.when(i % 101 == 0, "café-").otherwise("file-"), pad(i, 8), F.lit("."), ext)
    rows = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism)
    return rows.select(
        F.when(is_dir, folder).otherwise(F.concat(folder, F.lit("\\"), name)).alias("path"), (i * 131 % 1_048_576).alias("size"),
        i.alias("created"), i.alias("modified"), i.alias("accessed"), is_dir.alias("is_dir"),
        F.when(i % 19 == 0, 2).otherwise(128).cast("long").alias("attributes"), i.alias("file_ref"), F.lit("C:").alias("volume"),
    )
