"""The change journal: JSON lines, written by appending, read with malformed lines left out, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANGE, JOURNAL
from ..shared import numbered

_EVENT = "timestamp is not null and reason is not null and path is not null"


def append(changes: DataFrame, path: str) -> None:
    """Appends events with their sequence numbers. Events without any are numbered by time, behind those that are there."""
    if "seq" not in changes.columns:
        spark, last = changes.sparkSession, -1
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            last = spark.read.schema(JOURNAL).json(path).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        changes = numbered(changes, [F.col("timestamp"), F.col("path"), F.col("reason")], "seq").withColumn("seq", F.col("seq") + last + 1)
    changes.select(*(c for c in JOURNAL.names if c in changes.columns)).write.mode("append").json(path)


def read(spark: SparkSession, path: str, most: int | None = 100_000) -> DataFrame:
    """The last `most` events to arrive; lines that are no events are skipped. Lines without a number count as the oldest, by time."""
    rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path).where(_EVENT)
    return rows if most is None else rows.orderBy(F.desc_nulls_last("seq"), F.desc("timestamp"), "path", "reason").limit(most)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    rows = spark.readStream.schema(JOURNAL).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where(_EVENT)


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON object for each row, in one string column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def from_lines(lines: DataFrame, schema=CHANGE) -> DataFrame:
    return lines.select(F.from_json("line", schema).alias("x")).select("x.*")
