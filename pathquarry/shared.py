"""Where to write what all executors must see, cutting lineage, joins with hot keys, and ranks over all rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """This application's folder below the one all executors share (spark.checkpoint.dir). Only a local master may leave that unset."""
    sc = spark.sparkContext
    root = getattr(sc, "_pathquarry_root", None)
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="pathquarry-")
        root = sc._pathquarry_root = f"{root.rstrip('/')}/pathquarry-{sc.applicationId}"
        atexit.register(release, spark)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes what this application has written below shared_root; frames that read it end. Also done when Python ends."""
    sc = spark.sparkContext
    with contextlib.suppress(Exception):  # the session may be gone already
        path = sc._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there: no lineage, and no shuffle files left behind."""
    spark = df.sparkSession
    path, drop = shared_path(spark, tag), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(drop)
    spark.conf.set(drop, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(drop, before)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, table: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """rows joined with table (one row a key, written before) on key; `often` says how many of `total` rows have the key.

    Keys of more than a thousandth of the rows are fewer than 1,000, so they are broadcast and no task gets all rows of one; the
    rest is joined as Spark sees fit. The result has the columns of rows and table, key once, `often` dropped.
    """
    hot = F.col(often) > max(total // 1000, 1000)
    rare = table.where(~hot).drop(often)
    if table.where(hot).isEmpty():
        return rows.join(rare, key)
    few = F.broadcast(table.where(hot).drop(often))
    both = rows.join(few, key)
    return both.unionByName(rows.join(few.select(key), key, "left_anti").join(rare, key).select(*both.columns))


def numbered(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """name 0, 1, ... in the order of `by`: sorted in ranges, with each range's first rank added; no task sees all rows."""
    parts = cut(df.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "ranges")
    per = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*by)) - 1
    out = parts.withColumn("__i", within).join(F.broadcast(per.select("__p", before.alias("__b"))), "__p")
    return out.withColumn(name, (F.col("__i") + F.col("__b")).cast("long")).drop("__p", "__i", "__b")
