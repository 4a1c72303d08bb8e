"""Roll-ups over filtered rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import apply
from ..plans.language import Options
from ..plans.literals import LARGEST


def saturating_sum(c: str) -> Column:
    total = F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(Decimal(0)))
    return F.least(total, F.lit(Decimal(LARGEST))).cast("long")


def totals(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"), saturating_sum("size").alias("total_size")
    )


def by_extension(found: DataFrame) -> DataFrame:
    """extension ('' for none), count, size of files; by count, then extension."""
    groups = found.where(~F.col("is_dir")).groupBy(F.coalesce("extension", F.lit("")).alias("extension"))
    return groups.agg(F.count("*").alias("count"), saturating_sum("size").alias("size")).orderBy(F.desc("count"), "extension")


def largest(found: DataFrame, top: int = 20) -> DataFrame:
    """path, size, is_dir of the largest rows; 0 means 20."""
    return found.select("path", "size", "is_dir").orderBy(F.desc("size"), "path").limit(top or 20)


def aggregate(files: DataFrame, options: Options, top: int = 20, contents: DataFrame | None = None) -> DataFrame:
    """One row: totals, the largest rows, and the table by extension, in two scans: a top-k, and groups that the totals follow from."""
    found = apply(files, options, contents).select("path", "size", "is_dir", "extension")
    order = lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["path"] < b["path"], -1).otherwise(1)
    tops = largest(found, top).agg(F.array_sort(F.collect_list(F.struct("path", "size", "is_dir")), order).alias("largest"))
    groups = found.groupBy("is_dir", F.when(~F.col("is_dir"), F.coalesce("extension", F.lit(""))).alias("extension"))
    groups = groups.agg(F.count("*").alias("count"), F.sum(F.col("size").cast("decimal(38,0)")).alias("sum"))
    most = lambda c: F.least(c, F.lit(Decimal(LARGEST))).cast("long")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    by = lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).when(a["extension"] < b["extension"], -1).otherwise(1)
    own = F.when(~F.col("is_dir"), F.struct("extension", "count", most(F.coalesce("sum", F.lit(Decimal(0)))).alias("size")))
    row = groups.agg(
        count(F.lit(True)).alias("total"), count(~F.col("is_dir")).alias("files"), count(F.col("is_dir")).alias("folders"),
        most(F.coalesce(F.sum("sum"), F.lit(Decimal(0)))).alias("total_size"), F.array_sort(F.collect_list(own), by).alias("by_extension"),
    )
    return row.join(tops, F.lit(True)).select("total", "files", "folders", "total_size", "largest", "by_extension")  # one row each


def direct_children(files: DataFrame, volume_root: str = "/") -> DataFrame:
    """(parent, size): the sizes of the files directly in each directory."""
    from ..functions.derive import parent

    files = files.where(~F.col("is_dir"))
    return files.groupBy(parent(F.col("path")).alias("parent")).agg(saturating_sum("size").alias("size")).where("parent is not null")


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the value at rank round((n - 1) * share). An exact rank selection; a sort in ranges, no list of all values."""
    from ..shared import numbered

    ranked = numbered(values.select(column), [F.col(column)], "rank")
    at = values.agg(F.round((F.count("*") - 1) * F.lit(share)).cast("long").alias("at"))
    return ranked.join(F.broadcast(at), F.col("rank") == F.col("at")).select(F.col(column).alias("value"))


def by_directory_level(files: DataFrame, levels: int = 2) -> DataFrame:
    """Extension: totals by the first components of the path, rolled up."""
    part = lambda k: F.get(F.split("path", r"[\\/]"), F.lit(k)).alias(f"level_{k}")
    cols = [f"level_{k}" for k in range(1, levels + 1)]
    rows = files.where(~F.col("is_dir")).select(*[part(k) for k in range(1, levels + 1)], "size")
    return rows.rollup(*cols).agg(F.count("*").alias("count"), saturating_sum("size").alias("size"), F.grouping_id().alias("grouping"))
