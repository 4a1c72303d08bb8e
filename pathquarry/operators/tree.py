"""Directory trees: recursive sizes, paths from parent references, mounts, prefix changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import derive, parent
from ..shared import cut


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, from the top: `/a`, `/a/b` for `/a/b/c`; `C:`, `C:\\x` for `C:\\x\\y`."""
    parts = F.split(path, r"[\\/]")
    top = lambda i: F.slice(parts, F.lit(1), i)
    join = lambda i: F.when(F.instr(path, "\\") > 0, F.array_join(top(i), "\\")).otherwise(F.array_join(top(i), "/"))
    chains = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), join)
    return F.when(F.size(parts) > 1, F.filter(chains, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def folder_sizes(entries: DataFrame) -> DataFrame:
    """Directories get the sum of the files below them, 0 for empty ones; files keep their size.

    A file is counted once for each ancestor, with map-side aggregation; a root above a third of all rows is one row a task.
    """
    files = entries.where(~F.col("is_dir"))
    below = files.select("size", F.explode(ancestors(F.col("path"))).alias("__d")).groupBy("__d").agg(F.sum(F.col("size").cast("decimal(38,0)")).cast("long").alias("__s"))
    out = entries.join(below, F.col("is_dir") & (F.col("path") == F.col("__d")), "left")
    return out.withColumn("size", F.when(F.col("is_dir"), F.coalesce("__s", F.lit(0))).otherwise(F.col("size"))).drop("__d", "__s")


def size_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, delta): what the change from one set of files to another adds to each ancestor directory."""
    side = lambda df, sign: df.where(~F.col("is_dir")).select("path", (F.col("size") * sign).alias("delta"))
    moved = side(before, -1).unionByName(side(after, 1)).groupBy("path").agg(F.sum("delta").alias("delta")).where("delta != 0")
    return moved.select(F.explode(ancestors(F.col("path"))).alias("path"), "delta").groupBy("path").agg(F.sum("delta").alias("delta")).where("delta != 0")


def apply_deltas(dirs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Directory sizes after signed changes, never below 0; files keep their size."""
    out = dirs.join(deltas, "path", "left")
    return out.withColumn("size", F.when(F.col("is_dir"), F.greatest(F.lit(0), F.col("size") + F.coalesce("delta", F.lit(0)))).otherwise(F.col("size"))).drop("delta")


def resized(kept: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """kept and added with directory sizes that follow from the rows that went and came.

    Kept directories have their size from before, and so do those only put in again: gone rows that merely make room for a row of their
    path say so by `stays`. Directories that are new under their path have what came below them.
    """
    below = lambda files, sign: files.where(~F.col("is_dir")).select(F.explode(ancestors(F.col("path"))).alias("path"), (F.col("size") * sign).alias("delta"))
    came = below(added, 1).withColumn("plus", F.col("delta"))
    deltas = came.unionByName(below(gone, -1).withColumn("plus", F.lit(0).cast("long"))).groupBy("path").agg(F.sum("delta").alias("delta"), F.sum("plus").alias("plus"))
    known = gone.where("is_dir and stays").select("path", F.col("size").alias("__s"))
    added = added.join(known, "path", "left").withColumn("size", F.when(F.col("is_dir"), F.col("__s")).otherwise(F.col("size"))).drop("__s")
    out = kept.unionByName(added.select(*kept.columns)).join(deltas, "path", "left")
    size = F.greatest(F.lit(0), F.coalesce(F.col("size") + F.coalesce("delta", F.lit(0)), "plus", F.lit(0)))
    return out.withColumn("size", F.when(F.col("is_dir"), size).otherwise(F.col("size"))).select(*kept.columns)


def resolve_paths(records: DataFrame, volume_root: str, root_ref: int = 5, sep: str = "\\") -> DataFrame:
    """records(file_ref, parent_ref, own_name) with path, by pointer doubling: each round doubles the resolved chain.

    Orphans and cycles get an empty path: a first doubling over the references alone, whose rounds are the logarithm of the number of
    records at most, finds what comes to the root, and only these records' names are put together.
    """
    up = cut(records.select("file_ref", F.col("parent_ref").alias("up")))
    for _ in range(up.count().bit_length() + 1):
        above = up.select(F.col("file_ref").alias("__r"), F.col("up").alias("__u"))
        nxt = cut(up.join(above, (F.col("up") == F.col("__r")) & (F.col("up") != root_ref), "left").select("file_ref", F.coalesce("__u", "up").alias("up"), (F.col("__u") != F.col("up")).alias("went_on")))
        up = nxt.select("file_ref", "up")
        if nxt.where("went_on").isEmpty():
            break
    rooted = up.where(F.col("up") == root_ref).select("file_ref")
    chain = cut(records.select("file_ref", F.col("parent_ref").alias("up"), F.col("own_name").alias("path")).join(rooted, "file_ref", "left_semi"))
    while not chain.where(F.col("up") != root_ref).isEmpty():
        above = chain.select(F.col("file_ref").alias("__r"), F.col("up").alias("__u"), F.col("path").alias("__p"))
        both = chain.join(above, (F.col("up") == F.col("__r")) & (F.col("up") != root_ref), "left")
        chain = cut(both.select("file_ref", F.coalesce("__u", "up").alias("up"), F.when(F.col("__p").isNull(), F.col("path")).otherwise(F.concat("__p", F.lit(sep), "path")).alias("path")))
    path = F.concat(F.lit(volume_root.rstrip("\\/") + sep), F.col("path"))
    return records.join(chain.select("file_ref", path.alias("path")), "file_ref", "left").withColumn("path", F.coalesce("path", F.lit("")))


def volume_of(path: Column, mounts: Sequence[str]) -> Column:
    """The longest mount on a component boundary; a path under none is its own first component. One expression, no join."""
    out = F.regexp_extract(path, r"^([^\\/]*)", 1)
    for m in sorted(set(mounts), key=lambda m: (len(m), m)):
        top = m.rstrip("\\/")
        out = F.when(inside(path, top) | (path == m), m).otherwise(out)
    return out


def mount_of(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """paths with volume. Mounts are those of one machine, so they are collected."""
    return paths.withColumn("volume", volume_of(F.col("path"), [r[0] for r in mounts.select("mount").distinct().collect()]))


def lookup_refs(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(volume, file_ref) with path."""
    return wanted.join(files.select("volume", "file_ref", "path"), ["volume", "file_ref"], "left")


def inside(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix + "/") | path.startswith(prefix + "\\")


def remove_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Without a directory and all below it; siblings with a longer name stay."""
    return files.where(~inside(F.col("path"), prefix))


def rename_prefix(files: DataFrame, old: str, new: str) -> DataFrame:
    """A directory and all below it under a new name, derived columns too. Rows that are already there are replaced."""
    moves = inside(F.col("path"), old)
    moved = files.where(moves).withColumn("path", F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path"))))
    base = [c for c in files.columns if c not in ("name", "lower_name", "lower_path", "extension", "excluded")]
    moved = derive(moved.select(*base)) if len(base) < len(files.columns) else moved
    stay = files.where(~moves)
    return stay.join(moved.select("path"), "path", "left_anti").unionByName(moved)


def explode_links(records: DataFrame) -> DataFrame:
    """A record with several names becomes one row for each; of names in one parent the lowest name space stays (0 POSIX, 1 long, 2 short, 3 both)."""
    rows = records.withColumn("__l", F.explode("links")).select(*[c for c in records.columns if c != "links"], F.col("__l.parent_ref").alias("parent_ref"), F.col("__l.name").alias("own_name"), F.col("__l.namespace").alias("namespace"))
    rank = F.row_number().over(Window.partitionBy("file_ref", "parent_ref").orderBy("namespace", "own_name"))
    return rows.withColumn("__k", rank).where("__k = 1").drop("__k", "namespace")


def last_writer(rows: DataFrame, key: str = "path", sequence: str = "seq") -> DataFrame:
    """The latest row of each key; of equally late ones the greatest by its other columns, so runs agree. A maximum that aggregates
    before the shuffle, so a busy key is no hot partition."""
    cols = [sequence, *(c for c in rows.columns if c not in (key, sequence))]
    return rows.groupBy(key).agg(F.max(F.struct(*cols)).alias("__r")).select(key, "__r.*").select(*rows.columns)


def with_parent(files: DataFrame) -> DataFrame:
    return files.withColumn("parent", parent(F.col("path")))
