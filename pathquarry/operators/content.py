"""Literal content search over a table of texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import ascii_lower, content_extension, fold, is_excluded
from ..shared import cut

MOST_BYTES = 256 * 1024
MEMORY_BUDGET = 256 * 1024 * 1024
DISK_BUDGET = 2 * 1024 * 1024 * 1024
PAGE = 512
# Extensions and names of text files.
TEXT_EXTENSIONS = (
    "md", "markdown", "txt", "rst", "log", "json", "jsonl", "yaml", "yml", "toml", "ini", "cfg", "conf", "config",
    "env", "properties", "xml", "html", "htm", "css", "csv", "tsv", "sql", "rs", "py", "pyw", "js", "jsx", "ts",
    "tsx", "mjs", "cjs", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "cs", "java", "kt", "kts", "go", "rb",
    "php", "sh", "bat", "cmd", "ps1", "swift", "m", "mm", "r", "scala", "clj", "cljs", "lua", "pl", "pm", "tcl", "v",
    "vhdl", "asm", "s", "gradle", "groovy", "dockerfile", "makefile", "cmake", "gitignore", "gitattributes",
    "editorconfig", "eslintrc", "prettierrc", "babelrc", "tsconfig", "package", "lock",
)
TEXT_NAMES = (
    "readme", "makefile", "dockerfile", "license", "copying", "notice", "changelog", "authors", "contributing",
    "gemfile", "rakefile", "requirements", "rust-toolchain", "cargo-config",
)


def holds(body: Column, needles: Sequence[str]) -> Column:
    """All needles occur, ASCII case aside; an empty needle occurs nowhere."""
    if not needles or "" in needles:
        return F.lit(False)
    low = ascii_lower(body)
    return reduce(and_, [low.contains(fold(n)) for n in needles])


def matching(contents: DataFrame, needles: Sequence[str]) -> DataFrame:
    """(path_key) of the texts that hold all needles."""
    return contents.where(holds(F.col("body"), needles)).select("path_key")


def contains(contents: DataFrame, path_key: str, needle: str) -> DataFrame:
    return contents.where(F.col("path_key") == path_key).agg(F.coalesce(F.bool_or(holds(F.col("body"), [needle])), F.lit(False)).alias("found"))


def search_files(files: DataFrame, contents: DataFrame, needles: Sequence[str]) -> DataFrame:
    return files.join(matching(contents, needles), F.col("lower_path") == F.col("path_key"), "left_semi")


def eligible(path: Column, size: Column, is_dir: Column) -> Column:
    """Text files of 1 byte to 256 KiB outside the directories excluded by default."""
    ext = ascii_lower(content_extension(path))
    name = ascii_lower(F.regexp_extract(path, r"([^\\/]*)$", 1))
    text = ext.isin(*TEXT_EXTENSIONS) | ((ext == "") & name.isin(*TEXT_NAMES))
    return ~is_dir & size.between(1, MOST_BYTES) & ~is_excluded(ascii_lower(path)) & text


def within_budget(files: DataFrame, budget: int = DISK_BUDGET, size: str = "size", path: str = "path", memory: bool = False) -> DataFrame:
    """The files that are taken when each, in path order, is taken if it still fits and refused otherwise (paths are unique).

    memory: the first that doesn't fit is cut to what is left (its `size` says so), and all after it are refused.

    What is left only shrinks, so a round leaves out all files larger than that and takes those up to the first that passes it, by
    sums of path ranges and a running sum in one range. The next round starts behind that file. Rounds are few: what is left halves,
    or files of half of it and more no longer fit.
    """
    room = max(0, int(budget))
    parts = cut(files.withColumn("__b", F.coalesce(F.col(size), F.lit(0)).cast("long")).repartitionByRange(path).withColumn("__p", F.spark_partition_id()), "budget")
    taken, partial, begin = F.lit(False), F.lit(False), F.lit(True)
    while True:
        fits = begin & ((F.col("__b") <= room) | F.lit(memory))
        left, sums = parts.where(fits), {}
        for r in left.groupBy("__p").agg(F.sum("__b").alias("n")).collect():  # one row a range
            sums[r["__p"]] = r["n"]
        before, full = 0, None
        for p in sorted(sums):
            if before + sums[p] > room:
                full = p
                break
            before += sums[p]
        if full is None:
            taken = taken | fits
            break
        run = F.sum("__b").over(Window.partitionBy("__p").orderBy(path).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = left.where(F.col("__p") == full).withColumn("__r", run).where(F.col("__r") > room - before).orderBy(path).first()
        taken = taken | (fits & (F.col(path) < first[path]))
        room -= before + first["__r"] - first["__b"]
        if memory:
            partial = F.col(path) == first[path]
            break
        begin = F.col(path) > first[path]
    if memory and room > 0:
        parts = parts.withColumn(size, F.when(partial, F.lit(room).cast(files.schema[size].dataType)).otherwise(F.col(size)))
        taken = taken | partial
    return parts.where(taken).drop("__b", "__p")


def stale(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Eligible files without a content row of their present modification time."""
    todo = files.where(eligible(F.col("path"), F.col("size"), F.col("is_dir")))
    known = contents.select(F.col("path_key").alias("lower_path"), F.col("source_modified").alias("modified"))
    return todo.join(known, ["lower_path", "modified"], "left_anti")


def candidates(files: DataFrame, contents: DataFrame, after: str = "", limit: int = PAGE) -> DataFrame:
    """A keyset page of stale files."""
    return stale(files, contents).where(F.col("path") > after).orderBy("path").limit(limit)


def stats(contents: DataFrame) -> DataFrame:
    return contents.agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("long").alias("bytes"))


def read_bodies(spark, paths: Sequence[str]) -> DataFrame:
    """Content rows of files by path or glob: whole files, the first 256 KiB of each."""
    raw = spark.read.format("binaryFile").load(list(paths))
    path = F.regexp_replace("path", r"^file:/*", "/")
    body = F.expr(f"substring(content, 1, {MOST_BYTES})")
    modified = (F.unix_micros("modificationTime") * 10 + 116_444_736_000_000_000).alias("source_modified")
    return raw.select(ascii_lower(path).alias("path_key"), F.make_valid_utf8(body.cast("string")).alias("body"), F.least("length", F.lit(MOST_BYTES)).alias("byte_count"), F.lit(0).cast("long").alias("indexed_at"), modified)
