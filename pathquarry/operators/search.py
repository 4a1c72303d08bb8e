"""Ordered, paged search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import ascii_lower
from ..plans.compile import apply
from ..plans.language import Options

#: sort name -> keys. Everything ends in the raw path, so orders are total.
SORTS = {
    "name": lambda: [F.asc("lower_name"), F.asc("lower_path")],
    "name_desc": lambda: [F.desc("lower_name"), F.asc("lower_path")],
    "path": lambda: [F.asc("lower_path")],
    "path_desc": lambda: [F.desc("lower_path")],
    "extension": lambda: [F.asc_nulls_first("extension"), F.asc("lower_name")],
    "extension_desc": lambda: [F.desc_nulls_last("extension"), F.asc("lower_name")],
}
for _key, _column in (("size", "size"), ("date_modified", "modified"), ("date_created", "created"), ("date_accessed", "accessed")):
    SORTS[_key] = lambda c=_column: [F.desc(c), F.asc("lower_path")]  # largest and newest first
    SORTS[f"{_key}_asc"] = lambda c=_column: [F.asc(c), F.asc("lower_path")]


def order(sort: str) -> list[Column]:
    """The keys of a sort; unknown names sort by name."""
    return [*SORTS.get(sort, SORTS["name"])(), F.asc("path")]


def matching(files: DataFrame, options: Options, contents: DataFrame | None = None) -> DataFrame:
    return apply(files, options, contents)


def page(found: DataFrame, options: Options) -> DataFrame:
    """One page: a top-k of offset + max_results rows in each task, never a whole sort; max_results 0 is no limit."""
    out = found.orderBy(*order(options.sort))
    if options.offset:
        out = out.offset(options.offset)
    return out.limit(options.max_results) if options.max_results else out


def find(files: DataFrame, options: Options, contents: DataFrame | None = None) -> DataFrame:
    return page(matching(files, options, contents), options)


def count(files: DataFrame, options: Options, contents: DataFrame | None = None) -> DataFrame:
    """One row: the number of matches, without sorting or paging them."""
    return matching(files, options, contents).agg(F.count("*").alias("total"))


def after(files: DataFrame, path: str, limit: int) -> DataFrame:
    """Keyset page in path order."""
    return files.where(F.col("path") > path).orderBy("path").limit(limit)


def exclusion_note(options: Options) -> str | None:
    """What a result says about rows left out by default."""
    from ..schema import DEFAULT_EXCLUDED

    notes = []
    if not options.include_all:
        notes.append("default exclusions apply (" + ", ".join(DEFAULT_EXCLUDED) + "); set include_all to see them")
    if options.exclude_path:
        notes.append(f"excluded paths: {options.exclude_path}")
    return "; ".join(notes) or None


def fold_key(c: Column) -> Column:
    """Order of names without regard to ASCII case; shorter first among equal beginnings."""
    return ascii_lower(c)


def duplicates(files: DataFrame) -> DataFrame:
    """Rows whose lower-cased name occurs more than once."""
    return apply(files, Options(query="dupe:filename", include_all=True))
