"""The change feed, in batch: queries over it, and what it does to a catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import derive
from ..schema import EPOCH, PENDING, TICKS
from ..shared import cut
from .tree import last_writer

HISTORY = 100_000


def category(reason: Column) -> Column:
    return F.when(reason == "DELETE", "deleted").when(reason.isin("RENAME", "RENAME_NEW"), "renamed").otherwise("modified")


def of_reasons(reason: Column, wanted: Sequence[str] | str | None) -> Column:
    """Categories of a (comma) list, case aside; created means modified; none means all."""
    names = wanted.split(",") if isinstance(wanted, str) else list(wanted or [])
    names = {"modified" if n == "created" else n for n in (x.strip().lower() for x in names) if n}
    return category(reason).isin(*sorted(names)) if names else F.lit(True)


def recent(changes: DataFrame, since: int = 0, limit: int = 0, reasons: Sequence[str] | str | None = None) -> DataFrame:
    """Changes later than since (FILETIME), last arrived first; limit 0 is none."""
    out = changes.where((F.col("timestamp") > since) & of_reasons(F.col("reason"), reasons)).orderBy(F.desc("seq"))
    return out.limit(limit) if limit else out


def since_hours(hours: float, now: int, since: int | None = None) -> int:
    """The cutoff of `hours`; an explicit since wins. now: Unix seconds."""
    return since if since else EPOCH + now * TICKS - int(hours * 3600 * TICKS)


def history(changes: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last arrivals."""
    return changes.orderBy(F.desc("seq")).limit(most)


def normalize(mask: Column, bits: dict[str, int]) -> Column:
    """A reason from event bits; deletes win, then renames, creation, writing."""
    out = F.when(mask.bitwiseAND(bits["delete"]) != 0, "DELETE")
    for key, reason in (("rename_new", "RENAME_NEW"), ("rename_old", "RENAME"), ("create", "CREATE"), ("write", "WRITE")):
        if key in bits:
            out = out.when(mask.bitwiseAND(bits[key]) != 0, reason)
    return out


def upsert(files: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """files with rows put in by key."""
    return files.join(rows.select(key), key, "left_anti").unionByName(rows)


def pair_renames(changes: DataFrame) -> DataFrame:
    """(file_ref, old_path, new_path, seq): each RENAME_NEW with the last RENAME of its file before it, if none came between.

    A window over each file's few events; an old name without a new one, or the reverse, pairs with nothing, and a DELETE forgets it.
    """
    w = Window.partitionBy("file_ref").orderBy("seq")
    renames = changes.where(F.col("reason").isin("RENAME", "RENAME_NEW", "DELETE"))
    before = renames.withColumn("__r", F.lag("reason").over(w)).withColumn("old_path", F.lag("path").over(w))
    return before.where((F.col("reason") == "RENAME_NEW") & (F.col("__r") == "RENAME")).select("file_ref", "old_path", F.col("path").alias("new_path"), "seq")


def waiting(changes: DataFrame) -> DataFrame:
    """Old names of directories whose new names haven't come: a later batch may bring them."""
    w = Window.partitionBy("file_ref").orderBy("seq")
    renames = changes.where(F.col("is_dir") & F.col("reason").isin("RENAME", "RENAME_NEW", "DELETE"))
    last = renames.withColumn("__n", F.lead("seq").over(w)).where("__n is null and reason = 'RENAME'")
    return last.select(*PENDING.names)


def with_last_path(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes with the path under which the catalog knows their file."""
    return changes.join(files.select("file_ref", F.col("path").alias("known_path")), "file_ref", "left")


def directory_steps(changes: DataFrame, pending: DataFrame | None = None) -> list[tuple[int, str, str | None]]:
    """(seq, directory, its new name or None for deleted), in order of arrival, since they do not commute.

    Sources report a directory's rename or deletion only, not what is below it. pending: old names left over from batches before.
    Held on the driver: one entry for each directory that a batch moves or deletes.
    """
    events = changes.where("is_dir").select(*PENDING.names, "reason")
    if pending is not None:
        events = events.unionByName(pending.select(*PENDING.names).withColumn("reason", F.lit("RENAME")))
    moves = pair_renames(events).where("old_path <> new_path").select("seq", F.col("old_path").alias("old"), F.col("new_path").alias("new"))
    drops = changes.where("is_dir and reason = 'DELETE'").select("seq", F.col("path").alias("old"), F.lit(None).cast("string").alias("new"))
    return sorted((tuple(r) for r in moves.unionByName(drops).collect()), key=lambda r: r[0])


def walk(path: Column, steps: Sequence[tuple[int, str, str | None]], since: Column | None = None) -> Column:
    """Where a path is after all steps (those later than since); null if one deleted it. A fold over constants, no join."""
    if not steps:
        return path
    one = lambda s: F.struct(F.lit(s[0]).cast("long").alias("seq"), F.lit(s[1]).alias("old"), F.lit(s[2]).cast("string").alias("new"))

    def go(p: Column, s: Column) -> Column:
        hit = (p == s["old"]) | F.startswith(p, F.concat(s["old"], F.lit("/"))) | F.startswith(p, F.concat(s["old"], F.lit("\\")))
        if since is not None:
            hit = hit & (s["seq"] > since)
        return F.when(hit, F.concat(s["new"], F.substring(p, F.length(s["old"]) + 1, F.length(p)))).otherwise(p)

    return F.aggregate(F.array(*map(one, steps)), path, go)


@dataclass
class Applied:
    """What a batch makes of a catalog: rows that stay as they are, that go (`stays`: only replaced under their path), and that come."""

    kept: DataFrame
    gone: DataFrame
    added: DataFrame
    moves: DataFrame  # (path, to): rows below moved and deleted directories; to is null for the latter
    events: DataFrame  # (path, seq, reason): the last event of each path, where it is now

    def after(self) -> DataFrame:
        return self.kept.unionByName(self.added.select(*self.kept.columns))


def split_changes(files: DataFrame, changes: DataFrame, entries: DataFrame | Callable[[DataFrame], DataFrame], pending: DataFrame | None = None) -> Applied:
    """Applies a batch of changes(seq, reason, path, is_dir, file_ref). entries: present rows (as a fresh stat gives them) of changed paths.

    Subtrees of moved directories go with them and those of deleted ones go; an old name without a new one waits (`waiting`). An
    event's path is where its file is after the directory steps that followed it. Of a path only the last event counts: deletes and old
    names of files go, others are put in as entries has them, or go if it hasn't.
    """
    steps = directory_steps(changes, pending)
    plain = changes.where(~(F.col("is_dir") & F.col("reason").isin("DELETE", "RENAME")))
    at = plain.select(walk(F.col("path"), steps, F.col("seq")).alias("path"), "seq", "reason").where("path is not null")
    events = cut(last_writer(at), "events")
    there = events.where(~F.col("reason").isin("DELETE", "RENAME")).select("path")
    entries = entries(there) if callable(entries) else entries
    now = last_writer(entries.select(*files.columns).join(there, "path", "left_semi"), "path", "modified" if "modified" in files.columns else files.columns[1])
    moved = files.withColumn("__to", walk(F.col("path"), steps))
    shifted = cut(moved.where("__to is null or __to <> path"), "moved")
    came = last_writer(shifted.where("__to is not null").drop("path").withColumnRenamed("__to", "path").select(*files.columns), "path", files.columns[1])
    came = came.join(events.select("path"), "path", "left_anti")
    added = cut(came.unionByName(now.select(*came.columns)), "added")
    touched = events.select("path").union(added.select("path")).distinct()
    still = moved.where("__to = path").drop("__to")
    kept = still.join(touched, "path", "left_anti")
    replaced = still.join(touched, "path", "left_semi").withColumn("stays", F.lit(True))
    gone = cut(shifted.drop("__to").withColumn("stays", F.lit(False)).unionByName(replaced.select(*files.columns, "stays")), "gone")
    return Applied(kept.select(*files.columns), gone, added.select(*files.columns), shifted.select("path", F.col("__to").alias("to")), events)


def apply_changes(files: DataFrame, changes: DataFrame, entries: DataFrame | Callable[[DataFrame], DataFrame], pending: DataFrame | None = None) -> DataFrame:
    """The catalog after a batch of changes (see split_changes); directory sizes are as they were."""
    return split_changes(files, changes, entries, pending).after()


def apply_directory_renames(files: DataFrame, renames: Sequence[tuple[str, str]]) -> DataFrame:
    """Renames of directories, in order of arrival, as one mapping of paths. Rows that are already there are replaced."""
    steps = [(k, old, new) for k, (old, new) in enumerate(renames)]
    to = files.withColumn("__to", walk(F.col("path"), steps))
    moved = to.where("__to <> path").drop("path").withColumnRenamed("__to", "path").select(*files.columns)
    derived = [c for c in files.columns if c not in ("name", "lower_name", "lower_path", "extension", "excluded")]
    moved = derive(moved.select(*derived)) if len(derived) < len(files.columns) else moved
    return to.where("__to = path").drop("__to").join(moved.select("path"), "path", "left_anti").unionByName(moved)


def rates(changes: DataFrame, seconds: int = 3600) -> DataFrame:
    """Extension: changes for each window of event time and category."""
    ts = F.timestamp_micros(F.floor((F.col("timestamp") - EPOCH) / 10).cast("long"))
    window = F.window(ts, f"{seconds} seconds")
    return changes.groupBy(window.alias("w"), category(F.col("reason")).alias("category")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")
