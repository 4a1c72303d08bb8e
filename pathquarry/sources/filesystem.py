"""A file-system scan as a Spark data source: one partition for each subtree, split level by level until there are enough.

Symbolic links, names that are not UTF-8 and other devices are left out; times are FILETIMEs; unreadable entries are skipped.
Usage: spark.dataSource.register(FileSystem); spark.read.format("filesystem").load("/path").
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ENTRY

# File-system types that hold files of their own.
FILE_SYSTEMS = "ext2 ext3 ext4 xfs btrfs f2fs zfs ntfs ntfs3 vfat exfat apfs hfs overlay".split()


def filetime(ns: int) -> int:
    seconds, rest = divmod(ns, 1_000_000_000)
    return 0 if seconds == 0 else (seconds + 11_644_473_600) * 10_000_000 + rest // 100


def stat_path(path: str, volume: str = "/", read_only: bool = True) -> tuple | None:
    """The catalog row of one path; None if there is none, or it is a link. read_only: whether missing write bits set that attribute."""
    try:
        path.encode()
        s = os.lstat(path)
    except (OSError, UnicodeEncodeError):
        return None
    if stat.S_ISLNK(s.st_mode):
        return None
    is_dir = stat.S_ISDIR(s.st_mode)
    name = os.path.basename(path)
    bits = (0x10 if is_dir else 0) | (0x2 if name.startswith(".") else 0) | (0x1 if read_only and not s.st_mode & 0o222 else 0) | (0x20 if stat.S_ISREG(s.st_mode) else 0)
    born = int(getattr(s, "st_birthtime", 0) * 1_000_000_000) or s.st_ctime_ns or s.st_mtime_ns
    return path, 0 if is_dir else s.st_size, filetime(born), filetime(s.st_mtime_ns), filetime(s.st_atime_ns), is_dir, bits, s.st_ino, volume


class Subtree(InputPartition):
    """Directories with all below them, or (not deep) with their files only."""

    def __init__(self, paths: list[str], deep: bool, device: int):
        self.paths, self.deep, self.device = paths, deep, device


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "/")
        self.volume = options.get("volume", self.root)
        self.least = int(options.get("partitions", 64))
        self.read_only = options.get("readonly", "true").lower() == "true"

    def _children(self, path: str) -> list[str]:
        try:
            return [path.rstrip("/") + "/" + e.name for e in os.scandir(path) if not e.is_symlink()]
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        device = os.lstat(self.root).st_dev
        parts, front = [], [self.root]
        while front and len(front) < self.least:
            parts.append(Subtree(front, False, device))
            front = [p for d in front for p in self._children(d) if os.path.isdir(p) and self._on(p, device)]
        return [*parts, *(Subtree([p], True, device) for p in sorted(front, key=os.fsencode))]

    @staticmethod
    def _on(path: str, device: int) -> bool:
        try:
            return os.lstat(path).st_dev == device
        except OSError:
            return False

    def read(self, part: Subtree) -> Iterator[tuple]:
        todo = list(part.paths)
        if not part.deep:  # directories below are in other partitions, but for those of other devices, which are rows without children
            for d in part.paths:
                todo += [p for p in self._children(d) if not os.path.isdir(p) or not self._on(p, part.device)]
        while todo:
            path = todo.pop()
            row = stat_path(path, self.volume, self.read_only)
            if row is None:
                continue
            yield row
            if part.deep and row[5] and self._on(path, part.device):
                todo += self._children(path)


class FileSystem(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filesystem"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return _Reader(self.options)


def scan(spark: SparkSession, *volumes: str) -> DataFrame:
    """All volumes' rows; a volume that can't be opened is left out."""
    spark.dataSource.register(FileSystem)
    frames = [spark.read.format("filesystem").option("volume", v).load(v) for v in volumes if os.path.isdir(v)]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], ENTRY)


def statistics(entries: DataFrame) -> DataFrame:
    return entries.groupBy("volume").agg(F.count("*").alias("entries"))


def discover(mounts: DataFrame) -> DataFrame:
    """mounts(device, mount, type): those of real file systems, the longest mount of a device, `/` first."""
    real = mounts.where(F.col("type").isin(*FILE_SYSTEMS))
    best = real.groupBy("device").agg(F.max_by("mount", F.struct(F.length("mount"), "mount")).alias("mount"))
    return best.select("mount", "device").orderBy(F.desc(F.col("mount") == "/"), "mount")


def mounts(spark: SparkSession, table: str = "/proc/mounts") -> DataFrame:
    rows = []
    if os.path.exists(table):
        with open(table) as f:
            fields = [line.split()[:3] for line in f if len(line.split()) >= 3]
            rows = [tuple(re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), x) for x in r) for r in fields]  # blanks are \040 there
    return spark.createDataFrame(rows, "device string, mount string, type string")


def patch_zero_sizes(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """Files of size 0 take the size that stats(path, size) has for them."""
    known = stats.select("path", F.col("size").alias("__s"))
    out = entries.join(known, "path", "left")
    return out.withColumn("size", F.when(~F.col("is_dir") & (F.col("size") == 0), F.coalesce("__s", "size")).otherwise(F.col("size"))).drop("__s")
