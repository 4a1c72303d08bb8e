"""Versioned catalog snapshots: immutable Parquet directories, and a manifest that names the current ones.

Files are stored by volume, so a change rewrites the volumes it touches and no other. A new version is written beside the old one and
becomes current when a manifest with a higher number appears, so readers never see half of it, and a batch that changes several tables
is there as a whole or not at all. Paths may be in any store that Hadoop's file system interface reaches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derive import derive
from ..schema import CATALOG, CHECKPOINT, CONTENT, ENTRY, PENDING, VERSION
from ..shared import cut
from .content import DISK_BUDGET, within_budget
from .tree import folder_sizes, last_writer, resized


@dataclass
class Manifest:
    """tables: table -> part (a volume of files, else "") -> directory."""

    number: int = 0
    schema_version: int = VERSION
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """Tables files, contents, checkpoints and pending (old names that wait for new ones) under one root."""

    SCHEMAS = {"files": CATALOG, "contents": CONTENT, "checkpoints": CHECKPOINT, "pending": PENDING}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # manifest

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> Manifest:
        """The newest manifest that can be read; damaged ones are put aside."""
        for n in reversed(self._numbers()):
            name = f"{self.root}/manifest/{n:012d}.json"
            try:
                m = Manifest(**json.loads("".join(r[0] for r in self.spark.read.text(name).collect())))
            except (ValueError, TypeError):
                self._fs.rename(self._path(name), self._path(name + ".damaged"))
                continue
            if m.schema_version > VERSION:
                raise ValueError(f"{name} has schema version {m.schema_version}; this is {VERSION}")
            return m
        return Manifest()

    def _publish(self, m: Manifest) -> None:
        m.number += 1
        name = f"{self.root}/manifest/{m.number:012d}.json"
        out = self._fs.create(self._path(name + ".tmp"), True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        if not self._fs.rename(self._path(name + ".tmp"), self._path(name)):
            raise RuntimeError(f"another writer has published {name}")

    # tables

    def volumes(self) -> list[str]:
        return sorted(self.manifest().tables.get("files", {}))

    def read(self, table: str = "files", parts: Sequence[str] | None = None) -> DataFrame:
        """A table, or only some volumes of files."""
        have = self.manifest().tables.get(table, {})
        paths = [p for k, p in sorted(have.items()) if parts is None or k in parts]
        return self.spark.read.schema(self.SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMAS[table])

    def publish(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None, volumes: Sequence[str] | None = None) -> bool:
        """Replaces tables, all at once; of files only these volumes (None: all). False if this batch is already in.

        Files are sorted by path inside their volume, so readers skip row groups.
        """
        m = self.manifest()
        if batch and m.batches.get(batch[0], -1) >= batch[1]:
            return False
        for table, df in tables.items():
            path = f"{self.root}/{table}/{m.number + 1:012d}"
            df = df.select(*self.SCHEMAS[table].names)
            if table != "files":
                df.write.mode("overwrite").parquet(path)
                m.tables[table] = {"": path}
                continue
            volume = F.coalesce("volume", F.lit(""))
            rows = df.withColumn("part", F.xxhash64(volume)).repartitionByRange("part", "lower_path").sortWithinPartitions("part", "lower_path")
            rows.write.mode("overwrite").partitionBy("part").parquet(path)
            left = {k: p for k, p in m.tables.get("files", {}).items() if volumes is not None and k not in volumes}
            if self._fs.exists(self._path(path)) and any("part=" in s.getPath().getName() for s in self._fs.listStatus(self._path(path))):
                written = self.spark.read.schema(CATALOG).parquet(path).select(volume.alias("v")).distinct().select("v", F.xxhash64("v").alias("h"))
                left |= {r["v"]: f"{path}/part={r['h']}" for r in written.collect()}  # a row for each volume
            m.tables["files"] = left
        if batch:
            m.batches[batch[0]] = batch[1]
        self._publish(m)
        return True

    def write(self, table: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Replaces a whole table."""
        self.publish({table: df}, batch)

    def replace(self, entries: DataFrame, recompute_sizes: bool = True) -> None:
        """The whole catalog; of rows with one path the one with the latest modification stays."""
        one = last_writer(entries.select(*ENTRY.names), "path", "modified")
        self.write("files", derive(folder_sizes(one) if recompute_sizes else one))

    def replace_volume(self, volume: str, entries: DataFrame) -> None:
        """One volume; the others' files aren't touched."""
        one = last_writer(entries.select(*ENTRY.names), "path", "modified").where(F.col("volume") == volume)
        self.publish({"files": derive(folder_sizes(one))}, volumes=[volume])

    def upsert(self, entries: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Rows put in by path, in their volumes; the sizes of directories above them follow."""
        new = cut(last_writer(entries.select(*ENTRY.names), "path", "modified"), "upsert")
        volumes = [r[0] or "" for r in new.select("volume").distinct().collect()]
        files = self.read("files", volumes).select(*ENTRY.names)
        gone = cut(files.join(new.select("path"), "path", "left_semi").withColumn("stays", F.lit(True)), "upsert")
        kept = files.join(new.select("path"), "path", "left_anti")
        self.publish({"files": derive(resized(kept, gone, new))}, batch, volumes)

    def with_content(self, rows: DataFrame, budget: int = DISK_BUDGET, memory: bool = False, drop: DataFrame | None = None) -> DataFrame:
        """The content table with rows put in by key. Stored rows stay: a new one is refused if it doesn't fit (memory: the last is cut).

        Rows that take no more than the ones they replace come first, the others in path order. drop: (path_key) of rows to leave out.
        """
        old = self.read("contents")
        old = old if drop is None else old.join(drop.select("path_key"), "path_key", "left_anti")
        rows = rows.select(*CONTENT.names).where(F.col("byte_count") > 0).dropDuplicates(["path_key"])
        both = rows.join(old.select("path_key", F.col("byte_count").alias("__o")), "path_key", "left")
        both = cut(both.withColumn("__more", F.col("byte_count") - F.coalesce("__o", F.lit(0))), "contents")
        less = both.where("__more <= 0")
        used = old.agg(F.coalesce(F.sum("byte_count"), F.lit(0))).first()[0] + less.agg(F.coalesce(F.sum("__more"), F.lit(0))).first()[0]
        more = within_budget(both.where("__more > 0"), budget - used, "__more", "path_key", memory)
        more = more.withColumn("byte_count", F.col("__more") + F.coalesce("__o", F.lit(0)))
        whole = F.octet_length("body") <= F.col("byte_count")
        cut_body = F.make_valid_utf8(F.substring(F.encode("body", "UTF-8"), F.lit(1), F.col("byte_count").cast("int")).cast("string"))
        more = more.withColumn("body", F.when(whole, F.col("body")).otherwise(cut_body))
        new = cut(less.select(*CONTENT.names).unionByName(more.select(*CONTENT.names)), "contents")
        return old.join(new.select("path_key"), "path_key", "left_anti").unionByName(new)

    def insert_content(self, rows: DataFrame, budget: int = DISK_BUDGET, memory: bool = False) -> None:
        self.write("contents", self.with_content(rows, budget, memory))

    def clear_content(self) -> None:
        self.write("contents", self.spark.createDataFrame([], CONTENT))

    def save_checkpoints(self, rows: DataFrame, volumes_only: bool = False) -> None:
        """All checkpoints, or (volumes_only) those of the volumes in rows."""
        if volumes_only:
            rows = self.read("checkpoints").join(rows.select("volume"), "volume", "left_anti").unionByName(rows)
        self.write("checkpoints", rows)

    def can_resume(self, live: DataFrame) -> bool:
        """True if the live journals are those of the saved checkpoints, one for one, and no cursor is behind its saved one."""
        saved = self.read("checkpoints").select("volume", F.col("journal_id").alias("j"), F.col("cursor").alias("c"))
        both = live.join(saved, "volume", "full")
        ok = (F.col("journal_id") == F.col("j")) & (F.col("cursor") >= F.col("c"))
        return not live.isEmpty() and both.where(~F.coalesce(ok, F.lit(False))).isEmpty()

    def compact(self, keep: int = 2) -> int:
        """Deletes table versions that no recent manifest names; returns how many."""
        live = set()
        for n in self._numbers()[-keep:]:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest/{n:012d}.json").collect())
            live |= {(t, p.removeprefix(f"{self.root}/{t}/").split("/")[0]) for t, parts in json.loads(text)["tables"].items() for p in parts.values()}
        gone = 0
        for table in self.SCHEMAS:
            folder = self._path(f"{self.root}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if (table, s.getPath().getName()) not in live:
                    gone += self._fs.delete(s.getPath(), True)
        return gone

    def quarantine(self) -> list[tuple[str, str]]:
        """Reads everything; parts that can't be read are put aside and leave the manifest. Returns them, to be scanned again."""
        m, bad = self.manifest(), []
        for table, parts in m.tables.items():
            for part, path in list(parts.items()):
                try:
                    self.spark.read.schema(self.SCHEMAS[table]).parquet(path).write.format("noop").mode("overwrite").save()
                except (Py4JJavaError, PySparkException):
                    if self._fs.exists(self._path(path)):
                        self._fs.rename(self._path(path), self._path(f"{self.root}/damaged-{table}-{int(time.time() * 1000)}-{len(bad)}"))
                    del parts[part]
                    bad.append((table, part))
        if bad:
            self._publish(m)
        return bad

    def validate(self) -> DataFrame:
        """One row: what is wrong with the current catalog, as counts."""
        files = self.read()
        twice = files.groupBy("path").count().where("count > 1").agg(F.count("*").alias("repeated_paths"))
        bad = files.agg(F.count_if(F.col("path").isNull()).alias("null_paths"), F.count_if(F.col("size") < 0).alias("negative_sizes"))
        return bad.join(twice, F.lit(True))

    def status(self) -> DataFrame:
        """One row: version, entries, volumes, storage, content."""
        m = self.manifest()
        files = self.read().agg(F.count("*").alias("entries"), F.array_sort(F.collect_set("volume")).alias("volumes"))
        content = self.read("contents").agg(F.count("*").alias("content_files"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("long").alias("content_bytes"))
        return files.join(content, F.lit(True)).withColumns({"snapshot": F.lit(m.number), "schema_version": F.lit(VERSION), "storage": F.lit("parquet")})
