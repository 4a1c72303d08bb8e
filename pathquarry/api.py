"""The public surface: ping, status, find, count, aggregate, recent changes, over frames or a stored catalog."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.derive import project_fields, tool_view
from .operators import aggregate as A
from .operators import changes as C
from .operators import search as S
from .operators.catalog import Store
from .operators.content import DISK_BUDGET, MEMORY_BUDGET
from .plans.language import Options
from .schema import CHANGE, CONTENT, VERSION


@dataclass(frozen=True)
class Settings:
    """Where the catalog lives and what content it keeps: mode `disk`, `memory` (the last text is cut to fit) or `off`."""

    root: str | None = None
    content_mode: str = "disk"
    content_budget: int = DISK_BUDGET

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """From PATHQUARRY_ROOT, PATHQUARRY_CONTENT and PATHQUARRY_CONTENT_BUDGET; a budget that is no number is the mode's own."""
        mode = env.get("PATHQUARRY_CONTENT", "disk").strip().lower()
        if mode not in ("disk", "memory", "off"):
            raise ValueError(f"PATHQUARRY_CONTENT is {mode!r}, not disk, memory or off")
        budget = env.get("PATHQUARRY_CONTENT_BUDGET", "").strip()
        return cls(env.get("PATHQUARRY_ROOT"), mode, int(budget) if budget.isdigit() else MEMORY_BUDGET if mode == "memory" else DISK_BUDGET)

    def store(self, spark: SparkSession) -> Store:
        if self.root is None:
            raise ValueError("no root: set PATHQUARRY_ROOT")
        return Store(spark, self.root)

    def insert_content(self, store: Store, rows: DataFrame) -> None:
        """Content rows as the mode has it."""
        if self.content_mode != "off":
            store.insert_content(rows, self.content_budget, self.content_mode == "memory")


def _not_path(options: dict) -> None:
    if "match_path" in options:
        raise TypeError("match_path is an option of find only")


class Catalog:
    """files, contents and changes are frames; open() takes them from a store."""

    def __init__(self, files: DataFrame, contents: DataFrame | None = None, changes: DataFrame | None = None):
        self.spark = files.sparkSession
        self.files = files
        self.contents = self.spark.createDataFrame([], CONTENT) if contents is None else contents
        self.changes = self.spark.createDataFrame([], CHANGE).withColumn("seq", F.lit(0)) if changes is None else changes

    @classmethod
    def open(cls, spark: SparkSession, root: str, changes: DataFrame | None = None) -> Catalog:
        store = Store(spark, root)
        return cls(store.read(), store.read("contents"), changes)

    def ping(self) -> str:
        return "pong"

    def status(self) -> DataFrame:
        files = self.files.agg(F.count("*").alias("entries"), F.array_sort(F.collect_set("volume")).alias("volumes"))
        content = self.contents.agg(F.count("*").alias("content_files"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("long").alias("content_bytes"))
        return files.join(content, F.lit(True)).withColumn("schema_version", F.lit(VERSION))

    def find(self, query: str = "", fields: str | None = None, raw: bool = False, **options) -> DataFrame:
        """A page of results as tools show them (raw: catalog columns). max_results defaults to 100; 0 means 100 too."""
        o = Options(query=query, **options)
        rows = S.find(self.files, replace(o, max_results=o.max_results or 100), self.contents)
        return rows if raw else project_fields(tool_view(rows), fields)

    def note(self, **options) -> str | None:
        return S.exclusion_note(Options(**options))

    def count(self, query: str = "", **options) -> int:
        _not_path(options)
        return S.count(self.files, Options(query=query, **options), self.contents).first()[0]

    def aggregate(self, query: str = "", top: int = 20, **options) -> DataFrame:
        _not_path(options)
        return A.aggregate(self.files, Options(query=query, **options), top, self.contents)

    def recent_changes(self, since: int = 0, limit: int = 100, reasons: str | None = None, hours: float | None = None, now: int | None = None) -> DataFrame:
        if hours is not None:
            since = C.since_hours(hours, now if now is not None else Options.now, since)
        return C.recent(self.changes, since, limit, reasons)
