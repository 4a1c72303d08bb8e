"""A change journal that can be read again from any cursor, as a streaming source.

The journal is a folder of segments, `<first sequence number>.jsonl`, one event a line, numbered without gaps; old segments may be
deleted. A cursor is the number of the next event. A reader whose cursor lies before the first segment has lost events: it is told so
by one row of reason OVERFLOW with the volume as its path, and goes on with the first event there is. The folder must be visible to
driver and executors.

Usage: spark.dataSource.register(Journal); spark.readStream.format("changejournal").option("volume", "/data").load("/shared/journal").
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schema import JOURNAL
from ..shared import cut, numbered


#: Events of a segment at most, where segments are written by tasks.
SEGMENT = 250_000


def segments(path: str) -> list[tuple[int, str]]:
    """(first number, file) of all segments, in order."""
    return sorted((int(n[:-6]), os.path.join(path, n)) for n in os.listdir(path) if n.endswith(".jsonl") and n[:-6].isdigit())


def _events(file: str, first: int) -> Iterator[tuple[int, dict]]:
    with open(file, encoding="utf-8") as f:
        for k, line in enumerate(f):
            if not line.endswith("\n"):
                return  # still being written
            try:
                event = json.loads(line)
            except ValueError:
                continue  # keeps its number
            if isinstance(event, dict):
                yield first + k, event


def tail(path: str) -> int:
    """The cursor behind the last whole line."""
    found = segments(path)
    if not found:
        return 0
    first, file = found[-1]
    with open(file, "rb") as f:
        return first + sum(block.count(b"\n") for block in iter(lambda: f.read(1 << 20), b""))


def write_segment(path: str, events: Sequence[dict]) -> int:
    """Adds a segment behind the last one; returns the new tail. Written under another name first, so readers see it whole."""
    os.makedirs(path, exist_ok=True)
    first = tail(path)
    name = os.path.join(path, f"{first:020d}.jsonl")
    with open(name + ".tmp", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)
    os.rename(name + ".tmp", name)
    return first + len(events)


def write_segments(path: str, events: DataFrame, by: list[Column], least: int = 1) -> int:
    """Adds all events in the order of `by` behind the last segment, about `least` segments or more; returns the new tail.

    Tasks write the segments, one or more each, so the driver holds no events. Each appears whole under its final name; a task that
    runs again writes the same once more. The new segments become visible one by one: readers should start after the call.
    """
    os.makedirs(path, exist_ok=True)
    first, columns = tail(path), events.columns
    rows = cut(numbered(events, by, "__seq"), "journal")
    count = rows.count()
    step = max(1, min(-(-count // least), SEGMENT))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, here = None, "", -1

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, name)

        for b in batches:
            numbers = b.column("__seq").to_pylist()
            for n, event in zip(numbers, b.select(columns).to_pylist(), strict=True):
                if n // step != here:
                    close()
                    here = n // step
                    name = os.path.join(path, f"{first + here * step:020d}.jsonl")
                    out = open(f"{name}.{uuid.uuid4().hex}.tmp", "w", encoding="utf-8")  # noqa: SIM115
                out.write(json.dumps(event) + "\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    parts = max(1, -(-count // step))
    dealt = rows.withColumn("__part", F.floor(F.col("__seq") / step)).repartition(min(parts, 1000), "__part").sortWithinPartitions("__seq")
    dealt.select("__seq", *columns).mapInArrow(work, "n long").write.format("noop").mode("overwrite").save()
    return first + count


class _Part(InputPartition):
    def __init__(self, file: str | None, first: int, start: int, end: int):
        self.file, self.first, self.start, self.end = file, first, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.volume = options["path"], options.get("volume", "/")
        self.cursor, self.most = int(options.get("cursor", 0)), int(options.get("maxevents", 0))

    def initialOffset(self) -> dict:
        return {"cursor": self.cursor}

    def latestOffset(self) -> dict:
        return {"cursor": max(self.cursor, tail(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One for each segment that the range meets."""
        a, b, found = start["cursor"], end["cursor"], segments(self.path)
        parts = [_Part(f, first, max(a, first), b) for (first, f), nxt in zip(found, [*(s[0] for s in found[1:]), b], strict=True) if first < b and nxt > a]
        if a < b and (not found or found[0][0] > a):
            parts.insert(0, _Part(None, 0, a, b))
        return parts

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.file is None:
            yield part.start, 0, "OVERFLOW", self.volume, True, None
            return
        for seq, e in _events(part.file, part.first):
            if part.start <= seq < part.end and isinstance(e.get("path"), str) and isinstance(e.get("reason"), str):
                yield seq, e.get("timestamp", 0), e["reason"], e["path"], bool(e.get("is_dir", False)), e.get("file_ref")


class Journal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changejournal"

    def schema(self):
        return JOURNAL

    def streamReader(self, schema):
        return _Reader(self.options)


def stream(spark: SparkSession, path: str, volume: str = "/", cursor: int = 0) -> DataFrame:
    """All events from a cursor on; a query's own checkpoint wins over the cursor once there is one."""
    spark.dataSource.register(Journal)
    return spark.readStream.format("changejournal").option("volume", volume).option("cursor", cursor).load(path)
