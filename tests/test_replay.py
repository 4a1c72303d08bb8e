"""journals are written by tasks; the driver holds no events."""

import json

import pytest
from pyspark.sql import functions as F

from pathquarry.queries import QUERIES
from pathquarry.sources import replay


def test_segments_of_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "SEGMENT", 70)
    path = str(tmp_path / "journal")
    replay.write_segment(path, [{"reason": "WRITE", "path": "/first"}])
    events = spark.range(1000).select((-F.col("id")).alias("timestamp"), F.lit("WRITE").alias("reason"), F.concat(F.lit("/é"), "id").alias("path"))
    assert replay.write_segments(path, events, [F.col("timestamp")], 4) == 1001 == replay.tail(path)
    found = replay.segments(path)
    assert [n for n, _ in found] == [0, *range(1, 1001, 70)]
    lines = [json.loads(line) for _, f in found for line in open(f, encoding="utf-8")]
    assert [e["path"] for e in lines] == ["/first", *(f"/é{i}" for i in reversed(range(1000)))]
    assert replay.write_segments(path, events.limit(0), [F.col("timestamp")]) == 1001


@pytest.mark.parametrize("name", ["ops_01_replay", "ops_15_overflow", "ops_19_tail_before_scan"])
def test_driver_holds_no_events(spark, monkeypatch, name):
    own = replay.write_segment

    def few(path, events):
        assert len(events) <= 1
        return own(path, events)

    monkeypatch.setattr(replay, "write_segment", few)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
