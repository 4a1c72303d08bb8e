"""The change feed as a stream: rename pairing with state, and applying micro-batches to the stored catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.derive import ascii_lower, derive
from ..operators import changes as C
from ..operators.catalog import Store
from ..operators.content import DISK_BUDGET, eligible
from ..operators.tree import folder_sizes, last_writer, resized, volume_of
from ..schema import ENTRY, EPOCH, PENDING
from ..shared import cut

PAIRED = "file_ref long, old_path string, new_path string, seq long"


def pair_renames(changes: DataFrame, timeout: str = "1 day") -> DataFrame:
    """(file_ref, old_path, new_path, seq): an old name waits for the new one of its file; what waits longer than timeout is forgotten.

    Time is that of the events (a watermark), so runs over what is available now come to an end. A RENAME_NEW without an old name comes out with a null old_path, to be put in like a new file.
    """
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get[0] if state.exists else None
        rows = []
        events = pd.concat(list(frames)).sort_values("seq")
        for e in events.itertuples():
            if e.reason == "RENAME":
                old = e.path
            elif e.reason == "RENAME_NEW":
                rows.append((key[0], old, e.path, e.seq))
                old = None
            else:  # deleted: the old name is forgotten
                old = None
        if old is None:
            if state.exists:
                state.remove()
        else:
            state.update((old,))
            state.setTimeoutTimestamp(max(int(events.ms.max()) + millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["file_ref", "old_path", "new_path", "seq"])

    micros = F.floor((F.col("timestamp") - EPOCH) / 10).cast("long")
    renames = changes.where(F.col("reason").isin("RENAME", "RENAME_NEW", "DELETE"))
    renames = renames.select("file_ref", "seq", "reason", "path", F.floor(micros / 1000).cast("long").alias("ms"), F.timestamp_micros(micros).alias("event_ts"))
    renames = renames.withWatermark("event_ts", timeout)
    return renames.groupBy("file_ref").applyInPandasWithState(step, PAIRED, "old_path string", "append", GroupStateTimeout.EventTimeTimeout)


def apply_to_catalog(
    changes: DataFrame, store: Store, look_up: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "feed",
    bodies: Callable[[DataFrame], DataFrame] | None = None, rescan: Callable[[str], DataFrame] | None = None, content_budget: int = DISK_BUDGET, **trigger,
) -> StreamingQuery:
    """Applies each micro-batch of changes(seq, reason, path, is_dir, file_ref) to the store: files, contents and old names that wait.

    look_up(paths) gives present rows of changed paths, bodies(files) the content rows of text files that changed, rescan(volume) all
    rows of a volume whose journal has lost events (reason OVERFLOW, the volume as path); these are read after the other events, so
    nothing is missed. Only volumes that a batch touches are rewritten. The batch number is published with all tables at once, so a
    batch that is run again after a failure changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        if store.manifest().batches.get(name, -1) >= number:
            return
        lost = [r[0] for r in df.where("reason = 'OVERFLOW'").select("path").distinct().collect()]  # volumes
        events = cut(df.where("reason <> 'OVERFLOW'").select("seq", "reason", "path", "is_dir", "file_ref"), "events")
        base = store.read("pending")
        old = C.split_changes(_touched(store, events, base), events, lambda paths: look_up(paths).select(*ENTRY.names), base)
        volumes = sorted({r[0] for r in old.after().select("volume").union(old.gone.select("volume")).distinct().collect()} | set(lost), key=str)
        files = resized(old.kept, old.gone, old.added)
        for v in lost:
            if rescan is not None:
                again = last_writer(rescan(v).select(*ENTRY.names), "path", "modified")
                files = files.where(F.col("volume") != v).unionByName(folder_sizes(again))
        waiting = events.where("is_dir").select(*PENDING.names, "reason").unionByName(base.withColumn("reason", F.lit("RENAME")))
        tables = {"files": derive(files), "pending": C.waiting(waiting.withColumn("is_dir", F.lit(True)))}
        if bodies is not None:
            tables["contents"] = refreshed(store, old, bodies, content_budget)
        store.publish({k: cut(v, k) for k, v in tables.items()}, (name, number), [v or "" for v in volumes])

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _touched(store: Store, events: DataFrame, pending: DataFrame) -> DataFrame:
    """The files of the volumes that events name, by the longest volume that a path is under."""
    known = store.volumes()
    named = {r[0] for r in events.select("path").union(pending.select("path")).select(volume_of(F.col("path"), known).alias("v")).distinct().collect()}
    return store.read("files", [v for v in known if v in named]).select(*ENTRY.names)


def refreshed(store: Store, applied: C.Applied, bodies: Callable[[DataFrame], DataFrame], budget: int = DISK_BUDGET) -> DataFrame:
    """The content table after a batch: dropped with deletes and old names, moved along with directories, read again on writes."""
    key = lambda c: ascii_lower(F.col(c))
    contents = store.read("contents")
    moves = applied.moves.select(key("path").alias("path_key"), key("to").alias("__to"))
    moved = contents.join(moves.where("__to is not null"), "path_key").withColumn("path_key", F.col("__to")).select(*contents.columns)
    new = bodies(applied.added.join(applied.events.select("path"), "path", "left_semi").where(eligible(F.col("path"), F.col("size"), F.col("is_dir"))))
    new = new.select(*contents.columns).unionByName(moved.join(applied.events.select(key("path").alias("path_key")), "path_key", "left_anti"))
    gone = applied.events.select(key("path").alias("path_key")).union(moves.select("path_key"))
    return store.with_content(new, budget, drop=gone.distinct())


def begin(store: Store, live: DataFrame, scan: Callable[[], DataFrame], save: bool = True) -> DataFrame:
    """(volume, journal_id, cursor) to read the journals from. live: where they end now, taken before anything is scanned.

    If the saved checkpoints can be resumed they are the answer. Otherwise everything is scanned, and reading begins where the journals
    ended before the scan: what changed during it is applied once more.
    """
    live = cut(live, "tails")
    if store.can_resume(live):
        return store.read("checkpoints")
    store.replace(scan())
    if save:
        store.save_checkpoints(live)
    return live


def to_journal(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the stream to a JSON-lines journal, exactly once."""
    return changes.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_rates(changes: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Extension: counts by event-time window and category, with a watermark for late events."""
    ts = F.timestamp_micros(F.floor((F.col("timestamp") - EPOCH) / 10).cast("long"))
    windowed = changes.withColumn("event_ts", ts).withWatermark("event_ts", late)
    return windowed.groupBy(F.window("event_ts", f"{seconds} seconds").alias("w"), C.category(F.col("reason")).alias("category")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")
