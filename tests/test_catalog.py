import json
import pathlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from pathquarry.api import Catalog, Settings
from pathquarry.functions import derive as D
from pathquarry.operators import changes as C
from pathquarry.operators import content as T
from pathquarry.operators import tree as R
from pathquarry.operators.catalog import Store
from pathquarry.schema import CONTENT, ENTRY, PENDING
from pathquarry.sources import filesystem, journal, replay
from pathquarry.streaming import feed


def entries(spark, *rows):
    return spark.createDataFrame([(p, s, 1, 1, 1, d, 0, i, "/") for i, (p, s, d) in enumerate(rows)], ENTRY)


def sizes(df):
    return {r.path: r.size for r in df.collect()}


TREE = [("/r", 0, True), ("/r/a", 0, True), ("/r/a/b", 0, True), ("/r/a/b/f", 20, False), ("/r/a/g", 30, False), ("/r/ab", 1, False)]


def test_sizes_and_prefixes(spark):
    t = R.folder_sizes(entries(spark, *TREE))
    assert sizes(t) == {"/r": 51, "/r/a": 50, "/r/a/b": 20, "/r/a/b/f": 20, "/r/a/g": 30, "/r/ab": 1}
    assert set(sizes(R.remove_prefix(t, "/r/a"))) == {"/r", "/r/ab"}
    moved = R.rename_prefix(D.derive(t), "/r/a", "/r/new")
    assert set(sizes(moved)) == {"/r", "/r/new", "/r/new/b", "/r/new/b/f", "/r/new/g", "/r/ab"} and moved.where("lower_name = 'new'").count() == 1
    after = entries(spark, *[r for r in TREE if r[0] != "/r/a/g"], ("/r/a/b/n", 5, False))
    assert {r.path: r.delta for r in R.size_deltas(t, after).collect()} == {"/r": -25, "/r/a": -25, "/r/a/b": 5}
    assert sizes(R.apply_deltas(t.where("is_dir"), R.size_deltas(t, after)))["/r/a"] == 25


def test_resolve_paths(spark):
    rows = [(10, 5, "a"), (11, 10, "b"), (12, 11, "c"), (13, 99, "orphan"), (14, 15, "x"), (15, 14, "y"), (16, 14, "below a cycle"), (17, 17, "itself"), (5, 5, "root")] + [(100 + i, 99 + i if i else 12, f"d{i}") for i in range(20)]
    got = {r.file_ref: r.path for r in R.resolve_paths(spark.createDataFrame(rows, "file_ref long, parent_ref long, own_name string"), "C:").collect()}
    assert got[12] == r"C:\a\b\c" and {got[k] for k in (13, 14, 15, 16, 17)} == {""} and got[119] == r"C:\a\b\c" + "".join(rf"\d{i}" for i in range(20))


def test_mounts_and_parents(spark):
    mounts = spark.createDataFrame([("/",), ("/home",)], "mount string")
    paths = spark.createDataFrame([("/home/user/x",), ("/home",), ("/etc/passwd",), ("foo",), ("/homer",)], "path string")
    assert {r.path: r.volume for r in R.mount_of(paths, mounts).collect()} == {"/home/user/x": "/home", "/home": "/home", "/etc/passwd": "/", "foo": "foo", "/homer": "/"}
    p = spark.createDataFrame([("/",), ("/a",), ("/a/b",), ("C:\\",), (r"C:\x",), (r"C:\x\y",), ("n",)], "path string")
    assert [r[0] for r in p.select(D.parent(F.col("path"))).collect()] == [None, "/", "/a", None, "C:\\", r"C:\x", None]


def test_scalar_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(D.attribute_letters(F.lit(x))) for x in (0x20, 1, 0x21, 0)] == ["A", "R", "AR", "-"]
    assert [one(D.iso(F.lit(x).cast("long"))) for x in (0, 1000, 116444736000000000)] == [None, None, "1970-01-01T00:00:00Z"]
    assert one(D.from_unix(F.lit(1577836800))) == 132223104000000000 and one(D.name_length(F.lit("CAFÉ.RS"))) == 8 and one(D.ascii_lower(F.lit("CAFÉ"))) == "cafÉ"
    assert filesystem.filetime(0) == 0 and D.trim_separators("/") == "/" and D.is_absolute("C:/") and not D.is_absolute("C:")


def test_content(spark):
    body = spark.createDataFrame([("/a", "Hello World"), ("/b", "alpha gamma"), ("/c", "alpha"), ("/d", None)], "path_key string, body string")
    found = lambda *n: sorted(r[0] for r in T.matching(body, n).collect())
    assert found("hello") == ["/a"] and found("alpha", "GAMMA") == ["/b"] and found("") == [] and found("missing") == []
    e = entries(spark, ("/a.md", 5, False), ("/Makefile", 5, False), ("/x.exe", 5, False), ("/b.md", 0, False), ("/node_modules/a.md", 5, False), ("/c.md", 1 << 20, False))
    assert {r[0] for r in e.where(T.eligible(F.col("path"), F.col("size"), F.col("is_dir"))).select("path").collect()} == {"/a.md", "/Makefile"}


def test_changes(spark):
    rows = [(1, 300, "CREATE", "/a"), (2, 100, "WRITE", "/b"), (3, 200, "RENAME", "/c"), (4, 200, "RENAME_NEW", "/d"), (5, 50, "DELETE", "/e")]
    feed_rows = spark.createDataFrame([(*r, False, 7) for r in rows], "seq long, timestamp long, reason string, path string, is_dir boolean, file_ref long")
    got = lambda *a: [r.seq for r in C.recent(feed_rows, *a).collect()]
    assert got() == [5, 4, 3, 2, 1] and got(100) == [4, 3, 1] and got(0, 2) == [5, 4]
    assert got(0, 0, "created,modified") == [2, 1] and got(0, 0, "DELETED") == [5] and got(0, 0, "renamed") == [4, 3] and got(0, 0, " ") == [5, 4, 3, 2, 1]
    assert [(r.old_path, r.new_path) for r in C.pair_renames(feed_rows).collect()] == [("/c", "/d")]
    assert C.since_hours(2, 1000) == 116444736000000000 + 1000 * 10**7 - 72 * 10**9 and C.since_hours(2, 1000, 5) == 5


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    store.replace(entries(spark, *TREE))
    store.upsert(entries(spark, ("/r/a/b/f", 25, False)))
    assert sizes(store.read())["/r"] == 56
    store.write("files", store.read().limit(1), ("feed", 3))
    store.write("files", store.read().limit(0), ("feed", 3))  # the same batch again
    assert store.read().count() == 1
    (tmp_path / "s" / "manifest" / "000000000099.json").write_text("{broken")
    assert store.manifest().number == 3 and store.status().first().entries == 1 and store.compact(1) >= 2
    assert store.read().count() == 1 and store.volumes() == ["/"]
    (tmp_path / "s" / "manifest" / "000000000100.json").write_text(json.dumps({"number": 100, "schema_version": 99}))
    try:
        store.manifest()
        raise AssertionError
    except ValueError:
        pass


def test_replace_keeps_the_latest_row(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("/f", k, 1, m, 1, False, 0, 1, "/") for k, m in ((1, 5), (2, 49), (3, 10), (4, 49))], ENTRY)
    store.replace(rows.repartition(3))
    assert [r.size for r in store.read().collect()] == [4]


def test_only_touched_volumes_are_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"{v}/f{i}", i, 1, 1, 1, False, 0, i, v) for v in ("/a", "/b") for i in range(3)] + [(v, 0, 1, 1, 1, True, 16, 9, v) for v in ("/a", "/b")], ENTRY)
    store.replace(rows)
    before = store.manifest().tables["files"]
    store.upsert(spark.createDataFrame([("/a/f1", 10, 1, 2, 1, False, 0, 1, "/a")], ENTRY))
    after = store.manifest().tables["files"]
    assert before["/b"] == after["/b"] and before["/a"] != after["/a"] and sizes(store.read())["/a"] == 12 and store.read().count() == 8
    store.replace_volume("/b", spark.createDataFrame([("/b/x", 1, 1, 1, 1, False, 0, 1, "/b")], ENTRY))
    assert store.manifest().tables["files"]["/a"] == after["/a"] and set(sizes(store.read("files", ["/b"]))) == {"/b/x"}


def test_budget(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(f"/{k}", s) for k, s in r], "path string, size long")
    took = lambda *a, **k: [(r.path, r.size) for r in T.within_budget(*a, **k).orderBy("path").collect()]
    assert took(rows(("a", 5), ("b", 100), ("c", 3)), 20) == [("/a", 5), ("/c", 3)]
    assert took(rows(("a", 5), ("b", 100), ("c", 3)), 20, memory=True) == [("/a", 5), ("/b", 15)]
    assert took(rows(("a", 5)), 0) == [] == took(rows(("a", 5)).limit(0), 9) and took(rows(("a", 5)), -3, memory=True) == []
    rng = random.Random(2)
    for budget in (50, 333, 1000):
        some = [(f"{k:04}", rng.choice([0, 1, 7, 30, 90, 400])) for k in range(120)]
        used, want = 0, []
        for k, s in some:
            if used + s <= budget:
                used += s
                want.append((f"/{k}", s))
        assert took(rows(*some).repartition(5), budget) == want
    store = Store(spark, str(tmp_path / "s"))
    body = lambda **b: spark.createDataFrame([(k, v, len(v), 0, 0) for k, v in b.items()], CONTENT)
    have = lambda: {r.path_key: r.body for r in store.read("contents").collect()}
    store.insert_content(body(m="12345", z="123"), 10)
    store.insert_content(body(a="123", b="12", m="1", z=""), 10)  # m shrinks first, empty bodies are none, a stored row stays
    assert have() == {"m": "1", "z": "123", "a": "123", "b": "12"}
    store.insert_content(body(m="12345678"), 10)
    assert have()["m"] == "1"
    store.insert_content(body(n="héllo"), 11, memory=True)
    assert have()["n"].startswith("h") and len(have()["n"]) == 2


def test_settings(spark, tmp_path):
    s = Settings.from_env({"PATHQUARRY_ROOT": str(tmp_path / "s"), "PATHQUARRY_CONTENT": "Memory", "PATHQUARRY_CONTENT_BUDGET": "4"})
    store = s.store(spark)
    s.insert_content(store, spark.createDataFrame([("a", "123", 3, 0, 0), ("b", "456", 3, 0, 0)], CONTENT))
    assert {r.path_key: r.body for r in store.read("contents").collect()} == {"a": "123", "b": "4"}
    off = Settings.from_env({"PATHQUARRY_CONTENT": "off", "PATHQUARRY_CONTENT_BUDGET": "x"})
    off.insert_content(store, store.read("contents").limit(0))
    assert off.content_budget == T.DISK_BUDGET and Settings.from_env({"PATHQUARRY_CONTENT": "memory"}).content_budget == T.MEMORY_BUDGET
    for wrong in (lambda: Settings.from_env({"PATHQUARRY_CONTENT": "tape"}), lambda: off.store(spark)):
        with pytest.raises(ValueError):
            wrong()


def test_quarantine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace(spark.createDataFrame([("/a/f", 1, 1, 1, 1, False, 0, 1, "/a"), ("/b/f", 1, 1, 1, 1, False, 0, 2, "/b")], ENTRY))
    assert store.quarantine() == []
    for f in pathlib.Path(store.manifest().tables["files"]["/a"]).glob("*.parquet"):
        f.write_bytes(b"damaged")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(store.manifest().tables["files"]["/b"])
    assert sorted(store.quarantine()) == [("files", "/a"), ("files", "/b")]
    assert store.read().count() == 0 and len(list((tmp_path / "s").glob("damaged-files-*"))) == 1


def test_checkpoints(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    live = lambda j, c: spark.createDataFrame([("C:", j, c)], "volume string, journal_id long, cursor long")
    assert not store.can_resume(live(1, 10))
    store.save_checkpoints(live(1, 10))
    assert store.can_resume(live(1, 11)) and not store.can_resume(live(2, 11)) and not store.can_resume(live(1, 9))


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = spark.createDataFrame([(i, "WRITE", f"/{i}", False) for i in range(5)], "timestamp long, reason string, path string, is_dir boolean")
    journal.append(rows, path)
    (tmp_path / "j" / "bad.json").write_text('{"timestamp": 9, "reason"\nnot json\n{"timestamp": 7, "reason": "DELETE", "path": "/x", "is_dir": false}\n')
    assert {r.timestamp for r in journal.read(spark, path).collect()} == {0, 1, 2, 3, 4, 7} and [r.timestamp for r in journal.read(spark, path, 2).collect()] == [4, 3]
    journal.append(rows.where("timestamp < 2"), path)  # arrives last, whatever its time
    assert [(r.seq, r.timestamp) for r in journal.read(spark, path, 3).collect()] == [(6, 1), (5, 0), (4, 4)]


def test_filesystem(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f.txt").write_text("12345")
    (tmp_path / ".hidden").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    got = {r.path[len(str(tmp_path)) :]: r for r in filesystem.scan(spark, str(tmp_path), "/does/not/exist").collect()}
    assert set(got) == {"", "/d", "/d/e", "/d/e/f.txt", "/.hidden"}, set(got)
    assert got["/d/e/f.txt"].size == 5 and got["/.hidden"].attributes & 2 and got["/d"].is_dir
    assert T.read_bodies(spark, [str(tmp_path / "d" / "e" / "f.txt")]).first().body == "12345"


def test_api(spark):
    c = Catalog(D.derive(entries(spark, *TREE)))
    assert c.ping() == "pong" and c.count("file:") == 3 and c.find("g", fields="filename").columns == ["filename"] and "node_modules" in c.note()
    assert c.status().first().entries == 6 and c.aggregate("").first().total == 6 and c.recent_changes().count() == 0


def apply(spark, tree, events, present=(), pending=()):
    """Sizes by path after a batch of (reason, path, is_dir, file_ref)."""
    files = R.folder_sizes(entries(spark, *tree))
    changes = spark.createDataFrame([(k + 10, 1, r, p, d, ref) for k, (r, p, d, ref) in enumerate(events)], CHANGES)
    pending = spark.createDataFrame(list(pending), PENDING)
    done = C.split_changes(files, changes, entries(spark, *present), pending)
    return sizes(R.resized(done.kept, done.gone, done.added))


def test_directory_events(spark):
    assert apply(spark, TREE, [("DELETE", "/r/a", True, 1)]) == {"/r": 1, "/r/ab": 1}
    assert apply(spark, TREE, [("DELETE", "/r/a/b/f", False, 1)]) == {"/r": 31, "/r/a": 30, "/r/a/b": 0, "/r/a/g": 30, "/r/ab": 1}
    new = [("/r/n", 0, True)]
    moved = {"/r": 51, "/r/n": 50, "/r/n/b": 20, "/r/n/b/f": 20, "/r/n/g": 30, "/r/ab": 1}
    assert apply(spark, TREE, [("RENAME", "/r/a", True, 1), ("RENAME_NEW", "/r/n", True, 1)], new) == moved
    assert apply(spark, TREE, [("RENAME_NEW", "/r/n", True, 1)], new, [(1, "/r/a", 3)]) == moved  # the old name came a batch before
    assert apply(spark, TREE, [("RENAME", "/r/a", True, 1)]) == sizes(R.folder_sizes(entries(spark, *TREE)))  # and its new one hasn't come
    # Events before and after a move, at the paths of their time; a file moved out; a name taken over.
    events = [("WRITE", "/r/a/g", False, 4), ("RENAME", "/r/a", True, 1), ("RENAME_NEW", "/r/n", True, 1), ("DELETE", "/r/n/b/f", False, 3), ("CREATE", "/r/a", False, 77)]
    assert apply(spark, TREE, events, [*new, ("/r/n/g", 40, False), ("/r/a", 5, False)]) == {"/r": 46, "/r/n": 40, "/r/n/b": 0, "/r/n/g": 40, "/r/ab": 1, "/r/a": 5}
    events = [("RENAME", "/r/a/g", False, 4), ("RENAME_NEW", "/r/g", False, 4), ("RENAME", "/r/a", True, 1), ("RENAME_NEW", "/r/z", True, 1), ("DELETE", "/r/z", True, 1)]
    assert apply(spark, TREE, events, [("/r/g", 30, False)]) == {"/r": 31, "/r/ab": 1, "/r/g": 30}
    # A deletion forgets an old name; what is gone when it is looked at isn't put in.
    events = [("RENAME", "/r/a", True, 1), ("DELETE", "/r/a", True, 1), ("RENAME_NEW", "/r/q", True, 1), ("WRITE", "/r/none", False, 8)]
    assert apply(spark, TREE, events, [("/r/q", 0, True)]) == {"/r": 1, "/r/ab": 1, "/r/q": 0}
    swap = [("RENAME", "/r/a", True, 1), ("RENAME_NEW", "/r/t", True, 1), ("RENAME", "/r/c", True, 2), ("RENAME_NEW", "/r/a", True, 2), ("RENAME", "/r/t", True, 1), ("RENAME_NEW", "/r/c", True, 1)]
    tree = [("/r", 0, True), ("/r/a", 0, True), ("/r/a/x", 1, False), ("/r/c", 0, True), ("/r/c/y", 2, False)]
    assert apply(spark, tree, swap, [("/r/a", 0, True), ("/r/c", 0, True)]) == {"/r": 3, "/r/a": 2, "/r/a/y": 2, "/r/c": 1, "/r/c/x": 1}


def test_stream_over_two_batches_with_content(spark, tmp_path):
    """A directory's old name in one batch and its new one in the next; texts go with it, are read again on writes and dropped on deletes."""
    store = Store(spark, str(tmp_path / "s"))
    tree = [("/r", 0, True), ("/r/a", 0, True), ("/r/a/one.md", 3, False), ("/r/a/two.md", 4, False), ("/r/x.md", 5, False)]
    store.replace(entries(spark, *tree))
    store.insert_content(spark.createDataFrame([(p, "old", 3, 0, 0) for p, _, d in tree if not d], CONTENT))
    present = entries(spark, ("/r/b", 0, True), ("/r/b/two.md", 6, False))
    read = lambda files: files.select(F.col("path").alias("path_key"), F.lit("new!").alias("body"), F.lit(4).cast("long").alias("byte_count"), F.lit(0).cast("long").alias("indexed_at"), F.lit(0).cast("long").alias("source_modified"))
    source = tmp_path / "in"

    def run(*events):
        spark.createDataFrame([(s, 1, r, p, d, ref) for s, r, p, d, ref in events], CHANGES).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(CHANGES).json(str(source))
        feed.apply_to_catalog(stream, store, lambda paths: present.join(paths, "path", "left_semi"), str(tmp_path / "cp"), bodies=read).awaitTermination()
        return {r.path_key: r.body for r in store.read("contents").collect()}

    run((1, "RENAME", "/r/a", True, 1))
    assert set(sizes(store.read())) == {p for p, _, _ in tree} and store.read("pending").count() == 1
    body = run((2, "RENAME_NEW", "/r/b", True, 1), (3, "WRITE", "/r/b/two.md", False, 3), (4, "DELETE", "/r/x.md", False, 4))
    assert sizes(store.read()) == {"/r": 9, "/r/b": 9, "/r/b/one.md": 3, "/r/b/two.md": 6} and store.read("pending").count() == 0
    assert body == {"/r/b/one.md": "old", "/r/b/two.md": "new!"}


def test_replay(spark, tmp_path):
    path = str(tmp_path / "j")
    events = [{"timestamp": k, "reason": "WRITE", "path": f"/{k}", "is_dir": False, "file_ref": k} for k in range(10)]
    assert [replay.write_segment(path, events[:4]), replay.write_segment(path, events[4:])] == [4, 10] and replay.tail(path) == 10
    with open(tmp_path / "j" / f"{10:020d}.jsonl", "w") as f:
        f.write('not json\n{"path": 5}\n{"timestamp": 1, "reason": "DELETE", "path": "/12"}\n{"half a li')
    out, n = [], 0

    def run(cursor):
        nonlocal n
        n += 1
        stream = replay.stream(spark, path, "/vol", cursor)
        stream.writeStream.format("json").option("path", str(tmp_path / f"o{n}")).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.seq, r.reason, r.path) for r in spark.read.schema(stream.schema).json(str(tmp_path / f"o{n}")).collect())

    assert run(2) == [(k, "WRITE", f"/{k}") for k in range(2, 10)] + [(12, "DELETE", "/12")]
    pathlib.Path(replay.segments(path)[0][1]).unlink()
    assert run(2) == [(2, "OVERFLOW", "/vol")] + [(k, "WRITE", f"/{k}") for k in range(4, 10)] + [(12, "DELETE", "/12")]
    assert run(4)[0] == (4, "WRITE", "/4") and out == []


CHANGES = "seq long, timestamp long, reason string, path string, is_dir boolean, file_ref long"


def test_rename_stream(spark, tmp_path):
    out, source = str(tmp_path / "out"), tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").json(str(source))

    def run():
        stream = feed.pair_renames(spark.readStream.schema(CHANGES).json(str(source)))
        stream.writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.old_path or "", r.new_path) for r in spark.read.schema(feed.PAIRED).json(out).collect())

    at = lambda k: 116444736000000000 + (1_706_616_000 + k) * 10**7
    write([(1, at(1), "RENAME", "/old", False, 7), (2, at(2), "RENAME_NEW", "/lonely", False, 8)])
    assert run() == [("", "/lonely")]
    write([(3, at(3), "RENAME_NEW", "/new", False, 7)])
    assert run() == [("", "/lonely"), ("/old", "/new")] == run()


def test_catalog_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace(entries(spark, *TREE))
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "WRITE", "/r/a/g", False, 1), (2, 2, "DELETE", "/r/ab", False, 2), (3, 3, "CREATE", "/r/z", False, 3)], CHANGES).coalesce(1).write.json(str(source))
    present = entries(spark, ("/r/a/g", 40, False), ("/r/z", 2, False))
    for _ in range(2):
        q = feed.apply_to_catalog(spark.readStream.schema(CHANGES).json(str(source)), store, lambda paths: present.join(paths, "path", "left_semi"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sizes(store.read()) == {"/r": 62, "/r/a": 60, "/r/a/b": 20, "/r/a/b/f": 20, "/r/a/g": 40, "/r/z": 2}
