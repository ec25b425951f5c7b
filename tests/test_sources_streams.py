import os
import tempfile
import time

from pyspark.sql import functions as F

from noteframe import NoteTables
from noteframe.operators import incremental as I
from noteframe.operators.links import resolve_links
from noteframe.session import shared_dir
from noteframe.sources import audit, buckets, files, snapshots
from noteframe.streaming import changes


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def folder(prefix):
    return tempfile.mkdtemp(prefix=f"noteframe-{prefix}-")


def test_scan_skips_hidden_and_foreign_files(spark):
    root = folder("scan")
    for name in ("a.md", "in/b.MARKDOWN", "in/c.txt", "in/d.pdf", ".hid/e.md", "node_modules/f.md", "in/.git/g.md", "é ü.md"):
        write(root, name, f"# {name}\n")
    notes = files.read_notes(spark, root)
    assert {r.path for r in notes.collect()} == {"a.md", "in/b.MARKDOWN", "in/c.txt", "é ü.md"}
    assert {r.path for r in files.list_folder(notes, "in").collect()} == {"in/b.MARKDOWN", "in/c.txt"}
    assert {r.path for r in files.list_folder(notes, "").collect()} == {"a.md", "é ü.md"}
    asked = spark.createDataFrame([("a.md",), ("zz.md",)], "path string")
    assert {r.path: r.exists for r in files.note_exists(notes, asked).collect()} == {"a.md": True, "zz.md": False}


def test_snapshot_round_trip_and_versions(spark, garden_raw):
    root = folder("snap")
    assert snapshots.load_snapshot(spark, root) is None
    tables = NoteTables.from_raw(garden_raw).save(spark, root)
    assert tables.notes.count() == 13 and tables.edges.count() == 5
    again = NoteTables.load(spark, root)
    assert {r.path for r in again.notes.collect()} == {r.path for r in tables.notes.collect()}
    assert snapshots.save_snapshot(spark, root, garden_raw.limit(0).transform(lambda d: tables.notes.limit(2)), resolve_links) == 2
    assert NoteTables.load(spark, root).notes.count() == 2
    # A data folder of another shape asks for a rebuild.
    spark.range(3).write.mode("overwrite").parquet(f"{root}/data/v=2/notes")
    assert snapshots.load_snapshot(spark, root) is None


def test_snapshot_prunes_by_top_folder(spark, garden_raw):
    from noteframe.operators.predicate import notes_by_folder

    tables = NoteTables.from_raw(garden_raw).save(spark, folder("prune"))
    people = notes_by_folder(tables.notes, "People/").select("path")
    plan = people._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(root" in plan and people.count() == 2


def test_audit_log(spark):
    location = folder("audit") + "/log"
    rows = spark.createDataFrame(
        [("2024-01-01 23:59:00", "auto", "x", "a.md", "d"), ("2024-01-02 00:01:00", "gated", "y", "b.md", None)],
        "ts string, tier string, operation string, path string, detail string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    audit.append_log(rows, location)
    audit.append_log(rows.where("tier = 'auto'"), location)
    log = audit.read_log(spark, location)
    assert audit.audit_for_date(log, "2024-01-01").count() == 2
    assert str(audit.audit_summary(log).first().last_log_date) == "2024-01-02"


def test_incremental_refresh_equals_full_parse(spark, garden_raw):
    old = NoteTables.from_raw(garden_raw).notes
    edited = garden_raw.where("path <> 'Meetings/lost.md'").withColumns(
        {
            "raw": F.when(F.col("path") == "People/bo.md", "# Bo the Second\n").otherwise(F.col("raw")),
            "mtime": F.when(F.col("path") == "People/bo.md", F.col("mtime") + F.expr("INTERVAL 5 SECONDS")).otherwise(F.col("mtime")),
        }
    )
    new = edited.unionByName(
        spark.createDataFrame([("fresh.md", "# Fresh\n[[Bo the Second]]", 1)], "path string, raw string, length long").withColumn(
            "mtime", F.lit("2024-06-02").cast("timestamp")
        )
    )
    diff = {r.path: r.change for r in I.incremental_diff(old, new.where("path <> 'broken.md'")).collect()}
    assert diff["Meetings/lost.md"] == "deleted" and diff["People/bo.md"] == "changed" and diff["fresh.md"] == "new"
    assert set(diff.values()) == {"deleted", "changed", "new", "same"}
    fresh = {(r.path, r.title) for r in I.refresh(old, new).collect()}
    full = NoteTables.from_raw(new)
    assert fresh == {(r.path, r.title) for r in full.notes.collect()}
    links = {(r.src, r.dst) for r in resolve_links(I.refresh(old, new)).collect()}
    assert ("fresh.md", "People/bo.md") in links and links == {(r.src, r.dst) for r in full.links.collect()}


def test_stream_refresh_equals_batch(spark):
    root, store, ckpt = folder("live"), folder("store"), folder("ckpt")
    write(root, "a.md", "# A\n[[Bee]]\n")
    write(root, ".hidden/x.md", "# X\n")
    run = lambda: changes.stream_refresh(files.stream_notes(spark, root), store, ckpt).awaitTermination(120)
    assert run()
    first = NoteTables.load(spark, store)
    assert [(r.path, r.title) for r in first.notes.collect()] == [("a.md", "A")]
    assert [r.dst for r in first.links.collect()] == [None]
    time.sleep(1.1)
    write(root, "b.md", "---\ntags: [t]\n---\n# Bee\n")
    assert run()
    second = NoteTables.load(spark, store)
    batch = NoteTables.from_raw(files.read_notes(spark, root))
    assert sorted((r.path, r.title, tuple(r.tags)) for r in second.notes.collect()) == sorted(
        (r.path, r.title, tuple(r.tags)) for r in batch.notes.collect()
    )
    # The older note's link resolves now that its target exists.
    assert [(r.src, r.dst) for r in second.links.collect()] == [("a.md", "b.md")]


def test_stream_refresh_drops_notes_without_a_file(spark):
    root, store, ckpt = folder("shrinking"), folder("store2"), folder("ckpt2")
    write(root, "a.md", "# A\n[[Bee]]\n")
    write(root, "b.md", "# Bee\n")
    listing = lambda s: files.read_notes(s, root).select("path")
    run = lambda: changes.stream_refresh(files.stream_notes(spark, root), store, ckpt, listing=listing).awaitTermination(120)
    assert run()
    assert {r.path for r in NoteTables.load(spark, store).notes.collect()} == {"a.md", "b.md"}
    os.remove(os.path.join(root, "b.md"))
    time.sleep(1.1)
    write(root, "c.md", "# Sea\n")
    assert run()
    after = NoteTables.load(spark, store)
    batch = NoteTables.from_raw(files.read_notes(spark, root))
    assert {r.path for r in after.notes.collect()} == {r.path for r in batch.notes.collect()} == {"a.md", "c.md"}
    assert [(r.src, r.dst) for r in after.links.collect()] == [("a.md", None)]


def test_other_files_are_not_opened(spark):
    root = folder("mixed")
    for name in ("a.MD", "b.markdown", "c.txt", "d.pdf", "md"):
        write(root, name, "# x\n")
    assert {r.path for r in files.read_notes(spark, root).collect()} == {"a.MD", "b.markdown", "c.txt"}


def test_apply_changes_replaces_and_removes(spark, garden, garden_raw):
    changed = spark.createDataFrame(
        [("People/bo.md", "# Early\n", 1, "2024-07-01"), ("People/bo.md", "# Late\n", 1, "2024-07-02")],
        "path string, raw string, length long, mtime string",
    ).withColumn("mtime", F.col("mtime").cast("timestamp"))
    gone = spark.createDataFrame([("plain.txt",)], "path string")
    after = {r.path: r.title for r in changes.apply_changes(garden.notes, changed, gone).collect()}
    assert after["People/bo.md"] == "Late" and "plain.txt" not in after and len(after) == 12


EVENTS = [
    ("a.md", "2024-01-01 00:00:00.000", "add"), ("a.md", "2024-01-01 00:00:00.200", "change"), ("a.md", "2024-01-01 00:00:00.450", "unlink"),
    ("a.md", "2024-01-01 00:00:01.000", "add"), ("b.md", "2024-01-01 00:00:00.100", "change"), (".git/x.md", "2024-01-01 00:00:00.100", "add"),
    ("end.md", "2024-01-01 02:00:00.000", "add"),
]


def test_debounce_batch_and_stream_agree(spark):
    df = spark.createDataFrame(EVENTS, "path string, ts string, event string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r.path, r.event) for r in changes.debounce(df).collect()}
    assert batch == {("a.md", "unlink"), ("a.md", "add"), ("b.md", "change"), ("end.md", "add")}
    source, out, ckpt = folder("events"), folder("out") + "/d", folder("ck")
    df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = (
        changes.debounce(stream).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", ckpt).option("path", out).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    # The last burst is still open: the watermark has not passed it.
    got = {(r.path, r.event) for r in spark.read.parquet(out).collect()}
    assert got == batch - {("end.md", "add")}
    latest = {r.path: r.event for r in changes.latest_state(df).collect()}
    assert latest["a.md"] == "add"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stored_notes_hold_their_body_once(spark, garden_raw, tmp_path):
    notes = NoteTables.from_raw(garden_raw).notes
    odd = notes.limit(3).withColumns({"path": F.concat(F.lit("odd/"), "path"), "raw": F.concat("raw", F.lit("é tail"))})
    bare = notes.limit(2).withColumns({"path": F.concat(F.lit("bare/"), "path"), "raw": F.lit(None).cast("string")})
    void = notes.limit(1).withColumns({"path": F.concat(F.lit("void/"), "path"), "body": F.lit(None).cast("string")})
    notes = notes.union(odd).union(bare).union(void)
    want = sorted(map(str, notes.select("path", "raw", "body").collect()))
    snapshots.save_snapshot(spark, str(tmp_path / "s"), notes, resolve_links)
    found = snapshots.load_snapshot(spark, str(tmp_path / "s"))[0]
    assert sorted(map(str, found.select("path", "raw", "body").collect())) == want
    store = buckets.create(spark, str(tmp_path / "b"), notes, count=2)
    assert sorted(map(str, store.notes.select("path", "raw", "body").collect())) == want
    for place in (f"{tmp_path}/s/data/v=1/notes", f"{tmp_path}/b/data/*/notes"):
        stored = spark.read.parquet(place)
        assert {r.path.split("/")[0] for r in stored.where("raw IS NOT NULL").select("path").collect()} == {"odd", "void"}
