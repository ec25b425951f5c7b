"""Bucketed snapshots: batches against full rebuilds, files left alone, point lookups, the stream."""

import os
import random

import pytest

from noteframe.operators import stats as A
from noteframe.operators.links import resolve_links
from noteframe.operators.parse import parse_notes
from noteframe.sources import buckets
from noteframe.sources.files import read_notes, stream_notes
from noteframe.streaming.changes import stream_buckets

RAW = "path string, raw string, mtime timestamp, length long"
NAMES = [f"n{k}" for k in range(12)]


def raw(spark, notes, minute=0):
    import datetime

    at = datetime.datetime(2024, 1, 1, 0, minute)
    return spark.createDataFrame([(p, t, at, len(t)) for p, t in notes.items()], RAW)


def text(rng):
    links = " ".join(f"[[{rng.choice(NAMES + ['dir/n3', 'N5', 'gone'])}]]" for _ in range(rng.randint(0, 4)))
    return f"# {rng.choice(NAMES)}\n{links} #tag{rng.randint(0, 3)}\n- [ ] task\n"


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def same_as_rebuild(spark, store, notes):
    parsed = parse_notes(raw(spark, notes))
    assert rows(store.notes, "path", "title", "body") == rows(parsed, "path", "title", "body")
    assert rows(store.links, "src", "target", "dst") == rows(resolve_links(parsed), "src", "target", "dst")
    for name, make in buckets.PER_NOTE.items():
        want = make(parsed)
        assert rows(store.table(name), *want.columns) == rows(want, *want.columns)
    same_counts(store, parsed)


def same_counts(store, parsed):
    links = resolve_links(parsed)
    pairs = [
        (A.held_stats(store), A.corpus_stats(parsed, links)),
        (A.held_top_tags(store, 3), A.top_tags(parsed, 3)),
        (A.held_folder_counts(store), A.folder_counts(parsed)),
        (A.held_most_linked(store, 6), A.most_linked(parsed, links, 6)),
    ]
    for held, counted in pairs:
        assert held.columns == counted.columns and [f.dataType for f in held.schema] == [f.dataType for f in counted.schema]
        assert rows(held, *held.columns) == rows(counted, *held.columns)
    for held, _ in pairs[:3]:
        assert not any("/notes/" in f or "/links/" in f for f in held.inputFiles())


def files_of(store):
    return {(name, b): v for name, held in store.state["tables"].items() for b, v in held.items()}


def test_random_batches_equal_full_rebuilds(spark, tmp_path):
    rng = random.Random(5)
    notes = {f"{rng.choice(['', 'dir/'])}{n}.md": text(rng) for n in NAMES}
    store = buckets.create(spark, str(tmp_path / "s"), parse_notes(raw(spark, notes)), count=16)
    same_as_rebuild(spark, store, notes)
    for turn in range(2):
        gone = rng.sample(sorted(notes), 2)
        changed = {rng.choice(["", "dir/"]) + rng.choice(NAMES) + ".md": text(rng) for _ in range(2)}
        changed = {p: t for p, t in changed.items() if p not in gone}
        removed = spark.createDataFrame([(p,) for p in gone] + [("never.md",)], "path string")
        before = files_of(store)
        store = buckets.apply_batch(store, raw(spark, changed, turn + 1), removed)
        notes = {p: t for p, t in notes.items() if p not in gone} | changed
        same_as_rebuild(spark, store, notes)
        touched = store.buckets(spark.createDataFrame([(p,) for p in [*gone, *changed, "never.md"]], "path string"))
        for (name, bucket), version in files_of(store).items():
            if name not in ("links", "degrees") and int(bucket) not in touched:
                assert before[name, bucket] == version
    again = buckets.load(spark, str(tmp_path / "s"))
    assert again.state == store.state


def test_of_two_batches_on_one_version_one_is_refused(spark, tmp_path):
    store = buckets.create(spark, str(tmp_path / "s"), parse_notes(raw(spark, {"a.md": "# A\n"})), count=2)
    after = buckets.apply_batch(store, raw(spark, {"b.md": "# B\n"}))
    with pytest.raises(ValueError):
        buckets.apply_batch(store, raw(spark, {"c.md": "# C\n"}))
    assert buckets.load(spark, str(tmp_path / "s")).state == after.state
    assert rows(after.notes, "path") == [("a.md",), ("b.md",)]


def test_a_name_that_moves_changes_links_elsewhere_only_where_it_must(spark, tmp_path):
    notes = {f"a{k}.md": f"# A{k}\n[[Target]] [[a{(k + 1) % 30}]]\n" if k < 3 else f"# A{k}\n[[a{(k + 1) % 30}]]\n" for k in range(30)}
    store = buckets.create(spark, str(tmp_path / "s"), parse_notes(raw(spark, notes)), count=64)
    before = files_of(store)
    notes["z.md"] = "# Target\n"
    store = buckets.apply_batch(store, raw(spark, {"z.md": notes["z.md"]}))
    same_as_rebuild(spark, store, notes)
    linking = store.buckets(spark.createDataFrame([("a0.md",), ("a1.md",), ("a2.md",), ("z.md",)], "path string"))
    moved = {int(b) for (name, b), v in files_of(store).items() if before.get((name, b)) != v}
    assert moved <= linking
    assert buckets.apply_batch(store, raw(spark, {})).state == store.state
    found = store.lookup(spark.createDataFrame([("a7.md",), ("none.md",)], "path string"))
    assert [r.path for r in found.collect()] == ["a7.md"]
    assert len(store.table("notes", {0}).inputFiles()) <= 1


def test_stream_leaves_other_buckets_alone(spark, tmp_path):
    folder, root = tmp_path / "notes", str(tmp_path / "s")
    folder.mkdir()
    for k in range(20):
        (folder / f"m{k}.md").write_text(f"# M{k}\n[[m{(k + 1) % 20}]] [[late]]\n" if k == 4 else f"# M{k}\n[[m{(k + 1) % 20}]]\n")

    def run():
        listing = lambda s: read_notes(s, str(folder))
        stream_buckets(stream_notes(spark, str(folder)), root, str(tmp_path / "c"), listing=listing).awaitTermination()
        return buckets.load(spark, root)

    first = run()
    before = {f: os.path.getmtime(f) for f in _parquet(root)}
    (folder / "late.md").write_text("# Late\n")
    (folder / "m9.md").unlink()
    second = run()
    now = {p.name: p.read_text() for p in folder.iterdir() if p.suffix == ".md"}
    assert set(now) == {r.path for r in second.notes.select("path").collect()}
    same_as_rebuild(spark, second, now)
    assert {f: os.path.getmtime(f) for f in before} == before
    kept = sum(files_of(first).get(k) == v for k, v in files_of(second).items())
    assert kept > len(files_of(second)) / 2


def _parquet(root):
    return [os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")]


@pytest.mark.parametrize("count", [1, 7])
def test_from_nothing_and_to_nothing(spark, tmp_path, count):
    store = buckets.create(spark, str(tmp_path / "s"), parse_notes(raw(spark, {})), count=count)
    assert store.notes.collect() == [] and store.links.collect() == []
    store = buckets.apply_batch(store, raw(spark, {"x.md": "# X\n[[y]]\n", "y.md": "# Y\n[[X]]\n"}))
    same_as_rebuild(spark, store, {"x.md": "# X\n[[y]]\n", "y.md": "# Y\n[[X]]\n"})
    store = buckets.apply_batch(store, raw(spark, {}), spark.createDataFrame([("x.md",), ("y.md",)], "path string"))
    assert store.notes.collect() == [] and store.links.collect() == [] and store.titles.collect() == []


def test_a_batch_shuffles_its_own_rows_only(spark, tmp_path, monkeypatch):
    notes = {f"n{k}.md": f"# n{k}\n[[n0]] #t\n" for k in range(80)}
    store = buckets.create(spark, str(tmp_path / "s"), parse_notes(raw(spark, notes)), count=2)
    shuffled, kind = [], type(store.notes)
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: (shuffled.append(self.count()), repartition(self, *a))[1])
    changed = {"n1.md": "# n1\n[[n3]]\n", "new.md": "# new\n"}
    store = buckets.apply_batch(store, raw(spark, changed, 1))
    assert shuffled and max(shuffled) < 20
    monkeypatch.undo()
    same_as_rebuild(spark, store, notes | changed)
    # Files that have become many are gathered again.
    monkeypatch.setattr(buckets, "MANY_FILES", 0)
    store = buckets.apply_batch(store, raw(spark, changed, 2))
    assert len(store.notes.inputFiles()) <= 4  # one of the held rows and one of the batch for each bucket
    same_as_rebuild(spark, store, notes | changed)


def test_a_small_batch_writes_its_own_notes_only(spark, tmp_path, monkeypatch):
    notes = {f"n{k}.md": f"# n{k}\n[[n{k + 1}]] #t{k % 3}\n- [ ] do\n" for k in range(40)}
    store = buckets.create(spark, str(tmp_path / "s"), parse_notes(raw(spark, notes)), count=2)
    gone = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    held = {f for name in buckets.LAYERED for f in store.table(name).inputFiles()}
    for turn, (changed, removed) in enumerate([({"n1.md": "# n1\n[[n3]] #u\n", "new.md": "# N2\n"}, ["n2.md", "n4.md"]), ({"n2.md": "# back\n"}, ["new.md"])]):
        store = buckets.apply_batch(store, raw(spark, changed, turn + 1), gone(*removed))
        notes = {p: t for p, t in notes.items() if p not in removed} | changed
        written = spark.read.parquet(*[f"{tmp_path}/s/data/v={v}/notes" for v in {v for layers in store.state["layers"].values() for v in layers[-1:] if v.startswith(f"{turn + 2}-")}])
        assert {r.path for r in written.select("path").collect()} == set(changed)
        assert held <= {f for name in buckets.LAYERED for f in store.table(name).inputFiles()}
    same_as_rebuild(spark, store, notes)
    monkeypatch.setattr(buckets, "MANY_FILES", 1)  # two layers are many
    store = buckets.apply_batch(store, raw(spark, {"n5.md": "# five\n"}, 3), gone(*[f"n{k}.md" for k in range(6, 9)]))
    notes = {p: t for p, t in notes.items() if p not in ("n6.md", "n7.md", "n8.md")} | {"n5.md": "# five\n"}
    assert not any(store.state["layers"].values())
    same_as_rebuild(spark, store, notes)
