"""Snapshots in buckets: a batch of changes rewrites the buckets it touches and leaves the files of all others.

Notes and the tables that follow from one note are dealt to buckets by a hash of the path; links lie with their source, counts
of notes, tags, folders and linking notes with the bucket they count. A
version holds only the buckets it wrote, and the pointer names for every table and bucket the versions to read, so a
reader sees a batch whole or not at all and an unfinished batch is never seen.

A batch that changes few of the notes in its buckets leaves the held rows of these where they lie as well: it adds a layer with its own
rows and the paths it touched, and rows of older layers with such a path are left out when read. A batch that changes many, or that finds
many layers, writes its buckets anew. Links are kept current by a rule of
differences: what is resolved again are the links of changed notes and those links elsewhere whose target is a path
that came or went, or a name whose dictionary entry is another note than before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from noteframe.config import DEFAULT, NoteConfig
from noteframe.operators import links as L
from noteframe.operators import parse as P
from noteframe.operators import stats as A
from noteframe.schemas import NOTE_LINKS, NOTES
from noteframe.session import cut
from noteframe.sources import snapshots

FORMAT = "buckets-3"
# Tables that follow from a single note; "names" are its entries of the title dictionary.
MANY_FILES = 16  # files per bucket beyond which a rewrite gathers them again, and layers beyond which there is one
LAYER_SHARE = 0.25  # of the notes in the touched buckets: batches of more paths write these buckets anew
PER_NOTE = {"names": L.note_names, "tags": P.note_tags, "tasks": P.note_tasks, "fields": P.note_fields}
LAYERED = {"notes", *PER_NOTE}
PATHS = "paths"  # the paths a layer touched
TOUCHED = StructType([StructField("path", StringType())])


@dataclass(frozen=True)
class BucketStore:
    """One version of a bucketed snapshot."""

    spark: SparkSession
    root: str
    state: dict

    @property
    def count(self) -> int:
        return self.state["count"]

    def bucket(self, path: str = "path") -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.count)).cast("int")

    def buckets(self, paths: DataFrame, column: str = "path") -> set[int]:
        """The buckets that some paths lie in; never more than there are."""
        return {r[0] for r in paths.select(self.bucket(column)).distinct().collect()}

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or only the given buckets of it: no other file is opened."""
        held = self.state["tables"].get(name, {})
        schema = StructType.fromJson(self.state["schemas"][name])
        # Folders whose rows are hidden by the same paths are read together.
        alike: dict[tuple[str, ...], list[str]] = {}
        for b, versions in held.items():
            if buckets is None or int(b) in buckets:
                for v in versions.split(","):
                    alike.setdefault(self._hiding(name, b, v), []).append(f"{self.root}/data/v={v}/{name}/bucket={b}")
        parts = []
        for later, folders in sorted(alike.items()):
            rows = self.spark.read.schema(schema).parquet(*sorted(folders))
            for v in later:
                rows = rows.join(self.spark.read.schema(TOUCHED).parquet(f"{self.root}/data/v={v}/{PATHS}"), "path", "left_anti")
            parts.append(rows.select(schema.names) if later else rows)
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return snapshots.unpacked(rows) if name == "notes" else rows

    def _hiding(self, name: str, bucket: str, version: str) -> tuple[str, ...]:
        """The later layers of a bucket, whose paths hide rows of this one."""
        layers = self.state.get("layers", {}).get(bucket, []) if name in LAYERED else []
        return tuple(layers[layers.index(version) + 1 :] if version in layers else layers)

    @property
    def notes(self) -> DataFrame:
        return self.table("notes")

    @property
    def links(self) -> DataFrame:
        return self.table("links")

    @property
    def titles(self) -> DataFrame:
        return self.table("names").groupBy("key").agg(F.max("path").alias("path"))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """The notes of the requested paths (path), from the buckets these lie in."""
        return self.table("notes", self.buckets(requests)).join(requests.select("path").distinct(), "path", "left_semi")

    def _written(
        self, name: str, rows: DataFrame, buckets: set[int], version: str, column: str | None = "path", lying: DataFrame | None = None
    ) -> "BucketStore":
        """This store with ``rows`` and ``lying`` as the new content of ``buckets``; an emptied bucket has no folder any more.
        Without ``column`` the rows name their ``bucket`` themselves. ``rows`` are shuffled to their buckets; ``lying`` are read
        from files of the buckets they go to, so they are written by the tasks that read them, unless these have become many."""
        folder = f"{self.root}/data/v={version}/{name}"
        if name == "notes":
            rows, lying = snapshots.packed(rows), None if lying is None else snapshots.packed(lying)
        dealt = rows if column is None else rows.withColumn("bucket", self.bucket(column))
        rows = rows.drop("bucket")
        dealt = dealt.repartition("bucket")
        if lying is not None:
            many = len(lying.inputFiles()) > MANY_FILES * len(buckets)
            lying = lying.withColumn("bucket", self.bucket(column))
            dealt = dealt.unionByName(lying.repartition("bucket") if many else lying)
        dealt.write.partitionBy("bucket").parquet(folder)
        held = {b: v for b, v in self.state["tables"].get(name, {}).items() if int(b) not in buckets}
        held |= {str(b): version for b in _folders(self.spark, folder)}
        tables = self.state["tables"] | {name: held}
        schemas = self.state["schemas"] | {name: json.loads(rows.schema.json())}
        return BucketStore(self.spark, self.root, self.state | {"tables": tables, "schemas": schemas})

    def _layered(self, paths: DataFrame, fresh: DataFrame, touched: set[int], version: str) -> "BucketStore":
        """This store with the rows of ``fresh`` as a further layer of ``touched`` buckets, and ``paths`` hidden in those before."""
        paths.write.parquet(f"{self.root}/data/v={version}/{PATHS}")
        tables, schemas = self.state["tables"], self.state["schemas"]
        for name, rows in [("notes", snapshots.packed(fresh)), *((n, make(fresh)) for n, make in PER_NOTE.items())]:
            folder = f"{self.root}/data/v={version}/{name}"
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
            held = tables.get(name, {})
            added = {str(b): ",".join([*filter(None, [held.get(str(b))]), version]) for b in _folders(self.spark, folder)}
            tables = tables | {name: held | added}
            schemas = schemas | {name: json.loads(rows.schema.json())}
        layers = self.state.get("layers", {})
        layers = layers | {str(b): [*layers.get(str(b), []), version] for b in touched}
        return BucketStore(self.spark, self.root, self.state | {"tables": tables, "schemas": schemas, "layers": layers})

    def _rewritten(self, paths: DataFrame, fresh: DataFrame, touched: set[int], version: str) -> "BucketStore":
        """This store with ``touched`` buckets written anew, without the notes of ``paths`` and with ``fresh``."""
        kept = self.table("notes", touched).join(paths, "path", "left_anti")
        layers = {b: v for b, v in self.state.get("layers", {}).items() if int(b) not in touched}
        store = self._written("notes", fresh, touched, version, lying=kept)
        return BucketStore(self.spark, self.root, store.state | {"layers": layers})._derived(touched, version)

    def _updated(self, paths: DataFrame, fresh: DataFrame, touched: set[int], version: str) -> "BucketStore":
        """This store after a batch: with a layer where the batch is small and layers are few, else with its buckets written anew."""
        counts = self.table("counts", touched).where("kind = 'note'").agg(F.sum("n")).first()[0] or 0
        layers = max(len(self.state.get("layers", {}).get(str(b), [])) for b in touched)
        few = paths.count() <= LAYER_SHARE * counts and layers < MANY_FILES
        return (self._layered if few else self._rewritten)(paths, fresh, touched, version)

    def _counted(self, notes: set[int], links: set[int], version: str) -> "BucketStore":
        """This store with the counts of rewritten buckets of notes and links."""
        counts = A.bucket_counts(self.table("notes", notes), self.table("tags", notes), self.bucket)
        degrees = A.bucket_degrees(self.table("links", links), self.bucket)
        return self._written("counts", counts, notes, version, None)._written("degrees", degrees, links, version, None)

    def _derived(self, buckets: set[int], version: str) -> "BucketStore":
        """This store with the tables that follow from the notes of ``buckets``, made where the notes lie."""
        store, notes = self, self.table("notes", buckets)
        for name, make in PER_NOTE.items():
            lying = make(notes)
            store = store._written(name, lying.limit(0), buckets, version, lying=lying)
        return store

    def _attempt(self) -> str:
        """A folder name of its own for every attempt, so that one that failed is in nobody's way."""
        return f"{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}"

    def _committed(self) -> "BucketStore":
        """Move the pointer, unless another batch has moved it since this store was loaded."""
        current, version = snapshots._read_pointer(self.spark, self.root), self.state["version"]
        if (current["version"] if current else 0) != version:
            raise ValueError(f"version {version} of {self.root} is not the current one any more")
        state = self.state | {"version": version + 1}
        pointer = self.spark.range(1).select(F.lit(json.dumps(state)))
        pointer.write.mode("overwrite").text(f"{self.root}/_current/v={version + 1}")
        return BucketStore(self.spark, self.root, state)


def _folders(spark: SparkSession, folder: str) -> list[int]:
    target, fs = snapshots._path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
    return [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]


def load(spark: SparkSession, root: str) -> BucketStore | None:
    """The current version, or None where there is none of this format."""
    state = snapshots._read_pointer(spark, root)
    return BucketStore(spark, root, state) if state and state.get("format") == FORMAT else None


def create(spark: SparkSession, root: str, notes: DataFrame, count: int = 64) -> BucketStore:
    """A first version from parsed notes. ``count`` stays for good: choose it for buckets of about a file's size."""
    store = BucketStore(spark, root, {"format": FORMAT, "version": 0, "count": count, "tables": {}, "schemas": {}})
    every, version = set(range(count)), store._attempt()
    store = store._written("notes", notes.select(*[f.name for f in NOTES]), every, version)
    store = store._derived(every, version)
    links = L.resolve_links(store.notes, store.titles).select(*[f.name for f in NOTE_LINKS])
    return store._written("links", links, every, version, "src")._counted(every, every, version)._committed()


def _entries(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, path): the dictionary entries of some keys."""
    return names.join(keys, "key", "left_semi").groupBy("key").agg(F.max("path").alias("path"))


def _moved_links(before: BucketStore, after: BucketStore, paths: DataFrame, touched: set[int]) -> tuple[DataFrame, DataFrame]:
    """(key) whose entry changed and (path) that came or went, from the changed paths alone."""
    keys = before.table("names", touched).unionByName(after.table("names", touched)).join(paths, "path", "left_semi")
    keys = cut(keys.select("key").distinct())
    was = _entries(before.table("names"), keys).withColumnRenamed("path", "was")
    now = _entries(after.table("names"), keys).withColumnRenamed("path", "now")
    changed = was.join(now, "key", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("key")
    # Only a touched path can come or go.
    there = before.table("notes", touched).select("path").join(paths, "path", "left_semi").withColumn("old", F.lit(True))
    here = after.table("notes", touched).select("path").join(paths, "path", "left_semi").withColumn("new", F.lit(True))
    flipped = there.join(here, "path", "full").where("old IS NULL OR new IS NULL").select("path")
    return cut(changed), cut(flipped)


def apply_batch(
    store: BucketStore, changed_raw: DataFrame, removed: DataFrame | None = None, config: NoteConfig = DEFAULT
) -> BucketStore:
    """The store after changed note files (path, raw, mtime, length) and removed paths (path).

    Of several versions of a path the newest wins; a path that is both changed and removed stays. Applying a batch twice gives the same
    tables again. Of two batches applied to one version the later one is refused.
    """
    version = store._attempt()
    newest = changed_raw.groupBy("path").agg(
        F.max_by(F.struct("raw", "mtime", "length"), F.struct("mtime", "length")).alias("_n")
    )
    fresh = cut(P.parse_notes(newest.select("path", "_n.raw", "_n.mtime", "_n.length"), config).select(*[f.name for f in NOTES]))
    paths = newest.select("path")  # a note that no longer parses is gone as well
    paths = cut(paths if removed is None else paths.union(removed.select("path")).distinct())
    touched = store.buckets(paths)
    if not touched:
        return store
    after = store._updated(paths, fresh, touched, version)

    keys, flipped = _moved_links(store, after, paths, touched)
    elsewhere = store.links.join(paths.withColumnRenamed("path", "src"), "src", "left_anti")
    targets = elsewhere.select("target").distinct()
    by_key = targets.withColumn("key", F.lower("target")).join(keys, "key", "left_semi").select("target")
    by_path = targets.withColumn("path", L.target_path(F.col("target"))).join(flipped, "path", "left_semi").select("target")
    own = L.raw_links(fresh).select("src", "target")
    again = cut(by_key.union(by_path).union(own.select("target")).distinct())
    wanted = again.select(F.lower("target").alias("key")).distinct()
    resolved = cut(L.resolve_targets(again, after.notes.select("path"), _entries(after.table("names"), wanted)))
    new_dst = resolved.select("target", F.col("dst").alias("_dst"))
    differs = elsewhere.join(new_dst, "target").where(~F.col("dst").eqNullSafe(F.col("_dst")))
    rewritten = touched | store.buckets(differs, "src")
    held = store.table("links", rewritten).join(paths.withColumnRenamed("path", "src"), "src", "left_anti")
    held = held.join(new_dst.withColumn("_again", F.lit(True)), "target", "left")
    held = held.select("src", "target", F.when(F.col("_again"), F.col("_dst")).otherwise(F.col("dst")).alias("dst"))
    links = own.join(resolved, "target", "left").select("src", "target", "dst")
    return after._written("links", links, rewritten, version, "src", held)._counted(touched, rewritten, version)._committed()
