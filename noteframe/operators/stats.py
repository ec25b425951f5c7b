"""Counts over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.operators.links import edges
from noteframe.operators.parse import note_tags
from noteframe.session import cut
from noteframe.sources.audit import audit_summary


def corpus_stats(notes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: notes, distinct resolved links, distinct tags.

    Three one-row aggregates laid side by side by a union and a max, no join.
    """
    parts = [
        notes.agg(F.count(F.lit(1)).alias("note_count")),
        edges(links).agg(F.count(F.lit(1)).alias("link_count")),
        note_tags(notes).agg(F.countDistinct("tag").alias("tag_count")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("note_count", "link_count", "tag_count")])


def tag_counts(notes: DataFrame) -> DataFrame:
    return note_tags(notes).groupBy("tag").agg(F.count(F.lit(1)).alias("note_count"))


def top_tags(notes: DataFrame, n: int = 20) -> DataFrame:
    return tag_counts(notes).orderBy(F.desc("note_count"), "tag").limit(n)


def in_degrees(links: DataFrame) -> DataFrame:
    return edges(links).groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def most_linked(notes: DataFrame, links: DataFrame, n: int = 10) -> DataFrame:
    """Top notes by distinct linking notes; unlinked notes count as zero."""
    best = lambda rows: rows.orderBy(F.desc("in_degree"), "path").limit(n)
    # The linked notes are ranked before any note is read; a link may point at a note that is gone.
    degrees = in_degrees(links).withColumnRenamed("dst", "path")
    known = notes.select("path", "title")
    linked = best(degrees.join(known.select("path"), "path", "left_semi"))
    # Unlinked notes only fill up; the first n by path are enough.
    zero = F.lit(0).cast("long").alias("in_degree")
    unlinked = best(known.select("path").join(degrees.select("path"), "path", "left_anti").select("path", zero))
    top = best(linked.unionByName(unlinked))
    return top.join(known, "path").select("path", "title", "in_degree").orderBy(F.desc("in_degree"), "path")


def folder_rows(notes: DataFrame, *keep) -> DataFrame:
    """(folder, depth) of every folder a note lies in or below, ``/`` included, beside the columns to keep."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(
        F.sequence(F.lit(0), depth),
        lambda i: F.struct(
            F.when(i == 0, F.lit("/"))
            .otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/"))
            .alias("folder"),
            i.alias("depth"),
        ),
    )
    return notes.select(*keep, F.inline(prefixes))


def folder_counts(notes: DataFrame) -> DataFrame:
    """(folder, depth, note_count): notes at or below every folder; ``/`` is all."""
    return folder_rows(notes).groupBy("folder", "depth").agg(F.count(F.lit(1)).alias("note_count"))


# Counts held with a bucketed snapshot: every bucket has its own, rewritten with it, and their sums are the answers. No note row is read.


def bucket_counts(notes: DataFrame, tags: DataFrame, bucket) -> DataFrame:
    """(bucket, kind, key, depth, n): notes, tags and folders counted per bucket; ``bucket`` gives it for a path."""
    mine = bucket("path").alias("bucket")
    row = lambda kind, key, depth: [F.lit(kind).alias("kind"), key.alias("key"), depth.cast("int").alias("depth")]
    folders = folder_rows(notes, mine).select("bucket", *row("folder", F.col("folder"), F.col("depth")))
    rows = folders.union(tags.select(mine, *row("tag", F.col("tag"), F.lit(0)))).union(notes.select(mine, *row("note", F.lit(""), F.lit(0))))
    return rows.groupBy("bucket", "kind", "key", "depth").agg(F.count(F.lit(1)).alias("n"))


def bucket_degrees(links: DataFrame, bucket) -> DataFrame:
    """(bucket, path, n): linking notes of every linked note; a source lies in one bucket, so the numbers add up."""
    return edges(links).groupBy(bucket("src").alias("bucket"), F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def held_counts(store, kind: str) -> DataFrame:
    """(key, depth, note_count) of one kind over all buckets of a store."""
    return store.table("counts").where(F.col("kind") == kind).groupBy("key", "depth").agg(F.sum("n").alias("note_count"))


def held_stats(store) -> DataFrame:
    """As ``corpus_stats``."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    parts = [
        held_counts(store, "note").agg(zero(F.sum("note_count")).alias("note_count")),
        store.table("degrees").agg(zero(F.sum("n")).alias("link_count")),
        held_counts(store, "tag").agg(F.count(F.lit(1)).alias("tag_count")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("note_count", "link_count", "tag_count")])


def held_top_tags(store, n: int = 20) -> DataFrame:
    """As ``top_tags``."""
    return held_counts(store, "tag").select(F.col("key").alias("tag"), "note_count").orderBy(F.desc("note_count"), "tag").limit(n)


def held_folder_counts(store) -> DataFrame:
    """As ``folder_counts``."""
    return held_counts(store, "folder").select(F.col("key").alias("folder"), "depth", "note_count")


def held_most_linked(store, n: int = 10) -> DataFrame:
    """As ``most_linked``: titles come from the buckets of the answer; other paths are read only to fill up a short list."""
    best = lambda rows: rows.orderBy(F.desc("in_degree"), "path").limit(n)
    degrees = store.table("degrees").groupBy("path").agg(F.sum("n").alias("in_degree"))
    top = cut(best(degrees))
    if top.count() < n:
        rest = store.notes.select("path").join(top.select("path"), "path", "left_anti")
        top = cut(best(top.unionByName(rest.select("path", F.lit(0).cast("long").alias("in_degree")))))
    titles = store.lookup(top).select("path", "title")
    return top.join(titles, "path").select("path", "title", "in_degree").orderBy(F.desc("in_degree"), "path")


def runtime_health(notes: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """One row: corpus counts, newest note, last log day and last write."""
    rows = corpus_stats(notes, links)
    for part in (notes.agg(F.max("mtime").alias("last_indexed")), audit_summary(log)):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def overview(notes: DataFrame, links: DataFrame, tags: int = 20, linked: int = 10) -> DataFrame:
    """(part, key, value) rows: stats, top tags, most linked notes, folders, last change."""
    stats = corpus_stats(notes, links)
    return (
        stats.select(
            F.lit("stats").alias("part"),
            F.explode(
                F.create_map(
                    *[x for c in stats.columns for x in (F.lit(c), F.col(c).cast("string"))]
                )
            ).alias("key", "value"),
        )
        .union(top_tags(notes, tags).select(F.lit("top_tag"), "tag", F.col("note_count").cast("string")))
        .union(most_linked(notes, links, linked).select(F.lit("most_linked"), "path", F.col("in_degree").cast("string")))
        .union(folder_counts(notes).select(F.lit("folder"), "folder", F.col("note_count").cast("string")))
        .union(notes.agg(F.max("mtime").cast("string").alias("v")).select(F.lit("stats"), F.lit("last_indexed"), "v"))
    )
