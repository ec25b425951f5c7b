"""The link graph: resolution, neighbours, N-hop traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.functions import markdown as md
from noteframe.operators.skew import spread_join
from noteframe.session import cut

STEP_ROWS = 1_000_000  # pairs per partition of a traversal step


def note_names(notes: DataFrame) -> DataFrame:
    """(path, key): the lower-case title and file stem of every note."""
    keys = F.array_distinct(F.array(F.lower("title"), F.lower(md.stem(F.col("path")))))
    return notes.select("path", F.explode(keys).alias("key"))


def title_dict(notes: DataFrame) -> DataFrame:
    """(key, path): lower-case titles and file stems, one path per key."""
    return note_names(notes).groupBy("key").agg(F.max("path").alias("path"))


def resolve_titles(titles: DataFrame, requests: DataFrame, column: str = "name") -> DataFrame:
    """Requests with the path their name stands for, NULL if none."""
    keyed = requests.withColumn("key", F.lower(F.col(column)))
    return keyed.join(titles, "key", "left").drop("key")


def raw_links(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("src"), F.explode("raw_links").alias("target"))


def target_path(target: Column) -> Column:
    """The path that a link target would name."""
    return F.when(F.endswith(target, F.lit(".md")), target).otherwise(F.concat(target, F.lit(".md")))


def resolve_targets(targets: DataFrame, paths: DataFrame, titles: DataFrame) -> DataFrame:
    """(target, dst) of distinct targets (target): a path, else a dictionary entry, else NULL."""
    exact = paths.select(F.col("path").alias("_exact"))
    keyed = targets.select("target", target_path(F.col("target")).alias("_as_path"), F.lower("target").alias("_key"))
    by_path = keyed.join(exact, F.col("_as_path") == F.col("_exact"), "left")
    by_title = by_path.join(titles.withColumnsRenamed({"key": "_key", "path": "_titled"}), "_key", "left")
    return by_title.select("target", F.coalesce("_exact", "_titled").alias("dst"))


def resolve_links(notes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(src, target, dst) for every distinct wikilink; dst NULL if unresolved.

    Each distinct target is resolved once: a target written in many notes is
    collapsed before the dictionary joins, and spread when joined back.
    """
    titles = title_dict(notes) if titles is None else titles
    links = raw_links(notes)
    resolved = resolve_targets(links.select("target").distinct(), notes.select("path"), titles)
    return spread_join(links, resolved, "target", "left", salt_by=["src"]).select("src", "target", "dst")


def edges(links: DataFrame) -> DataFrame:
    """Distinct resolved (src, dst) pairs."""
    return links.where(F.col("dst").isNotNull()).select("src", "dst").distinct()


def _with_note(pairs: DataFrame, notes: DataFrame, column: str) -> DataFrame:
    """Attach title and tags of the note named by ``column``."""
    info = notes.select(F.col("path").alias(column), "title", "tags")
    return pairs.join(info, column, "inner")


def backlinks(links: DataFrame, notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, path, title, tags): notes that link to each seed path."""
    wanted = seeds.select(F.col("path").alias("dst")).distinct()
    pairs = spread_join(edges(links), wanted, "dst", "inner", salt_by=["src"])
    return _with_note(pairs, notes, "src").select(
        F.col("dst").alias("seed"), F.col("src").alias("path"), "title", "tags"
    )


def forward_links(links: DataFrame, notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, path, title, tags): notes each seed path links to."""
    wanted = seeds.select(F.col("path").alias("src")).distinct()
    pairs = spread_join(edges(links), wanted, "src", "inner", salt_by=["dst"])
    return _with_note(pairs, notes, "dst").select(
        F.col("src").alias("seed"), F.col("dst").alias("path"), "title", "tags"
    )


def related_notes(
    links: DataFrame,
    notes: DataFrame,
    seeds: DataFrame,
    hops: int = 2,
    where: Column | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """(seed, path, hop, title, tags) for the undirected neighbourhood.

    ``hop`` is the smallest distance. ``where`` filters the result only, so a
    filtered note still conducts; in the last hop, which conducts nothing, it applies
    before that hop is shuffled. ``hot_rows`` salts hubs, see ``spread_join``.
    Only the hops that conduct are written. The pairs of the last one, which are most of the answer,
    are shuffled once, by their note: there they are made distinct and meet their titles and tags.
    """
    directed = edges(links)
    undirected = cut(
        directed.union(directed.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
    info = notes.select(F.col("path").alias("node"), *[c for c in ("title", "tags", "frontmatter") if c in notes.columns])
    frontier = seeds.select(F.col("path").alias("seed"), F.col("path").alias("node")).distinct()
    reached = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = spread_join(
            undirected,
            frontier.withColumnRenamed("node", "src"),
            "src",
            "inner",
            salt_by=["dst"],
            hot_rows=hot_rows,
        )
        step = step.select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hop"))
        if hop < hops:
            reached = cut(_nearest(reached.union(step), _parts(undirected, frontier)))
            frontier = reached.where(F.col("hop") == hop).select("seed", "node")
            continue
        if where is not None:
            step = step.join(notes.where(where).select(F.col("path").alias("node")), "node", "left_semi")
            step = step.select("seed", "node", "hop")
        reached = _nearest(reached.union(step), _parts(undirected, frontier))
    out = reached.where(F.col("hop") > 0).join(info, "node").withColumnRenamed("node", "path")
    if where is not None:
        out = out.where(where)
    return out.select("seed", "path", "hop", "title", "tags")


def _nearest(pairs: DataFrame, parts: int) -> DataFrame:
    """Distinct (seed, node) with their smallest hop, in ``parts`` partitions by node.

    A join hands out the pairs of a node one after another, so that they lie together in the shuffle
    and take little room; dealt by seed and node they would not.
    """
    return pairs.repartition(parts, "node").groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def _parts(undirected: DataFrame, frontier: DataFrame) -> int:
    """Partitions for the next step: no fewer than usual, and of about ``STEP_ROWS`` rows, so that none spills."""
    degrees = undirected.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rows = frontier.join(degrees, "node").agg(F.sum("degree")).first()[0] or 0
    usual = int(undirected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, rows // STEP_ROWS + 1)


def traverse(
    links: DataFrame,
    notes: DataFrame,
    seeds: DataFrame,
    direction: str,
    hops: int = 2,
    where: Column | None = None,
) -> DataFrame:
    """Neighbours by direction: in, out or neighborhood (filter applies there only)."""
    if direction == "in":
        return backlinks(links, notes, seeds)
    if direction == "out":
        return forward_links(links, notes, seeds)
    if direction == "neighborhood":
        return related_notes(links, notes, seeds, hops, where)
    raise ValueError(f"unknown direction {direction!r}")
