"""Customers and what their notes hold: deals, milestones, team, insights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.config import DEFAULT, NoteConfig
from noteframe.functions import frontmatter as fm
from noteframe.functions import markdown as md
from noteframe.session import cut


def under(notes: DataFrame, root: str) -> DataFrame:
    """Notes below a root; also prunes a snapshot partitioned by top folder."""
    cond = F.startswith(F.col("path"), F.lit(root))
    if "root" in notes.columns:
        cond = cond & (F.col("root") == root.rstrip("/").split("/")[0])
    return notes.where(cond)


def customer_roster(notes: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """Distinct customer names, from folders and flat files."""
    name = md.customer_of(F.col("path"), config.customers_root)
    return under(notes, config.customers_root).select(name.alias("customer")).distinct()


def customer_notes(notes: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """The main note of each customer with ``customer`` and ``layout``; nested wins."""
    inner = F.substr(F.col("path"), F.lit(len(config.customers_root) + 1))
    name = md.customer_of(F.col("path"), config.customers_root)
    staged = under(notes, config.customers_root).withColumns(
        {
            "customer": name,
            "layout": F.when(inner == F.concat(name, F.lit("/"), name, F.lit(".md")), "nested").when(
                inner == F.concat(name, F.lit(".md")), "flat"
            ),
        }
    ).where(F.col("layout").isNotNull())
    nested = staged.where("layout = 'nested'")
    flat = staged.where("layout = 'flat'").join(nested.select("customer"), "customer", "left_anti")
    return nested.unionByName(flat)


def customer_paths(notes: DataFrame, requests: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """(customer, path, layout) for requested names; a new customer gets the nested path."""
    root = config.customers_root
    main = customer_notes(notes, config).select("customer", F.col("path").alias("_path"), F.col("layout").alias("_layout"))
    default = F.concat(F.lit(root), F.col("customer"), F.lit("/"), F.col("customer"), F.lit(".md"))
    return (
        requests.select("customer")
        .distinct()
        .join(main, "customer", "left")
        .select(
            "customer",
            F.coalesce("_path", default).alias("path"),
            F.coalesce("_layout", F.lit("none")).alias("layout"),
        )
    )


def flat_customers(notes: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """Flat customer files without a folder of that name."""
    root = config.customers_root
    inner = F.substr(F.col("path"), F.lit(len(root) + 1))
    staged = under(notes, root).select(
        "path", inner.alias("_inner"), md.customer_of(F.col("path"), root).alias("customer")
    )
    nested = F.contains(F.col("_inner"), F.lit("/"))
    folders = staged.where(nested).select("customer").distinct()
    return (
        staged.where(~nested)
        .join(folders, "customer", "left_anti")
        .select(
            "customer",
            F.col("path").alias("current_path"),
            F.concat(F.lit(root), "customer", F.lit("/"), "_inner").alias("expected_path"),
        )
    )


def with_sections(main: DataFrame) -> DataFrame:
    """Add ``_pieces``, the sections of the body, split once."""
    if "_pieces" in main.columns:
        return main
    return main.withColumn("_pieces", md.section_pieces(F.col("body")))


def customer_base(notes: DataFrame, requests: DataFrame | None = None, config: NoteConfig = DEFAULT) -> DataFrame:
    """The main notes with their sections as a written table.

    For views that read several sections: the bodies are split once.
    ``requests`` (customer) keeps the named customers, None keeps all.
    """
    main = customer_notes(notes, config)
    if requests is not None:
        main = main.join(requests.select("customer").distinct(), "customer", "left_semi")
    keep = ["customer", "path", "layout", "title", "tags", "frontmatter", "mtime", "_pieces"]
    return cut(with_sections(main).select(keep))


def section(*headings: str) -> Column:
    """Content of the first of several headings present in ``_pieces``."""

    def last(heading):
        return F.try_element_at(
            F.filter("_pieces", lambda s: s["heading"] == heading), F.lit(-1)
        )["content"]

    return F.coalesce(*[last(h) for h in headings])


def _main(notes: DataFrame, config: NoteConfig, main: DataFrame | None) -> DataFrame:
    return customer_notes(notes, config) if main is None else main


def _sub_notes(notes: DataFrame, subdir: str, config: NoteConfig, main: DataFrame | None = None) -> DataFrame:
    root = config.customers_root
    inner = F.substr(F.col("path"), F.lit(len(root) + 1))
    found = (
        under(notes, root)
        .where(F.rlike(inner, F.lit(rf"^[^/]+/\Q{subdir}\E[^/]+$")))
        .withColumn("customer", md.customer_of(F.col("path"), config.customers_root))
    )
    return found if main is None else found.join(main.select("customer"), "customer", "left_semi")


def _section_lines(main: DataFrame, *headings: str) -> DataFrame:
    """(customer, path, ordinal, line) of a section of the main notes."""
    staged = with_sections(main).select("customer", "path", section(*headings).alias("_text"))
    return staged.select("customer", "path", F.posexplode(md.lines(F.col("_text"))).alias("ordinal", "line"))


def _with_fallback(sub: DataFrame, listed: DataFrame) -> DataFrame:
    """Sub-note rows, and section rows for customers without any sub-note."""
    have = sub.select("customer").distinct()
    return sub.unionByName(listed.join(have, "customer", "left_anti"), allowMissingColumns=True)


def opportunities(notes: DataFrame, config: NoteConfig = DEFAULT, main: DataFrame | None = None) -> DataFrame:
    """(customer, path, ordinal, name, guid, status, stage, owner, salesplay, last_validated).

    With ``main`` from :func:`customer_base`, of those customers only.
    """
    f = F.col("frontmatter")
    sub = _sub_notes(notes, config.opportunities_subdir, config, main).select(
        "customer",
        "path",
        F.lit(0).alias("ordinal"),
        F.col("title").alias("name"),
        fm.first_text(f, "opportunityId", "guid", "opportunityid").alias("guid"),
        *[fm.text(f, key).alias(key) for key in ("status", "stage", "owner", "salesplay", "last_validated")],
    )
    rows = _section_lines(_main(notes, config, main), "Opportunities").withColumn(
        "_o", md.opportunity(F.col("line"))
    )
    listed = rows.where(F.col("_o").isNotNull()).select("customer", "path", "ordinal", "_o.name", "_o.guid")
    return _with_fallback(sub, listed)


def milestones(notes: DataFrame, config: NoteConfig = DEFAULT, main: DataFrame | None = None) -> DataFrame:
    """(customer, path, ordinal, name, id, number, status, milestonedate, owner, opportunity)."""
    f = F.col("frontmatter")
    sub = _sub_notes(notes, config.milestones_subdir, config, main).select(
        "customer",
        "path",
        F.lit(0).alias("ordinal"),
        F.col("title").alias("name"),
        fm.first_text(f, "milestoneId", "milestoneid", "id").alias("id"),
        fm.first_text(f, "milestoneNumber", "number", "milestone_number").alias("number"),
        fm.text(f, "status").alias("status"),
        fm.first_text(f, "milestoneDate", "milestonedate").alias("milestonedate"),
        fm.text(f, "owner").alias("owner"),
        fm.text(f, "opportunity").alias("opportunity"),
    )
    rows = _section_lines(_main(notes, config, main), "Milestones").withColumn("_m", md.milestone(F.col("line")))
    listed = rows.where(F.col("_m").isNotNull()).select(
        "customer", "path", "ordinal", "_m.name", "_m.id", "_m.number"
    )
    return _with_fallback(sub, listed)


def team_members(
    notes: DataFrame,
    config: NoteConfig = DEFAULT,
    headings: tuple[str, ...] | None = None,
    main: DataFrame | None = None,
) -> DataFrame:
    """(customer, path, ordinal, name, role)."""
    rows = _section_lines(_main(notes, config, main), *(headings or config.team_headings))
    rows = rows.withColumn("_t", md.member(F.col("line"))).where(F.col("_t").isNotNull())
    return rows.select("customer", "path", "ordinal", "_t.name", "_t.role")


def insights(
    notes: DataFrame, latest: int = 2, config: NoteConfig = DEFAULT, main: DataFrame | None = None
) -> DataFrame:
    """(customer, source, partitioned, ordinal, entry): the newest insight notes
    of a customer, else the lines of the insight section."""
    sub = _sub_notes(notes, config.insights_subdir, config, main)
    # row_number under a limit is pruned before the shuffle, so a customer with
    # very many files sends only its best few per task.
    newest = sub.withColumn(
        "_rank", F.row_number().over(W.partitionBy("customer").orderBy(F.desc("path")))
    ).where(F.col("_rank") <= latest)
    files = newest.select(
        "customer",
        F.col("path").alias("source"),
        F.lit(True).alias("partitioned"),
        F.posexplode(F.transform(md.lines(F.col("body")), md.insight)).alias("ordinal", "entry"),
    )
    listed = _section_lines(_main(notes, config, main), "Agent Insights").select(
        "customer",
        F.col("path").alias("source"),
        F.lit(False).alias("partitioned"),
        "ordinal",
        md.insight(F.col("line")).alias("entry"),
    )
    have = sub.select("customer").distinct()
    return files.unionByName(listed.join(have, "customer", "left_anti"))


def stale_insights(
    notes: DataFrame, as_of: str, config: NoteConfig = DEFAULT, main: DataFrame | None = None
) -> DataFrame:
    """(customer, ordinal, text, date, age_days) of insights older than the limit."""
    rows = _section_lines(_main(notes, config, main), "Agent Insights")
    day = md.found(F.col("line"), md.DATED_ITEM, 1)
    age = F.datediff(F.lit(as_of).cast("date"), day.try_cast("date"))
    return (
        rows.select(
            "customer",
            "ordinal",
            F.trim(F.regexp_extract("line", md.DATED_ITEM, 2)).alias("text"),
            day.alias("date"),
            age.alias("age_days"),
        )
        .where(F.col("age_days") > config.stale_days)
    )


def last_insight_date(notes: DataFrame, config: NoteConfig = DEFAULT, main: DataFrame | None = None) -> DataFrame:
    """(customer, last_insight_date): latest day text in the insight section."""
    staged = with_sections(_main(notes, config, main))
    return staged.select("customer", md.day_in(F.coalesce(section("Agent Insights"), F.lit(""))).alias("last_insight_date"))


def resolve_tpid(notes: DataFrame, requests: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """Requests (name) with the customer behind a numeric id; other names pass.

    Only a quoted, textual id matches. The first note by path wins.
    """
    stored = F.trim(F.regexp_replace(fm.text(F.col("frontmatter"), config.tpid_field), r'^"|"$', ""))
    ids = (
        under(notes, config.customers_root)
        .select(stored.alias("_id"), "path")
        .where(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.min("path").alias("path"))
        .select("_id", md.customer_of(F.col("path"), config.customers_root).alias("_customer"))
    )
    wanted = requests.withColumn("_id", F.trim("name"))
    numeric = looks_like_tpid(F.col("name"))
    return wanted.join(ids, "_id", "left").select(
        "name",
        F.when(numeric, F.col("_customer")).otherwise(F.col("name")).alias("customer"),
        F.when(numeric & F.col("_customer").isNull(), "NOT_FOUND").otherwise("OK").alias("status"),
    )


def looks_like_tpid(name: Column) -> Column:
    return F.rlike(F.trim(name), F.lit(r"^\d{4,15}$"))


def similar_customers(notes: DataFrame, requests: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """(customer, path, title, shared_tags) for requested customers.

    The listing is as long as its answer: use :func:`similar_counts` to rate
    every customer against every other without listing pairs.
    """
    main = customer_notes(notes, config)
    wanted = main.join(requests.select("customer").distinct(), "customer", "left_semi").select(
        "customer", F.col("path").alias("_self"), F.explode("tags").alias("tag")
    )
    tagged = under(notes, config.customers_root).select("path", "title", F.explode("tags").alias("tag"))
    return (
        tagged.join(wanted, "tag")
        .where(F.col("path") != F.col("_self"))
        .groupBy("customer", "path")
        .agg(F.first("title").alias("title"), F.count(F.lit(1)).alias("shared_tags"))
    )


SUBSET_TAGS = 10  # tag sets up to this size are counted among each other through their subsets
BITMAP_ROWS = 32_768  # rows of one bitmap, fixed by the bitmap functions
BITMAP_GROUP = 8  # bitmaps of a tag that a task holds side by side
SET_SHARE = 32_768  # sets that meet them in one task


def _subsets(tags: Column) -> Column:
    """All non-empty subsets of a sorted tag array."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(tags)).cast("int") - 1)
    return F.transform(
        masks, lambda m: F.filter(tags, lambda t, i: F.getbit(m, i) == 1)
    )


def _held_rows():
    """The count of :func:`_union_sizes` as a function that workers need no module for."""

    def held_rows(key: tuple, bitmaps: pa.Table, sets: pa.Table) -> pa.Table:
        """(_id, _near): how many rows of one group of bitmaps hold any tag of each set."""
        tags = bitmaps["tag"].combine_chunks().unique()
        at = pc.index_in(bitmaps["tag"], value_set=tags).to_numpy()
        held = np.zeros((len(tags) + 1, BITMAP_GROUP, BITMAP_ROWS // 8), np.uint8)  # the last one, empty, for tags that no row holds
        if len(at):
            bits = np.frombuffer(b"".join(bitmaps["_bits"].to_pylist()), np.uint8).reshape(len(at), -1)
            held[at, bitmaps["_bucket"].to_numpy() % BITMAP_GROUP] = bits
        held = held.reshape(len(tags) + 1, -1)
        used = held.any(axis=0).nonzero()[0]
        words = -(-(int(used[-1]) + 1) // 8) if len(used) else 0
        held = np.ascontiguousarray(held[:, : words * 8]).view(np.uint64)
        counts = np.zeros(len(sets), np.int64)
        asked = sets["_set"].combine_chunks()
        place = pc.fill_null(pc.index_in(asked.flatten(), value_set=tags), len(tags)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        for i, own in enumerate(np.split(place, ends[:-1])):
            counts[i] = np.bitwise_count(np.bitwise_or.reduce(held[own], axis=0)).sum()
        return pa.table({"_id": sets["_id"], "_near": counts})

    return held_rows


def _union_sizes(sets: DataFrame, notes: DataFrame) -> DataFrame:
    """(_id, _near): how many rows of ``notes`` (_set) hold any tag of each set (_id, _set).

    Rows are numbered as they are written; every tag has one bitmap of 4 KB for 32,768 rows. Sets meet the bitmaps of
    one group of rows at a time, so a task holds those bitmaps and one share of the sets, and what is shuffled are the sets
    once per group. Tags that no set asks for get no bitmap.
    """
    # Numbered before the tags are listed: a note has one number.
    rows = cut(notes.select("_set", F.monotonically_increasing_id().alias("_row"))).select(
        F.explode("_set").alias("tag"),
        F.expr(f"_row div {BITMAP_ROWS}").alias("_bucket"),
        (F.col("_row") % BITMAP_ROWS).alias("_bit"),
    )
    asked = sets.select(F.explode("_set").alias("tag")).distinct()
    rows = rows.join(asked, "tag", "left_semi")
    group = F.expr(f"_bucket div {BITMAP_GROUP}").alias("_group")
    bitmaps = cut(rows.groupBy("tag", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))).select("*", group)
    share = F.expr(f"_id div {SET_SHARE}")
    groups = bitmaps.select(F.col("_group").alias("_of")).distinct()
    met = sets.crossJoin(F.broadcast(groups)).select("_id", "_set", "_of", share.alias("_in"))
    bitmaps = bitmaps.crossJoin(F.broadcast(sets.select(share.alias("_share")).distinct()))
    unions = bitmaps.groupBy("_group", "_share").cogroup(met.groupBy("_of", "_in"))
    counted = unions.applyInArrow(_held_rows(), "_id long, _near long")
    return counted.groupBy("_id").agg(F.sum("_near").alias("_near")).where("_near > 0")


def similar_counts(notes: DataFrame, config: NoteConfig = DEFAULT, subset_tags: int = SUBSET_TAGS) -> DataFrame:
    """(customer, similar_count): how many other notes below the customers root
    share a tag with each customer.

    The notes that share a tag with a set are the union of the notes of its tags. Among sets of up to ``subset_tags``
    tags inclusion and exclusion over their subsets gives its size; wherever a larger set takes part, bitmaps of the notes
    of each tag do. Neither pairs notes or sets.
    """
    below = under(notes, config.customers_root).where(F.size("tags") > 0).select(F.array_sort("tags").alias("_set"))
    # Sets go by number: their tags are long, and a written table of them far smaller than its rows in memory.
    sets = cut(below.groupBy("_set").agg(F.count(F.lit(1)).alias("_size")).withColumn("_id", F.monotonically_increasing_id()))
    small, large = sets.where(F.size("_set") <= subset_tags), sets.where(F.size("_set") > subset_tags)
    parts = small.select("_id", "_size", F.explode(_subsets(F.col("_set"))).alias("_part"))
    holders = parts.groupBy("_part").agg(F.sum("_size").alias("_n"))
    sign = F.when(F.size("_part") % 2 == 1, F.col("_n")).otherwise(-F.col("_n"))
    near = parts.select("_id", "_part").join(holders.hint("merge"), "_part").groupBy("_id").agg(F.sum(sign).alias("_near"))
    if not large.isEmpty():
        near = near.union(_union_sizes(small, below.where(F.size("_set") > subset_tags))).union(_union_sizes(large, below))
    near = near.groupBy("_id").agg((F.sum("_near") - 1).alias("similar_count"))
    near = sets.select("_set", "_id").join(near, "_id").select("_set", "similar_count").hint("merge")
    main = customer_notes(notes, config).select("customer", F.array_sort("tags").alias("_set"))
    return main.join(near, "_set", "left").select(
        "customer", F.coalesce("similar_count", F.lit(0)).cast("long").alias("similar_count")
    )
