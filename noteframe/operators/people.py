"""People, meetings and open tasks around customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.config import DEFAULT, NoteConfig
from noteframe.functions import frontmatter as fm
from noteframe.functions import markdown as md
from noteframe.operators.entities import customer_notes, customer_paths, customer_roster, under
from noteframe.operators.links import edges
from noteframe.operators.skew import spread_join


def _cutoff(as_of: str, days: int):
    return F.date_sub(F.lit(as_of).cast("date"), days)


def linked_people(notes: DataFrame, requests: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """(customer, path, title, tags) of people whose ``customers`` list names it."""
    listed = under(notes, config.people_root).select(
        "path",
        "title",
        "tags",
        F.explode(F.array_distinct(F.transform(fm.strings(F.col("frontmatter"), "customers"), F.lower))).alias("_key"),
    )
    wanted = requests.select("customer", F.lower("customer").alias("_key")).distinct()
    return spread_join(listed, wanted, "_key", salt_by=["path"]).select("customer", "path", "title", "tags")


def recent_meetings(
    notes: DataFrame, requests: DataFrame, as_of: str, lookback_days: int = 90, config: NoteConfig = DEFAULT
) -> DataFrame:
    """(customer, path, title, tags, date) of meetings within the lookback.

    A meeting without a date text stays, one with an unreadable date goes.
    """
    front = F.col("frontmatter")
    day = fm.text(front, config.date_field)
    meetings = (
        under(notes, config.meetings_root)
        .select(
            "path",
            "title",
            "tags",
            day.alias("date"),
            F.lower(fm.text(front, config.customer_field)).alias("_key"),
        )
        .where(F.col("_key").isNotNull())
        .where(F.col("date").isNull() | (md.iso_date(F.col("date")) >= _cutoff(as_of, lookback_days)))
    )
    wanted = requests.select("customer", F.lower("customer").alias("_key")).distinct()
    return spread_join(meetings, wanted, "_key", salt_by=["path"]).select("customer", "path", "title", "tags", "date")


def frontmatter_meetings(
    notes: DataFrame,
    as_of: str,
    lookback_days: int = 90,
    config: NoteConfig = DEFAULT,
    main: DataFrame | None = None,
) -> DataFrame:
    """(customer, path, title, date) from the ``recent_meetings`` list of customers."""
    items = F.try_variant_get("frontmatter", "$.recent_meetings", "array<variant>")
    main = customer_notes(notes, config) if main is None else main
    rows = main.select("customer", F.explode(items).alias("_m"))
    path, day, title = [fm.text(F.col("_m"), key) for key in ("path", "date", "title")]
    return (
        rows.select("customer", path.alias("path"), F.coalesce(title, md.stem(path)).alias("title"), day.alias("date"))
        .where(F.col("path").isNotNull() & (F.col("path") != ""))
        .where(md.iso_date(F.col("date")) >= _cutoff(as_of, lookback_days))
    )


def customer_meetings(
    notes: DataFrame,
    requests: DataFrame,
    as_of: str,
    lookback_days: int = 90,
    config: NoteConfig = DEFAULT,
    main: DataFrame | None = None,
) -> DataFrame:
    """The listed meetings of a customer, or the scanned ones when it lists none."""
    listed = frontmatter_meetings(notes, as_of, lookback_days, config, main)
    if main is None:
        listed = listed.join(requests.select("customer").distinct(), "customer", "left_semi")
    scanned = recent_meetings(notes, requests, as_of, lookback_days, config)
    have = listed.select("customer").distinct()
    return listed.unionByName(
        scanned.select("customer", "path", "title", "date").join(have, "customer", "left_anti")
    )


def meetings_for_person(
    notes: DataFrame, links: DataFrame, requests: DataFrame, config: NoteConfig = DEFAULT
) -> DataFrame:
    """(name, path, title): meetings a person owns actions in, or that link to them."""
    wanted = requests.select("name").distinct()
    meetings = under(notes, config.meetings_root)
    owners = F.array_distinct(F.transform(fm.strings(F.col("frontmatter"), "action_owners"), F.lower))
    owned = spread_join(
        meetings.select("path", F.explode(owners).alias("_key")),
        wanted.withColumn("_key", F.lower("name")),
        "_key",
        salt_by=["path"],
    ).select("name", "path")
    person = F.concat(F.lit(config.people_root), F.col("name"), F.lit(".md"))
    linking = spread_join(
        edges(links).where(F.startswith(F.col("src"), F.lit(config.meetings_root))),
        wanted.withColumn("dst", person),
        "dst",
        salt_by=["src"],
    ).select("name", F.col("src").alias("path"))
    pairs = owned.union(linking).distinct()
    return pairs.join(meetings.select("path", "title"), "path").select("name", "path", "title")


def open_items(
    notes: DataFrame,
    links: DataFrame,
    tasks: DataFrame,
    requests: DataFrame,
    as_of: str,
    assignee: str | None = None,
    config: NoteConfig = DEFAULT,
    main: DataFrame | None = None,
) -> DataFrame:
    """(customer, path, ordinal, text, assignee): open tasks in the customer note,
    its neighbours and its meetings of the last 90 days."""
    mains = customer_paths(notes, requests, config) if main is None else main
    mains = mains.select("customer", "path")
    graph = edges(links)
    outward = spread_join(graph, mains.withColumnRenamed("path", "src"), "src", salt_by=["dst"])
    inward = spread_join(graph, mains.withColumnRenamed("path", "dst"), "dst", salt_by=["src"])
    met = recent_meetings(notes, requests, as_of, 90, config)
    pairs = (
        mains.union(outward.select("customer", F.col("dst").alias("path")))
        .union(inward.select("customer", F.col("src").alias("path")))
        .union(met.select("customer", "path"))
        .distinct()
    )
    wanted = tasks.where(~F.col("done"))
    if assignee is not None:
        wanted = wanted.where(F.lower("assignee") == assignee.lower())
    return pairs.join(wanted, "path").select(
        "customer", "path", "ordinal", "text", "assignee"
    )


def orphaned_meetings(
    notes: DataFrame, links: DataFrame, strict: bool = False, config: NoteConfig = DEFAULT
) -> DataFrame:
    """Meetings that name no customer of the roster and link to none.

    ``strict`` compares the link path without root and extension as it stands,
    so that a link to a nested customer note does not count.
    """
    root = config.customers_root
    roster = customer_roster(notes, config).select(F.lower("customer").alias("_key")).distinct()
    meetings = under(notes, config.meetings_root).select(
        "path", F.lower(fm.text(F.col("frontmatter"), "customer")).alias("_key")
    )
    unnamed = spread_join(meetings, roster, "_key", "left_anti", salt_by=["path"])
    if strict:
        below = F.when(F.startswith("dst", F.lit(root)), F.substr("dst", F.lit(len(root) + 1))).otherwise(F.col("dst"))
        bare = F.regexp_replace(below, r"\.md$", "")
        linked = edges(links).select("src", F.lower(bare).alias("_key"))
    else:
        linked = edges(links).where(F.startswith(F.col("dst"), F.lit(root))).select(
            "src", F.lower(md.customer_of(F.col("dst"), root)).alias("_key")
        )
    # One row per linking note: distinct before the anti join.
    tied = (
        spread_join(linked, roster, "_key", "left_semi", salt_by=["src"]).select(F.col("src").alias("path")).distinct()
    )
    return unnamed.join(tied, "path", "left_anti").select("path")


def resolve_people(
    notes: DataFrame, titles: DataFrame, requests: DataFrame, config: NoteConfig = DEFAULT
) -> DataFrame:
    """(name, path, confidence, company, org, customers) for requested names."""
    front = F.col("frontmatter")
    people = under(notes, config.people_root).select(
        "path",
        fm.strings(front, "customers").alias("customers"),
        F.coalesce(fm.text(front, "company"), F.lit("")).alias("company"),
        F.coalesce(fm.scalar_text(front, "org"), F.lit("customer")).alias("org"),
    )
    wanted = requests.select("name").distinct().withColumns(
        {
            "_file": F.concat(F.lit(config.people_root), F.col("name"), F.lit(".md")),
            "_key": F.lower("name"),
        }
    )
    exact = people.select(F.col("path").alias("_file"), F.lit(True).alias("_exact"))
    titled = titles.select(F.col("key").alias("_key"), F.col("path").alias("_titled")).where(
        F.startswith(F.col("_titled"), F.lit(config.people_root))
    )
    picked = (
        wanted.join(exact, "_file", "left")
        .join(titled, "_key", "left")
        .select(
            "name",
            F.when(F.col("_exact"), F.col("_file")).otherwise(F.col("_titled")).alias("path"),
            F.when(F.col("_exact"), "exact")
            .when(F.col("_titled").isNotNull(), "fuzzy")
            .otherwise("unresolved")
            .alias("confidence"),
        )
    )
    empty = F.array().cast("array<string>")
    return picked.join(people, "path", "left").select(
        "name",
        "path",
        "confidence",
        "company",
        "org",
        F.when(F.col("confidence") != "unresolved", F.coalesce("customers", empty)).alias("customers"),
    )


def resolve_people_summary(resolved: DataFrame) -> DataFrame:
    """(policy, people): use the exact, confirm the fuzzy, skip the rest."""
    policy = (
        F.when(F.col("confidence") == "exact", "auto_use")
        .when(F.col("confidence") == "fuzzy", "needs_confirmation")
        .otherwise("skipped")
    )
    return resolved.groupBy(policy.alias("policy")).agg(F.count(F.lit(1)).alias("people"))
