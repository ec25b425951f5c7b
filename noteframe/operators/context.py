"""Assembled views: customer context, person context, id bundles, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.config import DEFAULT, NoteConfig
from noteframe.functions import frontmatter as fm
from noteframe.operators import entities as E
from noteframe.operators import people as P
from noteframe.operators.links import backlinks
from noteframe.operators.skew import paged_collect
from noteframe.plans.tables import NoteTables

PARTS = {
    "brief": ("note", "opportunity", "milestone", "team", "person", "meeting", "open_item", "count"),
    "full": ("note", "opportunity", "milestone", "team", "insight", "hook", "person", "meeting", "open_item", "similar"),
}
PARTS["write"] = PARTS["full"] + ("target",)


def _rows(df: DataFrame, part: str, key: Column | str, label: Column | str, detail: Column | str) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(
        "customer",
        F.lit(part).alias("part"),
        text(key).alias("key"),
        text(label).alias("label"),
        text(detail).alias("detail"),
    )


def customer_context(
    t: NoteTables,
    requests: DataFrame | None,
    as_of: str,
    lookback_days: int = 90,
    include_similar: bool = False,
    include_open_items: bool = True,
    view: str = "full",
    assignee: str | None = None,
) -> DataFrame:
    """(customer, part, key, label, detail): everything known about each customer.

    One row per deal, milestone, member, insight, person, meeting and open task.
    Rows rather than one nested record, so a customer with any number of
    meetings or tasks stays spread over tasks; :func:`nest_context` nests them.
    ``requests`` (customer) picks customers, None takes all; customers without a
    note give no rows. ``brief`` shows counts in place of
    insights, hooks and similar customers; ``write`` adds the write targets.
    """
    notes, cfg = t.notes, t.config
    main = E.customer_base(notes, requests, cfg)
    known = main.select("customer")
    hooks = main.select("customer", "path", E.section("Connect Hooks").alias("_hooks")).where(F.col("_hooks") != "")
    makers = {
        "note": lambda: _rows(main, "note", "path", "title", F.to_json("frontmatter")),
        "opportunity": lambda: _rows(
            E.opportunities(notes, cfg, main), "opportunity", F.concat_ws("#", "path", "ordinal"), "name", "guid"
        ),
        "milestone": lambda: _rows(
            E.milestones(notes, cfg, main),
            "milestone", F.concat_ws("#", "path", "ordinal"), "name", F.coalesce("id", "number"),
        ),
        "team": lambda: _rows(E.team_members(notes, cfg, main=main), "team", "ordinal", "name", "role"),
        "insight": lambda: _rows(
            E.insights(notes, 2, cfg, main), "insight", F.concat_ws("#", "source", "ordinal"), "entry", F.lit(None)
        ),
        "hook": lambda: _rows(hooks, "hook", "path", "_hooks", F.lit(None)),
        "person": lambda: _rows(P.linked_people(notes, known, cfg), "person", "path", "title", F.lit(None)),
        "meeting": lambda: _rows(
            P.customer_meetings(notes, known, as_of, lookback_days, cfg, main), "meeting", "path", "title", "date"
        ),
    }
    if include_open_items:
        makers["open_item"] = lambda: _rows(
            P.open_items(notes, t.links, t.tasks, known, as_of, assignee, cfg, main),
            "open_item", F.concat_ws("#", "path", "ordinal"), "text", "assignee",
        )
    if include_similar:
        makers["similar"] = lambda: _rows(
            E.similar_customers(notes, known, cfg), "similar", "path", "title", "shared_tags"
        )
    if view == "brief":
        total = lambda df, name: df.groupBy("customer").agg(F.count(F.lit(1)).alias("_n")).select(
            "customer", F.lit(name).alias("_name"), "_n"
        )
        counts = [total(E.insights(notes, 2, cfg, main), "agent_insights"), total(hooks, "connect_hooks")]
        if include_similar:
            counts.append(total(E.similar_customers(notes, known, cfg), "similar_customers"))
        makers["count"] = lambda: _rows(reduce(DataFrame.union, counts), "count", "_name", "_name", "_n")
    if view == "write":
        goals = F.array(
            F.struct(F.lit("customer_note").alias("k"), F.col("path").alias("v")),
            F.struct(F.lit("meetings_root").alias("k"), F.lit(cfg.meetings_root).alias("v")),
            *[
                F.struct(F.lit(name).alias("k"), F.lit(heading).alias("v"))
                for name, heading in (
                    ("agent_insights", "Agent Insights"), ("connect_hooks", "Connect Hooks"), ("team", "Team"),
                )
            ],
        )
        makers["target"] = lambda: _rows(
            main.select("customer", F.inline(goals)), "target", "k", "v", F.lit(None)
        )
    return reduce(DataFrame.union, [makers[p]() for p in PARTS[view] if p in makers])


def nest_context(rows: DataFrame, page_rows: int = 1_000) -> DataFrame:
    """(customer, part, page, items): context rows as sorted arrays of structs."""
    item = F.struct("key", "label", "detail")
    return paged_collect(rows, ["customer", "part"], item, ["key", "label"], page_rows)


def person_context(t: NoteTables, requests: DataFrame) -> DataFrame:
    """(name, part, key, label): profile fields, customers, meetings and backlinks.

    Names without a note give no rows.
    """
    notes, cfg = t.notes, t.config
    front = F.col("frontmatter")
    path = F.concat(F.lit(cfg.people_root), F.col("name"), F.lit(".md"))
    wanted = requests.select("name").distinct().withColumn("path", path)
    known = wanted.join(
        E.under(notes, cfg.people_root).select("path", "frontmatter"), "path"
    )
    profile = known.select(
        "name",
        F.explode(
            F.create_map(
                F.lit("path"), F.col("path"),
                F.lit("company"), fm.text(front, "company"),
                F.lit("org"), fm.scalar_text(front, "org"),
                F.lit("email"), fm.text(front, "email"),
                F.lit("teams_id"), fm.text(front, "teams_id"),
            )
        ).alias("key", "label"),
    ).where(F.col("label").isNotNull())
    customers = known.select("name", F.posexplode(fm.strings(front, "customers")).alias("pos", "label"))
    tags = known.select("name", F.posexplode(fm.strings(front, "tags")).alias("pos", "label"))
    meetings = P.meetings_for_person(notes, t.links, known, cfg)
    back = backlinks(t.links, notes, known).join(
        known.select(F.col("path").alias("seed"), "name"), "seed"
    )
    part = lambda df, name, key, label: df.select("name", F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"))
    return reduce(
        DataFrame.union,
        [
            part(profile, "profile", "key", "label"),
            part(tags, "tag", "pos", "label"),
            part(customers, "customer", "pos", "label"),
            part(meetings, "meeting", "path", "title"),
            part(back, "backlink", "path", "title"),
        ],
    )


def prefetch_ids(notes: DataFrame, requests: DataFrame | None = None, config: NoteConfig = DEFAULT) -> DataFrame:
    """(customer, kind, value): account ids, deal ids, milestone ids and numbers, team."""
    main = E.customer_base(notes, requests, config)
    front = F.col("frontmatter")
    # Nested id object and key spellings (fixed values).
    nested = fm.value(front, "MSX")
    inner = lambda key: fm.string_only(F.try_variant_get(nested, f"$.{key}", "variant"))
    tpid = F.coalesce(fm.text(front, "tpid"), inner("tpid"))
    account = F.coalesce(
        fm.text(front, "accountid"), fm.text(front, "accountId"), inner("accountId"), inner("accountid")
    )
    row = lambda df, kind, value: df.select(
        "customer", F.lit(kind).alias("kind"), value.alias("value")
    ).where(F.col("value").isNotNull())
    deals, steps = E.opportunities(notes, config, main), E.milestones(notes, config, main)
    return reduce(
        DataFrame.union,
        [
            row(main, "tpid", tpid),
            row(main, "accountid", account),
            row(deals, "opportunity_guid", F.nullif(F.col("guid"), F.lit(""))),
            row(steps, "milestone_id", F.nullif(F.col("id"), F.lit(""))),
            row(steps, "milestone_number", F.nullif(F.col("number"), F.lit(""))),
            row(E.team_members(notes, config, main=main), "team_member", F.col("name")),
        ],
    )


def prefetch_filters(ids: DataFrame, page_rows: int = 1_000) -> DataFrame:
    """(customer, page, opportunity_filter, account_filter) for remote queries.

    One row per customer; one with more than ``page_rows`` deals gets further
    pages. The account filter uses the tpid.
    """
    deals = ids.where(F.col("kind") == "opportunity_guid")
    # Field names of the remote filter language (fixed values).
    term = F.format_string("_msp_opportunityid_value eq '%s'", F.col("value"))
    pages = paged_collect(deals, ["customer"], term, ["value"], page_rows).select(
        "customer", "page", F.array_join("items", " or ").alias("opportunity_filter")
    )
    account = ids.where(F.col("kind") == "tpid").select(
        "customer",
        F.lit(0).alias("page"),
        F.format_string("_msp_accountid_value eq '%s'", F.col("value")).alias("account_filter"),
    )
    return pages.join(account, ["customer", "page"], "full").select(
        "customer", "page", "opportunity_filter", "account_filter"
    )


def drift_snapshot(notes: DataFrame, requests: DataFrame | None = None, config: NoteConfig = DEFAULT) -> DataFrame:
    """(customer, kind, item_key, name, state): what the notes say, ready to compare."""
    main = E.customer_base(notes, requests, config)
    row = lambda df, kind, key, name, state: df.select(
        "customer", F.lit(kind).alias("kind"), key.alias("item_key"), name.alias("name"), state.alias("state")
    )
    deals, steps = E.opportunities(notes, config, main), E.milestones(notes, config, main)
    team = E.team_members(notes, config, ("Team",), main)
    last = E.last_insight_date(notes, config, main)
    name = F.col("name")
    return reduce(
        DataFrame.union,
        [
            row(deals, "opportunity", F.coalesce("guid", "name"), name, F.coalesce("stage", "status")),
            row(steps, "milestone", F.coalesce("id", "number", "name"), name, F.col("status")),
            row(team, "team", name, name, F.col("role")),
            row(last, "last_insight", F.lit("date"), F.lit("date"), F.col("last_insight_date")),
            row(main, "frontmatter", F.lit("frontmatter"), F.col("path"), F.to_json("frontmatter")),
        ],
    )


def drift(snapshot: DataFrame, external: DataFrame) -> DataFrame:
    """(customer, kind, item_key, change, note_state, external_state).

    ``external`` is (customer, kind, item_key, state). ``missing`` is known only
    outside, ``new`` only in the notes, ``changed`` in both with another state.
    """
    keys = ["customer", "kind", "item_key"]
    ours = snapshot.groupBy(*keys).agg(F.max("state").alias("note_state"), F.lit(True).alias("_a"))
    theirs = external.groupBy(*keys).agg(F.max("state").alias("external_state"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_b").isNull(), "new")
        .when(~F.col("note_state").eqNullSafe(F.col("external_state")), "changed")
        .otherwise("same")
    )
    return ours.join(theirs, keys, "full").select(*keys, change.alias("change"), "note_state", "external_state")
