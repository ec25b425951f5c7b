import pytest
from pyspark.sql import functions as F

from noteframe.operators import context as C
from noteframe.operators import correlate as R
from noteframe.operators import entities as E
from noteframe.operators import health as H
from noteframe.operators import people as P

AS_OF = "2024-06-01"
FERN = "Customers/Fern Ltd/Fern Ltd.md"


def names(spark, *values, column="customer"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_customers(spark, garden):
    assert {r.customer for r in E.customer_roster(garden.notes).collect()} == {"Fern Ltd", "Moor"}
    got = {r.customer: (r.path, r.layout) for r in E.customer_paths(garden.notes, names(spark, "Fern Ltd", "Moor", "New")).collect()}
    assert got == {
        "Fern Ltd": (FERN, "nested"), "Moor": ("Customers/Moor.md", "flat"), "New": ("Customers/New/New.md", "none"),
    }
    flat = E.flat_customers(garden.notes).first()
    assert (flat.customer, flat.expected_path) == ("Moor", "Customers/Moor/Moor.md")


def test_sub_notes_win_over_the_section(garden):
    deals = E.opportunities(garden.notes).collect()
    assert [(r.name, r.status) for r in deals] == [("Roof deal", "open")]
    assert {(r.name, r.number) for r in E.milestones(garden.notes).collect()} == {("Phase one", "12"), ("Plain goal", None)}
    assert [r.name for r in E.team_members(garden.notes).orderBy("ordinal").collect()] == ["Ida Moss", "Bo Reed"]


def test_latest_insight_notes(garden):
    got = E.insights(garden.notes).orderBy("source", "ordinal").collect()
    assert [(r.entry, r.partitioned) for r in got] == [("first", True), ("second", True), ("third", True)]
    stale = E.stale_insights(garden.notes, AS_OF).collect()
    assert [(r.date, r.age_days) for r in stale] == [("2024-01-05", 148)]
    last = {r.customer: r.last_insight_date for r in E.last_insight_date(garden.notes).collect()}
    assert last == {"Fern Ltd": "2024-05-28", "Moor": None}


def test_tpid_text_only(spark, garden):
    got = {r.name: (r.customer, r.status) for r in E.resolve_tpid(garden.notes, names(spark, "771200", "5555", "Moor", column="name")).collect()}
    assert got == {"771200": ("Fern Ltd", "OK"), "5555": (None, "NOT_FOUND"), "Moor": ("Moor", "OK")}


def test_similar_counts_and_listing_agree(spark, garden):
    counts = {r.customer: r.similar_count for r in E.similar_counts(garden.notes).collect()}
    listed = E.similar_customers(garden.notes, names(spark, *counts)).groupBy("customer").count()
    assert counts == {"Fern Ltd": 1, "Moor": 1}
    assert {r.customer: r["count"] for r in listed.collect()} == counts


@pytest.mark.parametrize("subset_tags", [10, 2, 0])
def test_similar_counts_match_brute_force(spark, subset_tags):
    sets = [["a"], ["a", "b"], ["b", "c", "d"], ["e"], [], ["a", "b"], ["d", "e", "f", "g"], ["h"], ["c"]]
    rows = [(f"Customers/C{i}.md", f"C{i}", tags, "") for i, tags in enumerate(sets)]
    notes = spark.createDataFrame(rows, "path string, title string, tags array<string>, body string")
    want = {
        f"C{i}": sum(j != i and bool(set(tags) & set(other)) for j, other in enumerate(sets)) for i, tags in enumerate(sets)
    }
    assert {r.customer: r.similar_count for r in E.similar_counts(notes, subset_tags=subset_tags).collect()} == want


@pytest.mark.parametrize("subset_tags", [10, 2])
def test_similar_counts_of_many_tags_move_no_bitmap_per_tag(spark, monkeypatch, subset_tags):
    sets = [sorted({f"t{(i * j) % 41}" for j in range(1, 3 + i % 14)}) for i in range(120)]
    rows = [(f"Customers/C{i}.md", f"C{i}", tags, "") for i, tags in enumerate(sets)]
    notes = spark.createDataFrame(rows, "path string, title string, tags array<string>, body string").repartition(5)
    want = {f"C{i}": sum(j != i and bool(set(tags) & set(o)) for j, o in enumerate(sets)) for i, tags in enumerate(sets)}
    for group, share in ((E.BITMAP_GROUP, E.SET_SHARE), (1, 7)):
        monkeypatch.setattr(E, "BITMAP_GROUP", group)
        monkeypatch.setattr(E, "SET_SHARE", share)
        counts = E.similar_counts(notes, subset_tags=subset_tags)
        assert {r.customer: r.similar_count for r in counts.collect()} == want
        plan = counts._jdf.queryExecution().executedPlan().toString()
        # Neither a bitmap for each tag of each set is sorted, nor a table keyed by whole tag lists sent to every task.
        assert "bitmap_or_agg" not in plan and "BroadcastHashJoin [_set" not in plan


def test_meetings(spark, garden):
    both = names(spark, "Fern Ltd", "Moor")
    got = {(r.customer, r.path) for r in P.recent_meetings(garden.notes, both, AS_OF).collect()}
    assert got == {("Fern Ltd", "Meetings/2024-05-20-fern.md"), ("Moor", "Meetings/undated.md")}
    listed = P.frontmatter_meetings(garden.notes, AS_OF).collect()
    assert [(r.path, r.title) for r in listed] == [("Meetings/2024-05-20-fern.md", "2024-05-20-fern")]
    chosen = {(r.customer, r.title) for r in P.customer_meetings(garden.notes, both, AS_OF).collect()}
    assert chosen == {("Fern Ltd", "2024-05-20-fern"), ("Moor", "undated")}
    person = P.meetings_for_person(garden.notes, garden.links, names(spark, "Bo Reed", "Ida Moss", column="name")).collect()
    assert {(r.name, r.path) for r in person} == {("Bo Reed", "Meetings/2024-05-20-fern.md"), ("Ida Moss", "Meetings/2024-05-20-fern.md")}


def test_open_items(spark, garden):
    ask = lambda who=None: {
        (r.customer, r.text)
        for r in P.open_items(garden.notes, garden.links, garden.tasks, names(spark, "Fern Ltd", "Moor"), AS_OF, who).collect()
    }
    assert ask() == {
        ("Fern Ltd", "Order seeds @bo"), ("Fern Ltd", "Call back"), ("Fern Ltd", "Send plan [[Ida Moss]]"), ("Moor", "Undated task"),
    }
    assert ask("BO") == {("Fern Ltd", "Order seeds @bo")}


def test_orphans_strict_and_default(spark, garden):
    assert {r.path for r in P.orphaned_meetings(garden.notes, garden.links).collect()} == {"Meetings/lost.md"}
    assert {r.path for r in P.orphaned_meetings(garden.notes, garden.links, True).collect()} == {"Meetings/lost.md"}


def test_resolve_people(spark, garden):
    got = {r.name: (r.confidence, r.org, r.customers) for r in P.resolve_people(garden.notes, garden.titles, names(spark, "Ida Moss", "BO REED", "Who", column="name")).collect()}
    assert got == {
        "Ida Moss": ("exact", "internal", ["fern ltd"]), "BO REED": ("fuzzy", "customer", []), "Who": ("unresolved", None, None),
    }


def test_health(garden):
    rows = {r.customer: r for r in H.customer_freshness(garden.notes, AS_OF).collect()}
    fern, moor = rows["Fern Ltd"], rows["Moor"]
    assert (fern.stale_insights, fern.opportunities, fern.with_guid, fern.milestones, fern.with_id) == (1, 1, 1, 2, 1)
    assert fern.has_team and fern.has_connect_hooks and fern.last_validated == "2024-05-01"
    assert not moor.has_team and moor.milestones == 0
    report = H.health_report(garden.notes, garden.links, AS_OF).first()
    assert (report.total_customers, report.orphaned_meetings, report.structural_issues, report.issues) == (2, 1, 1, 4)
    assert not report.healthy


def test_health_filter_ignores_case(spark, garden):
    assert [r.customer for r in H.customer_freshness(garden.notes, AS_OF, names(spark, "fern LTD", "none")).collect()] == ["Fern Ltd"]


def test_context_views(spark, garden):
    full = C.customer_context(garden, names(spark, "Fern Ltd"), AS_OF, include_similar=True)
    parts = {}
    for r in full.collect():
        parts.setdefault(r.part, []).append(r.label)
    assert sorted(parts["open_item"]) == ["Call back", "Order seeds @bo", "Send plan [[Ida Moss]]"]
    assert parts["similar"] == ["Moor"] and parts["hook"] == ["- hook text"] and parts["person"] == ["Ida Moss"]
    assert len(parts["milestone"]) == 2 and parts["note"] == ["Fern Limited"]
    brief = C.customer_context(garden, names(spark, "Fern Ltd"), AS_OF, view="brief")
    assert {(r.key, r.detail) for r in brief.where("part = 'count'").collect()} == {("agent_insights", "3"), ("connect_hooks", "1")}
    write = C.customer_context(garden, names(spark, "Fern Ltd"), AS_OF, view="write").where("part = 'target'")
    assert {r.key for r in write.collect()} == {"customer_note", "meetings_root", "agent_insights", "connect_hooks", "team"}
    nested = C.nest_context(full).where("part = 'open_item'").first()
    assert [i.label for i in nested["items"]] == ["Order seeds @bo", "Call back", "Send plan [[Ida Moss]]"]
    assert C.customer_context(garden, names(spark, "Nobody"), AS_OF).count() == 0


def test_person_context(spark, garden):
    rows = C.person_context(garden, names(spark, "Ida Moss", "Ghost", column="name")).collect()
    got = {(r.part, r.key, r.label) for r in rows}
    assert ("profile", "company", "Peat") in got and ("customer", "0", "fern ltd") in got
    assert ("backlink", "Customers/Moor.md", "Moor") in got and {r.name for r in rows} == {"Ida Moss"}


def test_prefetch_and_drift(spark, garden):
    ids = C.prefetch_ids(garden.notes)
    got = {(r.customer, r.kind, r.value) for r in ids.collect()}
    assert ("Fern Ltd", "tpid", "771200") in got and ("Fern Ltd", "accountid", "M-9") in got
    assert ("Fern Ltd", "milestone_number", "12") in got
    row = C.prefetch_filters(ids).first()
    assert row.opportunity_filter == "_msp_opportunityid_value eq 'aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee'"
    external = spark.createDataFrame(
        [("Fern Ltd", "milestone", "12", None), ("Fern Ltd", "team", "Bo Reed", "Boss"), ("Fern Ltd", "team", "Zed", "x")],
        "customer string, kind string, item_key string, state string",
    )
    change = {(r.kind, r.item_key): r.change for r in C.drift(C.drift_snapshot(garden.notes), external).collect() if r.customer == "Fern Ltd"}
    assert change[("milestone", "12")] == "same" and change[("team", "Bo Reed")] == "changed"
    assert change[("team", "Zed")] == "missing" and change[("team", "Ida Moss")] == "new"


def test_correlation(spark, garden):
    entities = spark.createDataFrame(
        [
            (1, "Ida Moss", "person", None), (2, "Stranger", "person", None), (3, "Fern Ltd", "customer", None),
            (4, "fern limited", "customer", None), (5, "Review", "meeting", "2024-05-20"), (6, "moor", "meeting", "2024-05-20"),
            (7, "roof", "opportunity", None), (8, "AAAAAAAA-bbbb-cccc-dddd-eeeeeeeeeeee", "opportunity", None),
            (9, "moor visit", "other", None), (10, "nothing", "other", None),
        ],
        "entity_id int, name string, type string, date string",
    )
    matches = R.correlate(garden.notes, garden.links, garden.titles, entities)
    got = {}
    for r in matches.collect():
        got.setdefault(r.entity_id, set()).add((r.kind, r.value, r.confidence))
    assert got[1] == {("note", "People/Ida Moss.md", "exact"), ("customer", "fern ltd", "exact"), ("customer", "Fern Ltd", "exact")}
    assert got[3] == {("note", FERN, "exact"), ("customer", "Fern Ltd", "exact")}
    assert got[4] == {("note", FERN, "fuzzy"), ("customer", "fern limited", "fuzzy")}
    assert got[5] == {("note", "Meetings/2024-05-20-fern.md", "fuzzy"), ("customer", "Fern Ltd", "fuzzy")}
    assert got[6] == {("note", "Meetings/undated.md", "fuzzy"), ("customer", "Moor", "fuzzy")}
    assert got[7] == got[8] == {("note", FERN, "exact"), ("customer", "Fern Ltd", "exact")}
    assert got[9] == {("note", "Meetings/2019-01-01-moor.md", "exact")}
    conf = R.correlate_confidence(matches, entities)
    assert {r.entity_id for r in conf.where("confidence = 'unresolved'").collect()} == {2, 10}
    ranged = R.correlate_meeting(garden.notes, entities, ("2019-01-01", "2019-12-31")).where("kind = 'note' AND entity_id = 6")
    assert {r.value for r in ranged.collect()} == {"Meetings/2019-01-01-moor.md", "Meetings/undated.md"}


def test_unknown_view(spark, garden):
    with pytest.raises(KeyError):
        C.customer_context(garden, names(spark, "Fern Ltd"), AS_OF, view="odd")


def test_meetings_meet_a_pattern_of_many_dates_once(spark, garden):
    days = [(f"d{i}", "fern", "meeting", f"2024-05-{i + 1:02d}") for i in range(28)] + [("any", "FERN", "meeting", None), ("m", "moor", "meeting", "2019-01-01")]
    entities = spark.createDataFrame(days, "entity_id string, name string, type string, date string")
    matches = R.correlate_meeting(garden.notes, entities)
    got = {(r.entity_id, r.value) for r in matches.where("kind = 'note'").collect()}
    fern = "Meetings/2024-05-20-fern.md"
    assert got == {("d19", fern), ("any", fern), ("m", "Meetings/2019-01-01-moor.md"), ("m", "Meetings/undated.md")}
    # Entities come in by pattern and date together, never as a row for every text and date.
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert "(_date#" in plan and "Join Inner, ((pattern#" in plan


def test_undated_meetings_of_many_dates_are_dealt_and_found_once(spark, monkeypatch):
    rows = [(f"Meetings/m{k}.md", f"Plan {k}", f"Plan {k % 4}" if k % 3 else None, f"2024-01-{k % 28 + 1:02d}" if k % 2 else None) for k in range(60)]
    notes = spark.createDataFrame(rows, "path string, title string, customer string, date string").selectExpr(
        "path", "title", "parse_json(to_json(struct(customer, date))) AS frontmatter"
    )
    asked = [(f"e{d % 30}", "PLAN", "meeting", f"2024-01-{d:02d}") for d in range(1, 29)] + [("e1", "plan", "meeting", None), ("e2", "plan 1", "meeting", None), ("e3", " ", "meeting", None)]
    entities = spark.createDataFrame(asked, "entity_id string, name string, type string, date string")
    want = {
        (e, kind, value)
        for e, name, _, on in asked if name.strip()
        for path, title, customer, date in rows
        if (date is None or on is None or date == on) and any(name.lower() in (t or "").lower() for t in (title, customer))
        for kind, value in (("note", path), ("customer", customer)) if value
    }
    monkeypatch.setattr(R, "HIT_ROWS", 100)
    found = R.correlate_meeting(notes, entities)
    got = [(r.entity_id, r.kind, r.value) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = found.where("kind = 'note'").select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert sizes < len([g for g in got if g[1] == "note"]) / 4
