import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteframe.functions import frontmatter as fm
from noteframe.functions import markdown as md
from noteframe.operators import parse as P


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_titles_tags_and_errors(garden, garden_raw):
    titles = as_dict(garden.notes, "path", "title")
    assert titles["Customers/Fern Ltd/Fern Ltd.md"] == "Fern Limited"
    assert titles["Meetings/undated.md"] == "undated"
    assert titles["plain.txt"] == "plain"
    assert "broken.md" not in titles
    assert [r.path for r in P.note_errors(garden_raw).collect()] == ["broken.md"]
    tags = as_dict(garden.notes, "path", "tags")
    assert tags["Customers/Fern Ltd/Fern Ltd.md"] == ["customer", "Retail", "greenhouse"]
    assert tags["Customers/Moor.md"] == ["customer"]
    assert tags["plain.txt"] == ["inline-tag"]


def test_sections_keep_first_place_and_last_content(spark):
    body = "lead\n# One\na\n## Two\nb\n#\tThree \nc\n## One\nlast\n##nope\n"
    notes = spark.createDataFrame([("x.md", body)], "path string, body string")
    rows = P.note_sections(notes).orderBy("ordinal").collect()
    assert [(r.ordinal, r.level, r.heading, r.content) for r in rows] == [
        (0, 2, "One", "last\n##nope"), (1, 2, "Two", "b"), (2, 1, "Three", "c"),
    ]


def test_windows_line_ends_and_empty_frontmatter(spark):
    raw = spark.createDataFrame(
        [("a.md", "---\r\n---\r\n# T\r\n## H\r\nx\r\n"), ("b.md", "---\nno end"), ("c.md", "---\nn: 1\n---")],
        "path string, raw string",
    ).withColumn("mtime", F.lit(None).cast("timestamp"))
    rows = {r.path: r for r in P.parse_notes(raw).collect()}
    assert rows["a.md"].title == "T" and rows["a.md"].headings == ["H"]
    assert rows["b.md"].body == "---\nno end"
    assert rows["c.md"].body == "" and rows["c.md"].title == "c"


def test_tasks(garden):
    rows = garden.tasks.where("path = 'Meetings/2024-05-20-fern.md'").orderBy("ordinal").collect()
    assert [(r.done, r.text, r.assignee) for r in rows] == [
        (False, "Call back", None), (False, "Send plan [[Ida Moss]]", "Ida Moss"), (True, "Done thing", None),
    ]


def test_read_sections_lists_headings_on_a_miss(spark, garden):
    path = "Customers/Fern Ltd/Fern Ltd.md"
    wanted = spark.createDataFrame([(path, "Connect Hooks"), (path, "Zoo"), ("no.md", "X")], "path string, heading string")
    rows = {(r.path, r.heading): r for r in P.read_sections(garden.notes, wanted).collect()}
    assert rows[(path, "Connect Hooks")].content == "- hook text"
    assert rows[(path, "Connect Hooks")].ref == path + "#Connect Hooks"
    miss = rows[(path, "Zoo")]
    assert miss.status == "NOT_FOUND" and miss.available_headings[:3] == ["Fern Limited", "Team", "Opportunities"]
    assert rows[("no.md", "X")].status == "NOT_FOUND"


def test_line_parsers(spark):
    guid = "01234567-89AB-cdef-0123-456789abcdef"
    lines = [
        f"- Roof (`opportunityid: {guid}`)", f"* [x] Pump `{guid}`", "- Bare name", f"see {guid} here", "no list line",
        f"text - Deal ({guid})",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r[0] for r in df.select(md.opportunity(F.col("line"))).collect()]
    assert [g and (g["name"], g["guid"]) for g in got] == [
        ("Roof", guid), ("Pump", guid), ("Bare name", None), (f"see {guid} here", guid), None, ("text Deal", guid),
    ]
    lines = ["- Go live (MS-77)", "- Milestone #5 done", f"x milestoneid: {guid}", "- Plain", "free text", "M milestone 9"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r[0] for r in df.select(md.milestone(F.col("line"))).collect()]
    assert [g and (g["name"], g["id"], g["number"]) for g in got] == [
        ("Go live", None, "77"), ("Milestone #5 done", None, "5"), (f"x milestoneid: {guid}", guid, None),
        ("Plain", None, None), None, ("M milestone 9", None, "9"),
    ]
    lines = ["- [[Al]] — Boss", "- Bea (Dev)", "- Cy - Ops", "* Dee", "| Eve | CSA |", "- Jean-Luc - Pilot"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r[0] for r in df.select(md.member(F.col("line"))).collect()]
    assert [g and (g["name"], g["role"]) for g in got] == [
        ("Al", "Boss"), ("Bea", "Dev"), ("Cy", "Ops"), ("Dee", None), None, ("Jean", "Luc - Pilot"),
    ]


def test_wikilinks_and_words(spark):
    body = "[[A]] [[A|x]] [[ B #sec]] [[C#d|e]] [[]] [no] [[Deep/Path]]\u00a0end 42"
    df = spark.createDataFrame([(body,)], "b string")
    row = df.select(md.wikilinks(F.col("b")).alias("l"), md.word_count(F.lit("a\u00a0b \n c")).alias("n")).first()
    assert row.l == ["A", "B", "C", "Deep/Path"]
    assert row.n == 3


VALUE = st.one_of(
    st.integers(-10**6, 10**6).map(str),
    st.decimals(-1000, 1000, places=2).map(str),
    st.sampled_from(["true", "false", "null", "Null", "yes", "No", "on", "~", "2024-01-02", "0x1f", "017", "1_000", "1e3", ".5"]),
    st.from_regex(r"\A[A-Za-z][A-Za-z0-9 _./-]{0,12}\Z"),
    st.from_regex(r'\A"[^"\\\n]{0,10}"\Z'),
    st.lists(st.sampled_from(["one", "two-2", "5-low", "null", "3", '"q"', "a b"]), min_size=1, max_size=4).map(
        lambda v: "[" + ", ".join(v) + "]"
    ),
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", "key-x", "null", "Z_9"]), VALUE), min_size=1, max_size=5), min_size=1, max_size=8))
def test_flat_frontmatter_reads_like_yaml(spark, blocks):
    """A comment line sends a block through the full parser; both must agree."""
    texts = ["\n".join(f"{k}: {v}" for k, v in block) for block in blocks]
    df = spark.createDataFrame([(t, t + "\n# comment") for t in texts], "plain string, commented string")
    rows = df.select(fm.yaml_to_json(F.col("plain")).alias("p"), fm.yaml_to_json(F.col("commented")).alias("c")).collect()
    for text, row in zip(texts, rows):
        assert (row.p is None) == (row.c is None), text
        if row.p is not None:
            assert json.loads(row.p) == json.loads(row.c), text


def test_fields_are_searchable_text(garden):
    rows = {(r.key, r.value) for r in garden.fields.where("path LIKE '%Fern Ltd.md'").collect()}
    assert ("tags", "retail") in rows and ("vip", "true") in rows and ("priority", "3") in rows
    assert ("msx", '{"accountid":"m-9"}') in rows


def test_customer_of(spark):
    df = spark.createDataFrame([("Customers/A b/A b.md",), ("Customers/C.md",), ("Customers/D/x/y.md",)], "p string")
    assert [r[0] for r in df.select(md.customer_of(F.col("p"), "Customers/")).collect()] == ["A b", "C", "D"]


def test_frontmatter_is_parsed_once(garden_raw):
    """The filter on broken blocks does not call Python a second time."""
    notes = P.parse_notes(garden_raw.select("path", "raw", "mtime", "length").unionByName(garden_raw))
    assert notes._jdf.queryExecution().executedPlan().toString().count("+- ArrowEvalPython") == 1
