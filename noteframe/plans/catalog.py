"""Registered queries with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.functions import frontmatter as fm
from noteframe.functions import markdown as md
from noteframe.operators import context as C
from noteframe.operators import correlate as R
from noteframe.operators import edits as X
from noteframe.operators import entities as E
from noteframe.operators import health as H
from noteframe.operators import incremental as I
from noteframe.operators import links as L
from noteframe.operators import parse as P
from noteframe.operators import people as W
from noteframe.operators import predicate as Q
from noteframe.operators import search as S
from noteframe.operators import stats as A
from noteframe.operators import token_index as T
from noteframe.operators import validate as V
from noteframe.plans import bindings as B
from noteframe.plans.oracle import AS_OF as DAY
from noteframe.plans.oracle import with_prelude
from noteframe.session import fresh_path
from noteframe.sources import audit, files, snapshots
from noteframe.streaming import changes, watch

AS_OF = B.AS_OF


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        CATALOG[name] = Query(run, None if sql is None else with_prelude(sql))
        return run

    return keep


def joined(column: str, ordered: bool = False) -> F.Column:
    """An array as one text, sorted unless its order is part of the answer."""
    values = F.col(column) if ordered else F.array_sort(column)
    return F.array_join(values, ",").alias(column)


def customers_of(t) -> DataFrame:
    return E.customer_notes(t.notes).select("customer")


def people_of(t) -> DataFrame:
    """Every person by file name."""
    return E.under(t.notes, "People/").select(md.stem(F.col("path")).alias("name"))


# Scans and projections -----------------------------------------------------


@query(
    "note_exists",
    """SELECT r.path, n.path IS NOT NULL AS exists FROM (
         SELECT DISTINCT 'Customers/'||n||'.md' AS path FROM cust
         UNION SELECT DISTINCT 'Customers/'||n||'/'||n||'.md' FROM cust) r
       LEFT JOIN notes n ON n.path = r.path""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    name = F.col("customer")
    requests = E.customer_roster(t.notes).select(
        F.explode(
            F.array(
                F.concat(F.lit("Customers/"), name, F.lit(".md")),
                F.concat(F.lit("Customers/"), name, F.lit("/"), name, F.lit(".md")),
            )
        ).alias("path")
    )
    return files.note_exists(t.notes, requests)


@query(
    "list_folder",
    "SELECT path FROM notes WHERE path LIKE 'Customers/%' AND path NOT LIKE 'Customers/%/%'",
)
def _(spark, sf):
    return files.list_folder(B.corpus(spark, sf).notes, "Customers").select("path")


@query("note_titles", "SELECT path, title FROM notes")
def _(spark, sf):
    return B.corpus(spark, sf).notes.select("path", "title")


@query("note_tags", "SELECT path, unnest(tags) AS tag FROM notes")
def _(spark, sf):
    return B.corpus(spark, sf).tags.select("path", "tag")


@query(
    "note_headings",
    """SELECT path, 'Attendees,Discussion,Action Items' AS headings FROM meet
       UNION ALL SELECT c.path, concat_ws(',',
           CASE WHEN t.path IS NOT NULL THEN CASE WHEN k%16=1 THEN 'Key Stakeholders' ELSE 'Team' END END,
           CASE WHEN k%4<>3 THEN 'Opportunities' END, 'Milestones', CASE WHEN k%5<>2 THEN 'Agent Insights' END,
           CASE WHEN k%2=0 THEN 'Connect Hooks' END, CASE WHEN k%3=0 THEN 'Next Steps' END)
         FROM cust c LEFT JOIN (SELECT DISTINCT path FROM team) t ON t.path = c.path""",
)
def _(spark, sf):
    rows = B.corpus(spark, sf).notes.select("path", joined("headings", ordered=True))
    return rows.where("headings <> ''")


@query("wikilinks", "SELECT src AS path, target FROM links")
def _(spark, sf):
    return L.raw_links(B.corpus(spark, sf).notes).select(F.col("src").alias("path"), "target")


@query(
    "hrefs",
    """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages""",
)
def _(spark, sf):
    return B.page_rows(spark, sf).select("page_id", F.explode("hrefs").alias("href"))


@query(
    "top_hrefs",
    """SELECT href, count(*) AS pages FROM (
         SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages)
       GROUP BY href ORDER BY pages DESC, href LIMIT 20""",
)
def _(spark, sf):
    rows = B.page_rows(spark, sf).select(F.explode("hrefs").alias("href"))
    counts = rows.groupBy("href").agg(F.count(F.lit(1)).alias("pages"))
    return counts.orderBy(F.desc("pages"), "href").limit(20)


@query("page_titles", "SELECT page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS title FROM pages")
def _(spark, sf):
    return B.page_rows(spark, sf).select("page_id", "title")


@query(
    "note_sections",
    """SELECT 'conv/'||conv_id||'-'||(turn//50)||'.md' AS path,
         row_number() OVER (PARTITION BY conv_id, turn//50 ORDER BY turn) - 1 AS ordinal,
         2 AS level, 'Turn '||turn||' '||role AS heading, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars
       FROM conversations""",
)
def _(spark, sf):
    rows = P.note_sections(B.conversation_notes(spark, sf))
    return rows.select("path", "ordinal", "level", "heading", F.length("content").alias("chars"))


@query(
    "word_counts",
    r"""SELECT source||'/'||doc_id||'.md' AS path,
         len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count FROM documents""",
)
def _(spark, sf):
    notes = B.document_notes(spark, sf)
    return notes.select("path", md.word_count(F.col("body")).alias("word_count"))


@query(
    "note_excerpts",
    """SELECT source||'/'||doc_id||'.md' AS path,
         nullif(trim(replace(substring(text, 1, 200), chr(10), ' ')), '') AS excerpt FROM documents""",
)
def _(spark, sf):
    return B.document_notes(spark, sf).select("path", md.excerpt(F.col("body")).alias("excerpt"))


@query(
    "note_snippets",
    "SELECT source||'/'||doc_id||'.md' AS path, substring(text, 1, 10000) AS body_snippet FROM documents",
)
def _(spark, sf):
    return B.document_notes(spark, sf).select("path", md.snippet(F.col("body")).alias("body_snippet"))


@query(
    "note_metadata",
    """SELECT path, path AS ref, title, mtime AS modified_at, epoch_ms(mtime)::DOUBLE AS mtime_ms,
         title||',Attendees,Discussion,Action Items' AS headings FROM meet""",
)
def _(spark, sf):
    notes = B.corpus(spark, sf).notes
    rows = P.note_metadata(notes, E.under(notes, "Meetings/"))
    return rows.select("path", "ref", "title", "modified_at", "mtime_ms", joined("headings", ordered=True))


@query(
    "read_sections",
    """SELECT c.path, 'Connect Hooks' AS heading, c.path||'#Connect Hooks' AS ref,
         CASE WHEN k%2=0 THEN 'OK' ELSE 'NOT_FOUND' END AS status,
         CASE WHEN k%2=0 THEN '- Hook for '||n END AS content,
         CASE WHEN k%2<>0 THEN concat_ws(',', CASE WHEN k%9<>0 THEN n||' Account' END,
           CASE WHEN t.path IS NOT NULL THEN CASE WHEN k%16=1 THEN 'Key Stakeholders' ELSE 'Team' END END,
           CASE WHEN k%4<>3 THEN 'Opportunities' END, 'Milestones', CASE WHEN k%5<>2 THEN 'Agent Insights' END,
           CASE WHEN k%3=0 THEN 'Next Steps' END) END AS available_headings
       FROM cust c LEFT JOIN (SELECT DISTINCT path FROM team) t ON t.path = c.path""",
)
def _(spark, sf):
    notes = B.corpus(spark, sf).notes
    requests = E.customer_notes(notes).select("path", F.lit("Connect Hooks").alias("heading"))
    rows = P.read_sections(notes, requests)
    return rows.select(
        "path", "heading", "ref", "status", "content", joined("available_headings", ordered=True)
    )


@query("action_items", "SELECT path, ordinal, done, text, assignee FROM tasks")
def _(spark, sf):
    return B.corpus(spark, sf).tasks


@query("opportunities", "SELECT customer, path, ordinal, name, guid, status, stage, owner, salesplay, last_validated FROM opp")
def _(spark, sf):
    return E.opportunities(B.corpus(spark, sf).notes)


@query("milestones", "SELECT customer, path, ordinal, name, id, number, status, milestonedate, owner, opportunity FROM ms")
def _(spark, sf):
    return E.milestones(B.corpus(spark, sf).notes)


@query(
    "entities_with_fallback",
    """SELECT customer, 'opportunity' AS kind, count(*) AS items, bool_or(path LIKE '%/opportunities/%') AS from_notes
         FROM opp GROUP BY customer
       UNION ALL
       SELECT customer, 'milestone', count(*), bool_or(path LIKE '%/milestones/%') FROM ms GROUP BY customer""",
)
def _(spark, sf):
    notes = B.corpus(spark, sf).notes

    def total(rows, kind, folder):
        return rows.groupBy("customer").agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("items"),
            F.bool_or(F.contains(F.col("path"), F.lit(folder))).alias("from_notes"),
        )

    return total(E.opportunities(notes), "opportunity", "/opportunities/").union(
        total(E.milestones(notes), "milestone", "/milestones/")
    )


@query(
    "team_members",
    "SELECT customer, path, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS ordinal, name, role FROM team",
)
def _(spark, sf):
    return E.team_members(B.corpus(spark, sf).notes)


@query("recent_insights", "SELECT customer, source, partitioned, ordinal, entry FROM insight")
def _(spark, sf):
    return E.insights(B.corpus(spark, sf).notes)


@query("stale_insights", "SELECT customer, ordinal, text, date, age_days FROM stale")
def _(spark, sf):
    return E.stale_insights(B.corpus(spark, sf).notes, AS_OF)


@query(
    "last_insight_date",
    """SELECT n AS customer, d AS last_insight_date FROM cust
       LEFT JOIN (SELECT customer, max(d) AS d FROM ins_line GROUP BY 1) ON customer = n""",
)
def _(spark, sf):
    return E.last_insight_date(B.corpus(spark, sf).notes)


@query("fm_meetings", "SELECT customer, path, title, date FROM fm_meet")
def _(spark, sf):
    return W.frontmatter_meetings(B.corpus(spark, sf).notes, AS_OF)


@query("customer_meetings", "SELECT customer, path, title, date FROM met")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.customer_meetings(t.notes, customers_of(t), AS_OF)


# Filters and predicates ----------------------------------------------------


def _select(spark, sf, **options):
    return Q.query_notes(B.corpus(spark, sf).notes, Q.QueryOptions(**options)).select("path", "title", joined("tags"))


_TAGS = "array_to_string(list_sort(tags), ',') AS tags"


@query("query_notes_string", f"SELECT path, title, {_TAGS} FROM notes JOIN (SELECT path FROM meet WHERE status='F' UNION ALL SELECT path FROM cust WHERE status='f') USING (path)")
def _(spark, sf):
    return _select(spark, sf, where={"status": "f"})


@query(
    "query_notes_array",
    f"""SELECT path, title, {_TAGS} FROM notes JOIN
        (SELECT w.path FROM works w WHERE w.listed AND w.n = (SELECT min(n) FROM cust WHERE k%15=7)) USING (path)""",
)
def _(spark, sf):
    return _select(spark, sf, where={"customers": "CUSTOMER 000000007"})


@query(
    "query_notes_tags",
    f"SELECT path, title, {_TAGS} FROM notes WHERE list_contains(tags, 'customer') AND list_contains(tags, 'building')",
)
def _(spark, sf):
    return _select(spark, sf, where={"tags": ["Customer", "BUILDING"]})


@query(
    "query_notes_number",
    f"SELECT path, title, {_TAGS} FROM notes JOIN (SELECT path FROM cust WHERE nat=5) USING (path)",
)
def _(spark, sf):
    return _select(spark, sf, where={"priority": 5})


@query(
    "query_notes_boolean",
    f"SELECT path, title, {_TAGS} FROM notes JOIN (SELECT path FROM cust WHERE k%5=0) USING (path)",
)
def _(spark, sf):
    return _select(spark, sf, where={"vip": True})


@query("query_notes_strict", f"SELECT path, title, {_TAGS} FROM notes WHERE false")
def _(spark, sf):
    return _select(spark, sf, where={"priority": "5"})


@query(
    "query_notes_and",
    f"""SELECT path, title, {_TAGS} FROM notes JOIN
        (SELECT path FROM meet WHERE status='O' AND prio='1-urgent') USING (path)""",
)
def _(spark, sf):
    return _select(spark, sf, where={"tags": "meeting"}, all_of=[{"status": "O"}, {"tags": "1-URGENT"}])


@query(
    "query_notes_or",
    f"""SELECT path, title, {_TAGS} FROM notes JOIN
        (SELECT path FROM cust WHERE status='active' AND (nat=3 OR k%5=0)) USING (path)""",
)
def _(spark, sf):
    return _select(spark, sf, where={"status": "active"}, any_of=[{"priority": 3}, {"vip": True}])


@query("query_notes_folder", f"SELECT path, title, {_TAGS} FROM notes WHERE path LIKE 'People/%'")
def _(spark, sf):
    return _select(spark, sf, folder="People/")


@query(
    "query_notes_order",
    f"""SELECT path, title, {_TAGS} FROM notes JOIN meet USING (path, title)
        WHERE date IS NOT NULL AND date <> 'soon' ORDER BY date DESC, path LIMIT 50""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    dated = t.notes.where(fm.text(F.col("frontmatter"), "date") != "soon")
    rows = Q.query_notes(dated, Q.QueryOptions(where={"tags": "meeting"}, order_by="-date", limit=50))
    return rows.select("path", "title", joined("tags"))


@query("query_notes_folder_field", f"SELECT path, title, {_TAGS} FROM notes WHERE path LIKE 'People/%' AND list_contains(tags, 'internal')")
def _(spark, sf):
    return _select(spark, sf, where={"folder": "People/", "tags": "internal"})


@query(
    "query_notes_order_all",
    """SELECT path, row_number() OVER (ORDER BY date IS NOT NULL, try_cast(date AS DATE) NULLS FIRST, path) AS place
       FROM meet""",
)
def _(spark, sf):
    # Missing, malformed and real days of all meetings together, rising.
    found = Q.query_notes(B.corpus(spark, sf).notes, Q.QueryOptions(where={"tags": "meeting"}, order_by="date"))
    return Q.numbered(found.select("path"))


@query("notes_by_folder", "SELECT source||'/'||doc_id||'.md' AS path FROM documents WHERE source = 'src1'")
def _(spark, sf):
    return Q.notes_by_folder(B.document_notes(spark, sf), "src1/").select("path")


@query("notes_by_tag", "SELECT path FROM notes WHERE list_contains(tags, 'internal')")
def _(spark, sf):
    return Q.notes_by_tag(B.corpus(spark, sf).notes, "internal").select("path")


@query(
    "frontmatter_lookup",
    """SELECT path FROM cust WHERE CASE WHEN k%7<>0 THEN (100000+k)::VARCHAR END LIKE '%11%'""",
)
def _(spark, sf):
    return Q.frontmatter_lookup(B.corpus(spark, sf).fields, "TPID", "11")


@query(
    "frontmatter_fields",
    """SELECT 'events/'||event_id||'.md' AS path, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events""",
)
def _(spark, sf):
    return P.note_fields(B.event_notes(spark, sf))


@query(
    "resolve_tpid",
    """SELECT (100000+k)::VARCHAR AS name, CASE WHEN tpid IS NOT NULL THEN n END AS customer,
         CASE WHEN tpid IS NOT NULL THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM cust
       UNION ALL SELECT n, n, 'OK' FROM cust""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    keys = B.table(spark, sf, "customer").select((F.col("c_custkey") + 100000).cast("string").alias("name"))
    names = customers_of(t).select(F.col("customer").alias("name"))
    return E.resolve_tpid(t.notes, keys.union(names))


@query(
    "validate_guids",
    """SELECT customer, name, CASE WHEN guid IS NULL THEN 'guid: not a GUID' END AS reason FROM opp""",
)
def _(spark, sf):
    deals = E.opportunities(B.corpus(spark, sf).notes)
    return V.checked(deals, {"guid": "guid"}).select("customer", "name", "reason")


@query(
    "validate_dates",
    """SELECT path, CASE WHEN date IS NULL OR date = 'soon' THEN 'date: not an ISO date' END AS reason FROM meet""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    rows = E.under(t.notes, "Meetings/").select("path", fm.text(F.col("frontmatter"), "date").alias("date"))
    return V.checked(rows, {"date": "date"}).select("path", "reason")


@query(
    "validate_paths",
    """SELECT page_id, CASE WHEN url = '' THEN 'url: empty path' WHEN starts_with(url, '/') THEN 'url: absolute path'
         WHEN contains(url, '../') THEN 'url: path leaves the root' END AS reason FROM pages""",
)
def _(spark, sf):
    return V.checked(B.table(spark, sf, "pages"), {"url": "path"}).select("page_id", "reason")


@query(
    "validate_names",
    """SELECT doc_id, CASE WHEN line = '' THEN 'line: empty name' WHEN length(line) > 200 THEN 'line: name longer than 200'
         WHEN contains(line, '/') OR contains(line, chr(92)) THEN 'line: name holds a separator'
         WHEN contains(line, '..') THEN 'line: name holds dots' END AS reason
       FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)""",
)
def _(spark, sf):
    lines = B.table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    return V.checked(lines, {"line": "name"}).select("doc_id", "reason")


@query(
    "resolve_titles",
    """SELECT r.name, t.path FROM (
         SELECT DISTINCT q AS name FROM quarters UNION SELECT upper(title) FROM cust UNION SELECT sn||'?' FROM supp) r
       LEFT JOIN titles t ON t.key = lower(r.name)""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    names = (
        B._quarters(spark, sf).select(F.col("q").alias("name")).distinct()
        .union(E.customer_notes(t.notes).select(F.upper("title")))
        .union(people_of(t).select(F.concat("name", F.lit("?"))))
    )
    return L.resolve_titles(t.titles, names).select("name", "path")


# Links and graph -----------------------------------------------------------


@query("resolved_links", "SELECT src, target, dst FROM links")
def _(spark, sf):
    return B.corpus(spark, sf).links


@query(
    "backlinks",
    """SELECT e.dst AS seed, n.path, n.title FROM edge e JOIN notes n ON n.path = e.src JOIN cust c ON c.path = e.dst""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return L.backlinks(t.links, t.notes, E.customer_notes(t.notes)).select("seed", "path", "title")


@query(
    "forward_links",
    """SELECT e.src AS seed, n.path, n.title FROM edge e JOIN notes n ON n.path = e.dst JOIN meet m ON m.path = e.src""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return L.forward_links(t.links, t.notes, E.under(t.notes, "Meetings/")).select("seed", "path", "title")


_UNDIRECTED = """(SELECT src AS a, dst AS b FROM edge WHERE src<>dst UNION SELECT dst, src FROM edge WHERE src<>dst)"""


@query(
    "related_2hop",
    f"""WITH u AS {_UNDIRECTED}, one AS (SELECT s.path AS seed, u.b AS path FROM cust s JOIN u ON u.a = s.path),
         two AS (SELECT DISTINCT o.seed, u.b AS path FROM one o JOIN u ON u.a = o.path)
       SELECT seed, path, min(hop) AS hop FROM (
         SELECT seed, path, 1 AS hop FROM one UNION ALL SELECT seed, path, 2 FROM two) WHERE seed <> path GROUP BY 1, 2""".replace(
        "WITH u AS", "SELECT * FROM (WITH u AS"
    )
    + ")",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return L.related_notes(t.links, t.notes, E.customer_notes(t.notes), 2).select("seed", "path", "hop")


@query(
    "related_2hop_salted",
    f"""WITH u AS {_UNDIRECTED}, one AS (SELECT s.path AS seed, u.b AS path FROM cust s JOIN u ON u.a = s.path),
         two AS (SELECT DISTINCT o.seed, u.b AS path FROM one o JOIN u ON u.a = o.path)
       SELECT seed, path, min(hop) AS hop FROM (
         SELECT seed, path, 1 AS hop FROM one UNION ALL SELECT seed, path, 2 FROM two) WHERE seed <> path GROUP BY 1, 2""".replace(
        "WITH u AS", "SELECT * FROM (WITH u AS"
    )
    + ")",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    # Notes with more than 40 links are hubs here, so the salted join runs.
    found = L.related_notes(t.links, t.notes, E.customer_notes(t.notes), 2, hot_rows=40)
    return found.select("seed", "path", "hop")


@query(
    "related_filtered",
    f"""SELECT * FROM (WITH u AS {_UNDIRECTED}, one AS (SELECT s.path AS seed, u.b AS path FROM supp s JOIN u ON u.a = s.path),
         two AS (SELECT DISTINCT o.seed, u.b AS path FROM one o JOIN u ON u.a = o.path)
       SELECT DISTINCT seed, path FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
       WHERE seed <> path AND path LIKE 'People/%' AND path IN (SELECT path FROM supp WHERE kind='partner'))""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    where = Q.search_filter("People/", ["partner", "nobody"])
    return L.related_notes(t.links, t.notes, E.under(t.notes, "People/"), 2, where).select("seed", "path")


@query(
    "traverse_in_out",
    """SELECT 'in' AS direction, dst AS seed, src AS path FROM edge JOIN supp ON dst = path
       UNION ALL SELECT 'out', src, dst FROM edge JOIN supp ON src = path""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    seeds = E.under(t.notes, "People/")
    part = lambda d: L.traverse(t.links, t.notes, seeds, d).select(F.lit(d).alias("direction"), "seed", "path")
    return part("in").union(part("out"))


# Customers and people ------------------------------------------------------


@query(
    "customer_paths",
    """SELECT n AS customer, path, CASE WHEN k%10=0 THEN 'flat' ELSE 'nested' END AS layout FROM cust
       UNION ALL SELECT sn, 'Customers/'||sn||'/'||sn||'.md', 'none' FROM supp""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    requests = customers_of(t).union(people_of(t))
    return E.customer_paths(t.notes, requests)


@query("customer_roster", "SELECT n AS customer FROM cust")
def _(spark, sf):
    return E.customer_roster(B.corpus(spark, sf).notes)


@query(
    "flat_customers",
    """SELECT n AS customer, path AS current_path, 'Customers/'||n||'/'||n||'.md' AS expected_path FROM cust WHERE k%10=0""",
)
def _(spark, sf):
    return E.flat_customers(B.corpus(spark, sf).notes)


@query("linked_people", "SELECT w.n AS customer, w.path, s.title FROM works w JOIN supp s ON s.sk=w.sk WHERE w.listed")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.linked_people(t.notes, customers_of(t)).select("customer", "path", "title")


@query("recent_meetings", "SELECT customer, path, title, date FROM recent")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.recent_meetings(t.notes, customers_of(t), AS_OF).select("customer", "path", "title", "date")


@query(
    "meetings_for_person",
    "SELECT DISTINCT l.sn AS name, m.path, m.title FROM li l JOIN meet m ON m.okey = l.okey",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.meetings_for_person(t.notes, t.links, people_of(t))


@query(
    "similar_customers",
    """SELECT a.n AS customer, coalesce(b.c, 0) AS similar_count FROM cust a LEFT JOIN (
         SELECT x.path, count(DISTINCT y.path) - 1 AS c
         FROM (SELECT path, unnest(tags) AS tag FROM notes WHERE path LIKE 'Customers/%') x
         JOIN (SELECT path, unnest(tags) AS tag FROM notes WHERE path LIKE 'Customers/%') y USING (tag)
         GROUP BY 1) b ON b.path = a.path""",
)
def _(spark, sf):
    return E.similar_counts(B.corpus(spark, sf).notes)


@query(
    "similar_customers_many_tags",
    """SELECT 'C'||c_custkey AS customer, coalesce(b.c, 0) AS similar_count FROM customer LEFT JOIN (
         WITH tagged AS (SELECT DISTINCT o_custkey AS k, l_partkey % 200 AS tag FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
         SELECT x.k, count(DISTINCT y.k) - 1 AS c FROM tagged x JOIN tagged y USING (tag) GROUP BY 1) b ON b.k = c_custkey""",
)
def _(spark, sf):
    return E.similar_counts(B.customers_by_parts(spark, sf))


@query("open_items", "SELECT customer, path, ordinal, text, assignee FROM open_item")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.open_items(t.notes, t.links, t.tasks, customers_of(t), AS_OF)


@query("open_items_assignee", "SELECT customer, path, ordinal, text, assignee FROM open_item WHERE lower(assignee) = 'supplier_1'")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.open_items(t.notes, t.links, t.tasks, customers_of(t), AS_OF, "SUPPLIER_1")


@query("orphaned_meetings_strict", "SELECT path FROM orphan")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.orphaned_meetings(t.notes, t.links, strict=True)


@query("orphaned_meetings", "SELECT path FROM orphan")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return W.orphaned_meetings(t.notes, t.links)


@query(
    "resolve_people",
    """SELECT r.name, t.path, CASE WHEN r.kind='file' THEN 'exact' WHEN t.path IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS confidence,
         CASE WHEN t.path IS NOT NULL THEN 'Firm '||s.snat END AS company,
         CASE WHEN t.path IS NOT NULL THEN CASE WHEN s.sk%5<>0 THEN s.kind ELSE 'customer' END END AS org,
         CASE WHEN t.path IS NOT NULL THEN coalesce(w.c, '') END AS customers
       FROM (SELECT sn AS name, 'file' AS kind, path AS want FROM supp
             UNION ALL SELECT upper(title), 'title', path FROM supp WHERE sk%6=0
             UNION ALL SELECT n, 'other', NULL FROM cust) r
       LEFT JOIN (SELECT path FROM supp) t ON t.path = r.want
       LEFT JOIN supp s ON s.path = t.path
       LEFT JOIN (SELECT path, string_agg(n, ',' ORDER BY n) AS c FROM works WHERE listed GROUP BY 1) w ON w.path = t.path""",
)
def _(spark, sf):
    return _resolved(spark, sf).select("name", "path", "confidence", "company", "org", joined("customers"))


def _resolved(spark, sf):
    t = B.corpus(spark, sf)
    people = E.under(t.notes, "People/")
    titled = people.where(F.startswith(F.col("title"), F.lit("Person "))).select(F.upper("title"))
    return W.resolve_people(t.notes, t.titles, people_of(t).union(titled).union(customers_of(t)))


@query(
    "resolve_people_summary",
    """SELECT policy, count(*) AS people FROM (
         SELECT 'auto_use' AS policy FROM supp UNION ALL SELECT 'needs_confirmation' FROM supp WHERE sk%6=0
         UNION ALL SELECT 'skipped' FROM cust) GROUP BY policy""",
)
def _(spark, sf):
    return W.resolve_people_summary(_resolved(spark, sf))


@query("people_customer_map", "SELECT key, customers FROM person_map")
def _(spark, sf):
    return R.people_customer_map(B.corpus(spark, sf).notes).select("key", joined("customers"))


# Correlation ---------------------------------------------------------------


def _entities(spark, sf) -> DataFrame:
    """One entity per person, customer, order date, part name and title."""
    none = F.lit(None).cast("string")
    supp = B._suppliers(spark, sf)
    cust = B._customers(spark, sf)
    dates = B.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    parts = B.table(spark, sf, "part").select("p_name").distinct()
    row = lambda df, kind, name, date=none: df.select(
        F.concat(F.lit(kind + ":"), name, F.coalesce(date, F.lit(""))).alias("entity_id"),
        name.alias("name"), F.lit(kind).alias("type"), date.alias("date"),
    )
    return (
        row(supp, "person", F.col("sn"))
        .union(row(supp, "person", F.concat(F.lit("Nobody "), F.col("sk").cast("string"))))
        .union(row(cust, "customer", F.col("n")))
        .union(row(cust, "customer", F.concat("n", F.lit(" ACCOUNT"))))
        .union(row(dates, "meeting", F.lit("ORDER 1"), F.col("day")))
        .union(row(parts, "opportunity", F.upper("p_name")))
        .union(row(cust.where("k % 10 <> 0 AND k % 4 = 2"), "other", F.concat(F.lit("Milestone "), F.col("k").cast("string"))))
    )


_ENTITIES = """(
    SELECT 'person:'||sn AS entity_id, sn AS name, 'person' AS type, NULL AS date FROM supp
    UNION ALL SELECT 'person:Nobody '||sk, 'Nobody '||sk, 'person', NULL FROM supp
    UNION ALL SELECT 'customer:'||n, n, 'customer', NULL FROM cust
    UNION ALL SELECT 'customer:'||n||' ACCOUNT', n||' ACCOUNT', 'customer', NULL FROM cust
    UNION ALL SELECT DISTINCT 'meeting:ORDER 1'||day, 'ORDER 1', 'meeting', day FROM meet
    UNION ALL SELECT DISTINCT 'opportunity:'||upper(p_name), upper(p_name), 'opportunity', NULL FROM part
    UNION ALL SELECT 'other:Milestone '||k, 'Milestone '||k, 'other', NULL FROM cust WHERE k%10<>0 AND k%4=2)"""

_MATCH = {
    "person": """
        SELECT 'person:'||sn AS entity_id, 'note' AS kind, path AS value, 'exact' AS confidence FROM supp
        UNION SELECT 'person:'||s.sn, 'customer', w.n, 'exact' FROM supp s JOIN works w ON w.sk=s.sk AND w.listed AND lower(s.title)=lower(s.sn)
        UNION SELECT 'person:'||l.sn, 'customer', m.customer, 'exact' FROM li l JOIN meet m ON m.okey=l.okey WHERE m.customer IS NOT NULL""",
    "customer": """
        SELECT 'customer:'||n AS entity_id, 'note' AS kind, path AS value, 'exact' AS confidence FROM cust
        UNION ALL SELECT 'customer:'||n, 'customer', n, 'exact' FROM cust
        UNION ALL SELECT 'customer:'||n||' ACCOUNT', 'note', path, 'fuzzy' FROM cust WHERE k%9<>0
        UNION ALL SELECT 'customer:'||n||' ACCOUNT', 'customer', n||' ACCOUNT', 'fuzzy' FROM cust WHERE k%9<>0""",
    "meeting": """
        SELECT DISTINCT 'meeting:ORDER 1'||d.day AS entity_id, v.kind, CASE v.kind WHEN 'note' THEN m.path ELSE m.customer END AS value,
          'fuzzy' AS confidence
        FROM (SELECT DISTINCT day FROM meet) d JOIN meet m ON (m.date IS NULL OR m.date = d.day) AND contains(lower(m.title), 'order 1')
        CROSS JOIN (VALUES ('note'), ('customer')) v(kind) WHERE v.kind='note' OR m.customer IS NOT NULL""",
    "opportunity": """
        SELECT entity_id, v.kind, CASE v.kind WHEN 'note' THEN c.path ELSE customer END AS value,
          CASE WHEN guid IS NOT NULL THEN 'exact' ELSE 'fuzzy' END AS confidence
        FROM (SELECT 'opportunity:'||upper(p.p_name) AS entity_id, o.customer,
                first(o.guid ORDER BY o.path, o.ordinal) AS guid
              FROM (SELECT DISTINCT p_name FROM part) p JOIN opp o ON contains(lower(o.name), lower(p.p_name)) GROUP BY 1, 2) f
        JOIN cust c ON c.n = f.customer CROSS JOIN (VALUES ('note'), ('customer')) v(kind)""",
    "other": """
        SELECT 'other:Milestone '||k AS entity_id, 'note' AS kind, path AS value, 'exact' AS confidence FROM ms_note""",
}
_ANY_MATCH = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in _MATCH.values())


@query("correlate_person", _MATCH["person"])
def _(spark, sf):
    t = B.corpus(spark, sf)
    return R.correlate_person(t.notes, t.links, t.titles, _entities(spark, sf))


@query("correlate_customer", _MATCH["customer"])
def _(spark, sf):
    t = B.corpus(spark, sf)
    return R.correlate_customer(t.notes, t.titles, _entities(spark, sf))


@query("correlate_meeting", _MATCH["meeting"])
def _(spark, sf):
    return R.correlate_meeting(B.corpus(spark, sf).notes, _entities(spark, sf))


@query(
    "correlate_meeting_range",
    """SELECT DISTINCT 'meeting:'||e.name AS entity_id, v.kind, CASE v.kind WHEN 'note' THEN m.path ELSE m.customer END AS value,
         'fuzzy' AS confidence
       FROM (SELECT DISTINCT 'Order '||left(okey::VARCHAR, 2) AS name FROM meet) e
       JOIN meet m ON (m.date IS NULL OR m.date BETWEEN '1996-01-01' AND '1996-12-31') AND contains(lower(m.title), lower(e.name))
       CROSS JOIN (VALUES ('note'), ('customer')) v(kind) WHERE v.kind='note' OR m.customer IS NOT NULL""",
)
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    names = B.table(spark, sf, "orders").select(F.concat(F.lit("Order "), F.substring(key, 1, 2)).alias("name")).distinct()
    wanted = names.select(
        F.concat(F.lit("meeting:"), "name").alias("entity_id"), "name", F.lit("meeting").alias("type"), F.lit(None).cast("string").alias("date")
    )
    return R.correlate_meeting(B.corpus(spark, sf).notes, wanted, ("1996-01-01", "1996-12-31"))


@query("correlate_opportunity", _MATCH["opportunity"])
def _(spark, sf):
    return R.correlate_opportunity(B.corpus(spark, sf).notes, _entities(spark, sf))


@query("correlate_other", _MATCH["other"])
def _(spark, sf):
    return R.correlate_other(B.corpus(spark, sf).titles, _entities(spark, sf))


@query(
    "correlate_summary",
    f"""SELECT type, count(*) AS total, count(hit) AS resolved, count(*) - count(hit) AS unresolved
        FROM {_ENTITIES} e LEFT JOIN (SELECT DISTINCT entity_id AS hit FROM ({_ANY_MATCH})) m ON m.hit = e.entity_id GROUP BY type""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    entities = _entities(spark, sf)
    matches = R.correlate(t.notes, t.links, t.titles, entities)
    return R.correlate_summary(R.correlate_confidence(matches, entities))


# Statistics and health -----------------------------------------------------


@query(
    "corpus_stats",
    """SELECT (SELECT count(*) FROM notes) AS note_count, (SELECT count(*) FROM edge) AS link_count,
         (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM notes)) AS tag_count""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return A.corpus_stats(t.notes, t.links)


@query(
    "top_tags",
    """SELECT tag, count(*) AS note_count FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY tag
       ORDER BY note_count DESC, tag LIMIT 20""",
)
def _(spark, sf):
    return A.top_tags(B.corpus(spark, sf).notes, 20)


@query(
    "document_tags",
    """SELECT tag, count(*) AS note_count FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY tag""",
)
def _(spark, sf):
    return A.tag_counts(B.document_notes(spark, sf))


@query(
    "most_linked",
    """SELECT path, title, count(src) AS in_degree FROM notes LEFT JOIN edge ON dst = path GROUP BY 1, 2
       ORDER BY in_degree DESC, path LIMIT 10""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return A.most_linked(t.notes, t.links, 10)


@query(
    "folder_counts",
    """SELECT folder, depth, count(*) AS note_count FROM (
         SELECT CASE WHEN d=0 THEN '/' ELSE array_to_string(p[1:d], '/') END AS folder, d AS depth
         FROM (SELECT string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS d FROM notes)) GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.folder_counts(B.corpus(spark, sf).notes)


# The same from counts held with a bucketed snapshot, after one batch took notes out and two more put them back.
_HELD = {
    "corpus_stats": A.held_stats,
    "top_tags": lambda store: A.held_top_tags(store, 20),
    "most_linked": lambda store: A.held_most_linked(store, 10),
    "folder_counts": A.held_folder_counts,
}
for _name, _held in _HELD.items():
    CATALOG[f"{_name}_held"] = Query(lambda spark, sf, held=_held: held(B.restored_store(spark, sf)), CATALOG[_name].sql)


@query(
    "overview",
    """SELECT 'folder' AS part, folder AS key, count(*)::VARCHAR AS value FROM (
         SELECT CASE WHEN d=0 THEN '/' ELSE array_to_string(p[1:d], '/') END AS folder
         FROM (SELECT string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS d FROM notes)) GROUP BY 2
       UNION ALL SELECT 'stats', 'note_count', count(*)::VARCHAR FROM notes
       UNION ALL SELECT 'stats', 'link_count', count(*)::VARCHAR FROM edge
       UNION ALL SELECT 'stats', 'tag_count', count(DISTINCT tag)::VARCHAR FROM (SELECT unnest(tags) AS tag FROM notes)
       UNION ALL SELECT 'stats', 'last_indexed', strftime(max(mtime), '%Y-%m-%d %H:%M:%S') FROM
         (SELECT mtime FROM cust UNION ALL SELECT mtime FROM meet)
       UNION ALL SELECT * FROM (SELECT 'top_tag', tag, count(*)::VARCHAR FROM (SELECT unnest(tags) AS tag FROM notes)
         GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 20)
       UNION ALL SELECT * FROM (SELECT 'most_linked', path, count(src)::VARCHAR FROM notes LEFT JOIN edge ON dst = path
         GROUP BY path ORDER BY count(src) DESC, path LIMIT 10)""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return A.overview(t.notes, t.links)


@query(
    "runtime_health",
    """SELECT (SELECT count(*) FROM notes) AS note_count, (SELECT count(*) FROM edge) AS link_count,
         (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM notes)) AS tag_count,
         (SELECT max(mtime) FROM (SELECT mtime FROM cust UNION ALL SELECT mtime FROM meet)) AS last_indexed,
         (SELECT max(ts)::DATE FROM events) AS last_log_date, (SELECT max(ts) FROM events) AS last_write""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return A.runtime_health(t.notes, t.links, B.event_log(spark, sf))


_FRESH = """customer, path, last_modified, last_validated, stale_insights, opportunities, with_guid, milestones, with_id,
    first_stale_days, has_team, has_connect_hooks"""


@query("customer_freshness", f"SELECT {_FRESH} FROM fresh")
def _(spark, sf):
    return H.customer_freshness(B.corpus(spark, sf).notes, AS_OF)


@query(
    "freshness_items",
    """SELECT customer, 'stale_insight' AS kind, text, date, age_days FROM stale
       UNION ALL SELECT customer, 'missing_guid', name, NULL, NULL FROM opp WHERE guid IS NULL
       UNION ALL SELECT customer, 'missing_id', name, NULL, NULL FROM ms WHERE id IS NULL AND number IS NULL""",
)
def _(spark, sf):
    return H.freshness_items(B.corpus(spark, sf).notes, AS_OF)


@query("health_issues", "SELECT customer, kind, count, age_days FROM issue")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return H.health_issues(H.customer_freshness(t.notes, AS_OF), W.orphaned_meetings(t.notes, t.links))


@query(
    "health_report",
    """SELECT (SELECT count(*) FROM cust) AS total_customers, count(*) AS checked_customers,
         sum(stale_insights)::BIGINT AS stale_insights, sum(opportunities-with_guid)::BIGINT AS missing_guids,
         sum(milestones-with_id)::BIGINT AS missing_ids, (SELECT count(*) FROM orphan) AS orphaned_meetings,
         (SELECT count(*) FROM cust WHERE k%10=0) AS structural_issues, (SELECT count(*) FROM issue) AS issues,
         (SELECT count(*) FROM issue) = 0 AS healthy
       FROM fresh""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return H.health_report(t.notes, t.links, AS_OF)


@query("prefetch_ids", "SELECT customer, kind, value FROM ids")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return C.prefetch_ids(t.notes)


@query(
    "prefetch_filters",
    """SELECT coalesce(o.customer, a.customer) AS customer, 0 AS page, o.f AS opportunity_filter, a.f AS account_filter
       FROM (SELECT customer, string_agg('_msp_opportunityid_value eq '''||value||'''', ' or '
               ORDER BY value) AS f FROM ids WHERE kind='opportunity_guid' GROUP BY customer) o
       FULL JOIN (SELECT customer, '_msp_accountid_value eq '''||value||'''' AS f FROM ids WHERE kind='tpid') a
       ON a.customer = o.customer""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return C.prefetch_filters(C.prefetch_ids(t.notes))


# Contexts and drift --------------------------------------------------------

_CONTEXT = {
    "opportunity": "SELECT customer, 'opportunity' AS part, path||'#'||ordinal AS key, name AS label, guid AS detail FROM opp",
    "milestone": "SELECT customer, 'milestone', path||'#'||ordinal, name, coalesce(id, number) FROM ms",
    "team": "SELECT customer, 'team', (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::VARCHAR, name, role FROM team",
    "insight": "SELECT customer, 'insight', source||'#'||ordinal, entry, NULL FROM insight",
    "hook": "SELECT n, 'hook', path, '- Hook for '||n, NULL FROM cust WHERE k%2=0",
    "person": "SELECT w.n, 'person', w.path, s.title, NULL FROM works w JOIN supp s ON s.sk=w.sk WHERE w.listed",
    "meeting": "SELECT customer, 'meeting', path, title, date FROM met",
    "open_item": "SELECT customer, 'open_item', path||'#'||ordinal, text, assignee FROM open_item",
}
_CONTEXT_ROWS = " UNION ALL ".join(_CONTEXT.values())


@query("customer_context", f"SELECT customer, part, key, label, detail FROM ({_CONTEXT_ROWS})")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return C.customer_context(t, None, AS_OF).where("part <> 'note'")


@query(
    "customer_context_nested",
    f"""SELECT customer, part, 0 AS page, count(*) AS items, string_agg(key, ',' ORDER BY key) AS keys
        FROM ({_CONTEXT_ROWS}) GROUP BY 1, 2""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    rows = C.customer_context(t, None, AS_OF).where("part <> 'note'")
    keys = F.array_join(F.transform("items", lambda i: i["key"]), ",")
    return C.nest_context(rows).select("customer", "part", "page", F.size("items").alias("items"), keys.alias("keys"))


@query(
    "customer_context_pages",
    f"""SELECT customer, part, count(*) AS items, true AS bounded FROM ({_CONTEXT_ROWS}) GROUP BY 1, 2""",
)
def _(spark, sf):
    # Pages of three rows: most customers have several, none holds more.
    t = B.corpus(spark, sf)
    rows = C.customer_context(t, None, AS_OF).where("part <> 'note'")
    size = F.size("items")
    pages = C.nest_context(rows, page_rows=3).groupBy("customer", "part")
    return pages.agg(F.sum(size).alias("items"), (F.max(size) <= 3).alias("bounded"))


@query(
    "customer_context_brief",
    f"""SELECT customer, part, count(*) AS items FROM (
          {" UNION ALL ".join(_CONTEXT[p] for p in ("opportunity", "milestone", "team", "person", "meeting", "open_item"))}
          UNION ALL SELECT customer, 'count', 'agent_insights', 'agent_insights', count(*)::VARCHAR FROM insight GROUP BY customer
          UNION ALL SELECT n, 'count', 'connect_hooks', 'connect_hooks', '1' FROM cust WHERE k%2=0) GROUP BY 1, 2""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    rows = C.customer_context(t, None, AS_OF, view="brief").where("part <> 'note'")
    return rows.groupBy("customer", "part").agg(F.count(F.lit(1)).alias("items"))


@query(
    "person_context",
    """SELECT sn AS name, 'profile' AS part, 'path' AS key, path AS label FROM supp
       UNION ALL SELECT sn, 'profile', 'company', 'Firm '||snat FROM supp
       UNION ALL SELECT sn, 'profile', 'org', kind FROM supp WHERE sk%5<>0
       UNION ALL SELECT sn, 'profile', 'email', 's'||sk||'@example.com' FROM supp
       UNION ALL SELECT sn, 'tag', '0', 'person' FROM supp UNION ALL SELECT sn, 'tag', '1', kind FROM supp
       UNION ALL SELECT sn, 'customer', (row_number() OVER (PARTITION BY sk ORDER BY n) - 1)::VARCHAR, n FROM works WHERE listed
       UNION ALL SELECT DISTINCT l.sn, 'meeting', m.path, m.title FROM li l JOIN meet m ON m.okey=l.okey
       UNION ALL SELECT s.sn, 'backlink', n.path, n.title FROM supp s JOIN edge e ON e.dst=s.path JOIN notes n ON n.path=e.src""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    return C.person_context(t, people_of(t))


_SNAP = """(SELECT customer, 'opportunity' AS kind, coalesce(guid, name) AS item_key, coalesce(stage, status) AS state FROM opp
    UNION ALL SELECT customer, 'milestone', coalesce(id, number, name), status FROM ms
    UNION ALL SELECT customer, 'team', name, role FROM team WHERE head='Team'
    UNION ALL SELECT n, 'last_insight', 'date', d FROM cust LEFT JOIN (SELECT customer, max(d) AS d FROM ins_line GROUP BY 1) ON customer = n)"""


@query(
    "drift_report",
    f"""SELECT coalesce(a.customer, b.customer) AS customer, coalesce(a.kind, b.kind) AS kind, coalesce(a.item_key, b.item_key) AS item_key,
          CASE WHEN a.customer IS NULL THEN 'missing' WHEN b.customer IS NULL THEN 'new'
               WHEN a.state IS DISTINCT FROM b.state THEN 'changed' ELSE 'same' END AS change,
          a.state AS note_state, b.state AS external_state
        FROM (SELECT customer, kind, item_key, max(state) AS state FROM {_SNAP} GROUP BY 1, 2, 3) a
        FULL JOIN (SELECT DISTINCT n AS customer, 'team' AS kind, sn AS item_key, 'Lead' AS state FROM
                   (SELECT c.n, s.sn FROM cust c JOIN supp s ON s.sk = c.k//15 + 1)) b
        ON a.customer = b.customer AND a.kind = b.kind AND a.item_key = b.item_key""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    snapshot = C.drift_snapshot(t.notes).where("kind <> 'frontmatter'")
    cust = B._customers(spark, sf).withColumn("sk", F.expr("k div 15 + 1"))
    external = cust.join(B._suppliers(spark, sf), "sk").select(
        F.col("n").alias("customer"), F.lit("team").alias("kind"), F.col("sn").alias("item_key"), F.lit("Lead").alias("state")
    )
    return C.drift(snapshot, external)


# Bucketed snapshots ----------------------------------------------------------

_GONE = "(SELECT path FROM cust WHERE k%9=0 AND k%18<>0)"


@query(
    "bucket_refresh_links",
    f"""SELECT src, target, CASE WHEN dst IN {_GONE} THEN NULL ELSE dst END AS dst FROM links WHERE src NOT IN {_GONE}""",
)
def _(spark, sf):
    return B.refreshed_store(spark, sf).links


@query("bucket_refresh_notes", f"SELECT path, title FROM notes WHERE path NOT IN {_GONE}")
def _(spark, sf):
    return B.refreshed_store(spark, sf).notes.select("path", "title")


@query("bucket_lookup", "SELECT n.path, n.title FROM notes n JOIN cust c ON c.path = n.path WHERE c.k % 100 = 1")
def _(spark, sf):
    wanted = B._customers(spark, sf).where("k % 100 = 1").select("path")
    return B.bucket_store(spark, sf).lookup(wanted).select("path", "title")


# Search --------------------------------------------------------------------

# The search words; every query reads all documents in full.
WORDS = [(1, "the ertion"), (2, "SRC1"), (3, "thweou"), (4, "qzxv"), (5, "onthe ration"), (6, "e")]
_WORDS = "(VALUES " + ", ".join(f"({i}, '{w}')" for i, w in WORDS) + ") q(query_id, query)"
_DOCS = """(SELECT source||'/'||doc_id||'.md' AS path, trim(split_part(text, chr(10), 1)) AS title, text AS body,
    lang, source, doc_id, lang||', '||source AS tagline, lower(lang||chr(10)||source) AS tagtext FROM documents)"""


def _queries(spark) -> DataFrame:
    return spark.createDataFrame(WORDS, "query_id int, query string")


def _lexical_sql(limit: int, where: str = "true") -> str:
    return f"""SELECT query_id, path, title, score, rank, CASE WHEN score=0.5 THEN
          CASE WHEN s>0 THEN '…' ELSE '' END||trim(substring(body, s+1, e-s))||CASE WHEN e<length(body) THEN '…' ELSE '' END
          ELSE tagline END AS excerpt FROM (
        SELECT *, greatest(pos-41, 0) AS s, least(length(body), pos-1+length(query)+40) AS e FROM (
        SELECT *, strpos(lower(body), lower(query)) AS pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (
        SELECT q.query_id, q.query, d.*, CASE WHEN contains(lower(title), lower(query)) THEN 1.0
          WHEN contains(tagtext, lower(query)) THEN 0.7 WHEN contains(lower(body), lower(query)) THEN 0.5 END::DOUBLE AS score
        FROM {_DOCS} d CROSS JOIN {_WORDS} WHERE {where}) WHERE score IS NOT NULL) WHERE rank <= {limit})"""


@query("lexical_search", f"SELECT query_id, path, title, excerpt, score, rank FROM ({_lexical_sql(10)})")
def _(spark, sf):
    rows = S.lexical_search(B.document_notes(spark, sf), _queries(spark))
    return rows.select("query_id", "path", "title", "excerpt", "score", "rank")


@query(
    "lexical_search_bulk",
    """SELECT item_id AS query_id, source||'/'||doc_id||'.md' AS path FROM documents
       JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))""",
)
def _(spark, sf):
    notes = B.document_notes(spark, sf)
    items = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S._lexical_hits(notes, items, "join").select("query_id", "path")


@query(
    "search_filtered",
    f"""SELECT query_id, path, score FROM ({_lexical_sql(25, "d.path LIKE 'src1%' AND (d.lang='en' OR d.source='src12') AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality=1)")})""",
)
def _(spark, sf):
    where = Q.search_filter("src1", ["en", "src12"], {"quality": 1})
    rows = S.lexical_search(B.document_notes(spark, sf), _queries(spark), 25, where)
    return rows.select("query_id", "path", "score")


def _content_sql(limit: int) -> str:
    return f"""SELECT query_id, path, title, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (
        SELECT query_id, path, title, least(sum(hits)/max(terms)/10.0, 1.0)::DOUBLE AS score FROM (
          SELECT query_id, path, title, len(ts) AS terms,
            ((length(lb)-length(replace(lb, t, '')))//length(t))::DOUBLE AS hits FROM (
            SELECT q.query_id, d.path, d.title, lower(d.body) AS lb, ts, unnest(ts) AS t FROM {_DOCS} d CROSS JOIN
              (SELECT query_id, list_filter(string_split(lower(query), ' '), lambda w: length(w)>=2) AS ts FROM {_WORDS}) q))
        GROUP BY query_id, path, title HAVING sum(hits) > 0 AND count(CASE WHEN hits>0 THEN 1 END) >= ceil(max(terms)/2.0))) WHERE rank <= {limit}"""


_BLANKS = [*WORDS, (7, ""), (8, " "), (9, "\n\t"), (10, None)]


@query("search_blank", f"SELECT query_id, path, score FROM ({_lexical_sql(10)})")
def _(spark, sf):
    asked = spark.createDataFrame(_BLANKS, "query_id int, query string")
    notes = B.document_notes(spark, sf)
    scan = S.lexical_search(notes, asked).select("query_id", "path", "score")
    joined = S.lexical_search(notes, asked, route="join").select("query_id", "path", "score")
    # Both routes must agree: what only one of them finds would be an extra row, twice where it is the scan.
    return scan.unionByName(joined.exceptAll(scan)).unionByName(scan.exceptAll(joined))


@query("lexical_search_joined", f"SELECT query_id, path, title, excerpt, score, rank FROM ({_lexical_sql(10)})")
def _(spark, sf):
    rows = S.lexical_search(B.document_notes(spark, sf), _queries(spark), route="join")
    return rows.select("query_id", "path", "title", "excerpt", "score", "rank")


@query("content_search_joined", f"SELECT query_id, path, title, round(score, 6) AS score, rank FROM ({_content_sql(10)})")
def _(spark, sf):
    rows = S.content_search(B.document_notes(spark, sf), _queries(spark), route="join")
    return rows.select("query_id", "path", "title", F.round("score", 6).alias("score"), "rank")


@query("content_search", f"SELECT query_id, path, title, round(score, 6) AS score, rank FROM ({_content_sql(10)})")
def _(spark, sf):
    rows = S.content_search(B.document_notes(spark, sf), _queries(spark))
    return rows.select("query_id", "path", "title", F.round("score", 6).alias("score"), "rank")


@query("lexical_search_indexed", f"SELECT query_id, path, title, score, rank FROM ({_lexical_sql(10)})")
def _(spark, sf):
    index, titles = B.document_index(spark, sf)
    return T.lexical_search(index, titles, _queries(spark))


@query(
    "lexical_hits_indexed",
    """SELECT item_id AS query_id, source||'/'||doc_id||'.md' AS path, CASE
         WHEN contains(lower(trim(split_part(documents.text, chr(10), 1))), lower(benchmark.text)) THEN 1.0 ELSE 0.5 END::DOUBLE AS score
       FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))""",
)
def _(spark, sf):
    # Every benchmark passage against every document: needles of many words, from the index alone.
    index, _ = B.document_index(spark, sf)
    items = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return T.lexical_hits(index, items, route="join").select("query_id", "path", "score")


@query("content_search_indexed", f"SELECT query_id, path, title, round(score, 6) AS score, rank FROM ({_content_sql(10)})")
def _(spark, sf):
    index, titles = B.document_index(spark, sf)
    rows = T.content_search(index, titles, _queries(spark))
    return rows.select("query_id", "path", "title", F.round("score", 6).alias("score"), "rank")


_SNIPPET = """CASE WHEN pos IS NULL THEN substring(compact, 1, 220) ELSE
    CASE WHEN greatest(pos-81,0)>0 THEN '...' ELSE '' END
    ||substring(compact, greatest(pos-81,0)+1, least(length(compact), pos+139)-greatest(pos-81,0))
    ||CASE WHEN least(length(compact), pos+139)<length(compact) THEN '...' ELSE '' END END"""


def _snippet_sql(inner: str, columns: str) -> str:
    return rf"""SELECT {columns}, {_SNIPPET} AS snippet FROM (
        SELECT *, list_filter(list_transform(list_filter(string_split(lower(query), ' '), lambda w: length(w)>=2),
            lambda w: strpos(lower(compact), w)), lambda p: p>0)[1] AS pos FROM (
        SELECT h.*, q.query, trim(regexp_replace(d.body, '\s+', ' ', 'g')) AS compact FROM ({inner}) h JOIN {_DOCS} d USING (path) JOIN {_WORDS} USING (query_id)))"""


@query("search_snippets", _snippet_sql(_content_sql(10), "query_id, path"))
def _(spark, sf):
    notes, queries = B.document_notes(spark, sf), _queries(spark)
    return S.with_snippets(S.content_search(notes, queries), notes, queries).select("query_id", "path", "snippet")


def _fuzzy_field(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

    return words


def _fuzzy_sql(limit: int) -> str:
    def distance(field):
        return f"""(SELECT min(levenshtein(r, fq)) FROM (SELECT unnest(CASE WHEN n=1 THEN {field} ELSE
            list_transform(range(1, len({field})-n+2), lambda i: array_to_string({field}[i:i+n-1], ' ')) END) AS r)
            WHERE levenshtein(r, fq) <= floor(length(fq)*0.4))/length(fq)::DOUBLE"""

    factor = lambda d, w: f"(CASE WHEN {d} IS NULL THEN 1.0 ELSE pow(greatest({d}, 0.001), {w}/6.5) END)"
    return f"""SELECT query_id, path, title, tagline, 1.0 - s/worst*0.9 AS score, rank FROM (
        SELECT *, greatest(max(s) OVER (PARTITION BY query_id), 0.01) AS worst FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, path) AS rank FROM (
        SELECT *, CASE WHEN dt IS NOT NULL OR dg IS NOT NULL OR db IS NOT NULL THEN
          {factor("dt", 3.0)}*{factor("dg", 2.0)}*{factor("db", 0.5)} END AS s FROM (
        SELECT query_id, path, title, tagline, {distance("wt")} AS dt, {distance("wg")} AS dg, {distance("wb")} AS db FROM (
        SELECT q.query_id, lower(q.query) AS fq, len(string_split(q.query, ' ')) AS n, d.path, d.title, d.tagline,
          {_fuzzy_field("d.title")} AS wt, {_fuzzy_field("d.lang||' '||d.source")} AS wg, {_fuzzy_field("d.body")} AS wb
        FROM {_DOCS} d CROSS JOIN {_WORDS}))) WHERE s IS NOT NULL) WHERE rank <= {2 * limit}) WHERE rank <= {limit}"""


@query("fuzzy_search", f"SELECT query_id, path, title, tagline AS excerpt, round(score, 6) AS score, rank FROM ({_fuzzy_sql(10)})")
def _(spark, sf):
    rows = S.fuzzy_search(B.document_notes(spark, sf), _queries(spark))
    return rows.select("query_id", "path", "title", "excerpt", F.round("score", 6).alias("score"), "rank")


def _tiers_sql(parts: list[str], limit: int) -> str:
    tagged = " UNION ALL ".join(f"SELECT query_id, path, score, rank, {i} AS tier FROM ({p})" for i, p in enumerate(parts))
    return f"""SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY tier) AS f FROM ({tagged})) WHERE f=1
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) <= {limit}"""


_CASCADE = _tiers_sql([_lexical_sql(10), _fuzzy_sql(10)], 10)


@query("search_cascade", f"SELECT query_id, path, round(score, 6) AS score, rank FROM ({_CASCADE})")
def _(spark, sf):
    rows = S.cascade_search(B.document_notes(spark, sf), _queries(spark))
    return rows.select("query_id", "path", F.round("score", 6).alias("score"), "rank")


_FULL = _tiers_sql([_CASCADE, f"SELECT * REPLACE (score*0.4 AS score) FROM ({_content_sql(10)})"], 10)


@query("search_full", f"SELECT query_id, path, round(score, 6) AS score, rank FROM ({_FULL})")
def _(spark, sf):
    rows = S.search(B.document_notes(spark, sf), _queries(spark))
    return rows.select("query_id", "path", F.round("score", 6).alias("score"), "rank")


_BROAD = f"""SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier, path) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY tier) AS f FROM (
      SELECT query_id, path, score, 0 AS tier FROM ({_fuzzy_sql(10)}) UNION ALL
      SELECT query_id, path, score, 1 FROM ({_content_sql(10)}))) WHERE f=1
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier, path) <= 10"""


@query(
    "search_broad",
    f"""SELECT query_id, path, round(score, 6) AS score, rank, substring(snippet, 1, 220) AS snippet FROM (
        {_snippet_sql(_BROAD, "query_id, path, score, rank")})""",
)
def _(spark, sf):
    rows = S.broad_search(B.document_notes(spark, sf), _queries(spark))
    return rows.select("query_id", "path", F.round("score", 6).alias("score"), "rank", "snippet")


# Edits ---------------------------------------------------------------------


def _edits(spark, sf) -> DataFrame:
    """An append per order to its customer note, a replace of every person, a new note per part."""
    cust = B._customers(spark, sf)
    stamp = F.unix_micros(F.lit("2001-07-01 00:00:00").cast("timestamp")) / 1000
    none = F.lit(None).cast("string")
    orders = B.table(spark, sf, "orders").join(cust.select(F.col("k").alias("o_custkey"), "path"), "o_custkey")
    late = F.when(F.col("o_orderkey") % 4 == 0, 5.0).otherwise(0.5)
    appends = orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("edit_id"),
        F.col("o_orderkey").alias("seq"),
        "path",
        F.lit("append").alias("op"),
        F.when(F.col("o_orderkey") % 2 == 0, "Connect Hooks").otherwise("Milestones").alias("heading"),
        F.concat(F.lit("- order "), F.col("o_orderkey").cast("string")).alias("content"),
        (stamp + (F.col("o_custkey") % 60) * 86400000 + late).alias("expected_mtime_ms"),
    )
    supp = B._suppliers(spark, sf)
    person = F.unix_micros(F.lit("2001-01-01 00:00:00").cast("timestamp")) / 1000
    replaces = supp.select(
        F.concat(F.lit("s"), F.col("sk").cast("string")),
        F.col("sk"),
        F.concat(F.lit("People/"), F.when(F.col("sk") % 3 == 0, "New ").otherwise(""), F.col("sn"), F.lit(".md")),
        F.lit("replace"), none, F.concat(F.lit("# "), F.col("sn")), person,
    )
    parts = B.table(spark, sf, "part")
    creates = parts.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")),
        F.col("p_partkey"),
        F.concat(F.lit("Parts/"), F.col("p_name"), F.lit(".md")),
        F.lit("create"), none, F.concat(F.lit("# "), F.col("p_name")), F.lit(None).cast("double"),
    )
    return appends.union(replaces).union(creates)


_RESULTS = """(
    SELECT 'o'||okey AS edit_id, okey AS seq, cpath AS path, 'append' AS op,
      CASE WHEN okey = min(CASE WHEN okey%4<>0 THEN okey END) OVER (PARTITION BY ck) THEN 'executed' ELSE 'conflict' END AS status,
      CASE WHEN okey%2=0 THEN 'Connect Hooks' ELSE 'Milestones' END AS heading, ck FROM meet
    UNION ALL SELECT 's'||sk, sk, CASE WHEN sk%3=0 THEN 'People/New '||sn||'.md' ELSE path END, 'replace',
      CASE WHEN sk%3=0 THEN 'not_found' ELSE 'executed' END, NULL, NULL FROM supp
    UNION ALL SELECT 'p'||p_partkey, p_partkey, 'Parts/'||p_name||'.md', 'create',
      CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY p_name) THEN 'created' ELSE 'conflict' END, NULL, NULL FROM part)"""


@query("edit_results", f"SELECT edit_id, seq, path, concat_ws('#', path, heading) AS ref, op, status FROM {_RESULTS}")
def _(spark, sf):
    t = B.corpus(spark, sf)
    return X.edit_results(t.notes, _edits(spark, sf)).select("edit_id", "seq", "path", "ref", "op", "status")


@query(
    "edit_append",
    f"""SELECT c.path, CASE WHEN r.heading IS NULL THEN 'untouched' WHEN r.heading='Milestones' OR c.k%2=0 THEN 'inside' ELSE 'added' END AS place,
          r.seq AS order_key,
          CASE WHEN r.heading='Milestones' THEN 'Milestones' WHEN r.heading IS NOT NULL THEN 'Connect Hooks' END AS heading
        FROM cust c LEFT JOIN (SELECT * FROM {_RESULTS} WHERE status='executed' AND op='append') r ON r.path = c.path""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    edits = _edits(spark, sf)
    after = X.apply_edits(t.notes, edits, "2001-08-02 00:00:00").notes
    before = E.customer_notes(t.notes).select("path", md.section_pieces(F.col("body")).alias("_old"))
    line = r"(?m)^- order (\d+)$"
    key = md.found(F.col("raw"), line)
    owner = F.filter(md.section_pieces(F.col("raw")), lambda s: F.rlike(s["content"], F.lit(line)))
    heading = F.get(owner, F.lit(0))["heading"]
    known = F.exists("_old", lambda s: s["heading"] == heading)
    return (
        after.join(before, "path")
        .select(
            "path",
            F.when(key.isNull(), "untouched").when(known, "inside").otherwise("added").alias("place"),
            key.cast("bigint").alias("order_key"),
            heading.alias("heading"),
        )
    )


@query(
    "edit_audit",
    f"""SELECT CASE op WHEN 'append' THEN 'atomic_append' WHEN 'replace' THEN 'atomic_replace' ELSE 'create_note' END AS operation, path,
          CASE op WHEN 'append' THEN 'append: '||heading WHEN 'replace' THEN 'whole note' ELSE 'new note' END AS detail
        FROM {_RESULTS} WHERE status IN ('executed', 'created')""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    outcome = X.apply_edits(t.notes, _edits(spark, sf), "2001-08-02 00:00:00")
    return outcome.audit.select("operation", "path", "detail")


def _findings(spark, sf) -> DataFrame:
    """A finding per order for its customer; every eleventh for an unknown one."""
    orders = B.table(spark, sf, "orders").join(
        B._customers(spark, sf).select(F.col("k").alias("o_custkey"), "n"), "o_custkey"
    )
    ok = F.col("o_orderkey")
    return orders.select(
        ok.alias("seq"),
        F.when(ok % 11 == 0, F.concat(F.lit("Lost "), F.col("n"))).otherwise(F.col("n")).alias("customer"),
        F.when(ok % 3 == 0, "Team").when(ok % 3 == 1, "Agent Insights").otherwise("Connect Hooks").alias("section"),
        F.concat(F.lit("found "), ok.cast("string")).alias("content"),
    )


@query(
    "promote_routing",
    """SELECT okey AS seq, CASE WHEN okey%11=0 THEN 'Lost '||n ELSE n END AS customer,
         CASE okey%3 WHEN 0 THEN 'Team' WHEN 1 THEN 'Agent Insights' ELSE 'Connect Hooks' END AS section,
         CASE WHEN okey%11=0 THEN 'Customers/Lost '||n||'/Lost '||n||'.md' ELSE cpath END AS path,
         CASE WHEN okey%3<>0 AND okey%11<>0 THEN 'executed' ELSE 'pending' END AS route,
         '- 2001-08-01 found '||okey AS content FROM meet""",
)
def _(spark, sf):
    return X.promote(B.corpus(spark, sf).notes, _findings(spark, sf), AS_OF)


@query(
    "promote_audit",
    """SELECT 'promote_findings' AS operation, cpath AS path, 'append: '||CASE okey%3 WHEN 1 THEN 'Agent Insights' ELSE 'Connect Hooks' END AS detail
       FROM meet WHERE okey%3<>0 AND okey%11<>0""",
)
def _(spark, sf):
    promoted = X.promote(B.corpus(spark, sf).notes, _findings(spark, sf), AS_OF)
    return X.promote_audit(promoted, "2001-08-02 00:00:00").select("operation", "path", "detail")


@query(
    "promoted_notes",
    """SELECT c.path, s.section AS heading, string_agg('- 2001-08-01 found '||okey, chr(10) ORDER BY okey) AS lines
       FROM cust c JOIN meet m ON m.cpath = c.path,
         (SELECT unnest(['Agent Insights', 'Connect Hooks']) AS section, unnest([1, 2]) AS r) s
       WHERE okey%11<>0 AND okey%3 = s.r GROUP BY c.path, s.section""",
)
def _(spark, sf):
    t = B.corpus(spark, sf)
    after = X.promoted_notes(t.notes, X.promote(t.notes, _findings(spark, sf), AS_OF), "2001-08-02 00:00:00")
    pieces = after.select("path", F.explode(md.section_pieces(F.col("raw"))).alias("p"))
    lines = F.regexp_extract_all(F.col("p.content"), F.lit(r"(?m)^- 2001-08-01 found \d+$"), F.lit(0))
    found = pieces.select("path", F.col("p.heading").alias("heading"), F.array_join(lines, "\n").alias("lines"))
    return found.where("lines <> ''")


@query(
    "edit_preview",
    """SELECT 'd'||doc_id AS edit_id, source||'/'||doc_id||'.md' AS path, 'replace' AS op, true AS existing,
         substring(text, 1, 1000) AS shown, greatest(length(text) - 1000, 0) AS hidden_chars FROM documents""",
)
def _(spark, sf):
    notes = B.document_notes(spark, sf)
    name = F.regexp_extract("path", r"([0-9]+)\.md$", 1)
    edits = notes.select(
        F.concat(F.lit("d"), name).alias("edit_id"), "path", F.lit("replace").alias("op"), F.col("body").alias("content")
    )
    return X.edit_preview(edits, notes)


@query(
    "change_summary",
    """SELECT 'folder' AS part, regexp_extract(path, '^(.*/)[^/]*$', 1) AS key, count(*)::VARCHAR AS value FROM notes GROUP BY 2
       UNION ALL SELECT * FROM (SELECT 'item', path, title FROM notes ORDER BY path LIMIT 5)
       UNION ALL SELECT 'total', 'notes', count(*)::VARCHAR FROM notes""",
)
def _(spark, sf):
    notes = B.corpus(spark, sf).notes
    return X.change_summary(notes.select("path", F.col("title").alias("detail")))


def _pending(spark, sf):
    ev = B.table(spark, sf, "events")
    eid = F.col("event_id")
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".md"))
    pending = ev.select(
        eid.alias("edit_id"),
        F.col("event_type").alias("operation"),
        user.alias("path"),
        F.col("props").alias("content"),
        F.when(F.col("event_type") == "signup", "move").when(F.col("event_type") == "error", "append").otherwise("overwrite").alias("mode"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("old/"), user)).alias("source_path"),
    )
    choice = F.when(eid % 4 == 0, "confirm").when(eid % 4 == 1, "reject")
    decisions = ev.select((eid + F.when(eid % 16 == 0, 1_000_000_000).otherwise(0)).alias("edit_id"), choice.alias("decision"))
    return pending, decisions.where(F.col("decision").isNotNull())


@query(
    "pending_decisions",
    """SELECT event_id AS edit_id, 'user/'||user_id||'.md' AS path,
         CASE WHEN event_id%16=0 THEN 'pending' WHEN event_id%4=0 THEN 'executed' WHEN event_id%4=1 THEN 'rejected' ELSE 'pending' END AS status
       FROM events
       UNION ALL SELECT event_id+1000000000, NULL, 'unknown' FROM events WHERE event_id%16=0""",
)
def _(spark, sf):
    return X.decide(*_pending(spark, sf)).select("edit_id", "path", "status")


_WRITES = """(SELECT event_id AS seq, 'user/'||user_id||'.md' AS path,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'append' ELSE 'overwrite' END AS action,
         props AS content FROM events WHERE event_id%4=0 AND event_id%16<>0
       UNION ALL SELECT event_id, 'old/user/'||user_id||'.md', 'delete', NULL
         FROM events WHERE event_id%4=0 AND event_id%16<>0 AND event_type='signup')"""


@query(
    "decided_writes",
    f"SELECT * FROM {_WRITES}",
)
def _(spark, sf):
    return X.decided_writes(X.decide(*_pending(spark, sf)))


@query(
    "decided_audit",
    """SELECT event_type AS operation, 'user/'||user_id||'.md' AS path,
         CASE event_type WHEN 'signup' THEN 'move: old/user/'||user_id||'.md' WHEN 'error' THEN 'append' ELSE 'overwrite' END AS detail
       FROM events WHERE event_id%4=0 AND event_id%16<>0""",
)
def _(spark, sf):
    return X.decided_audit(X.decide(*_pending(spark, sf)), "2024-02-01 00:00:00").select("operation", "path", "detail")


@query(
    "applied_decisions",
    f"""WITH w AS (SELECT * FROM {_WRITES}),
       base AS (SELECT DISTINCT 'user/'||user_id||'.md' AS path, 'first '||user_id AS raw FROM events WHERE user_id%2=0
         UNION SELECT DISTINCT 'old/user/'||user_id||'.md', 'old' FROM events),
       fixed AS (SELECT path, max(seq) AS s, arg_max(action, seq) AS action, arg_max(coalesce(content, ''), seq) AS text
         FROM w WHERE action <> 'append' GROUP BY path),
       tails AS (SELECT w.path, string_agg(content, '' ORDER BY seq) AS tail FROM w LEFT JOIN fixed USING (path)
         WHERE w.action = 'append' AND seq > coalesce(s, -1) GROUP BY w.path)
       SELECT path, coalesce(CASE WHEN f.path IS NOT NULL THEN CASE WHEN f.action = 'delete' THEN '' ELSE text END ELSE raw END, '')
         || coalesce(tail, '') AS raw
       FROM base FULL JOIN fixed f USING (path) FULL JOIN tails USING (path)
       WHERE NOT coalesce(f.action = 'delete' AND tail IS NULL, false)""",
)
def _(spark, sf):
    users = B.table(spark, sf, "events").select("user_id").distinct()
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".md"))
    long_ago = F.lit("2000-01-01 00:00:00").cast("timestamp").alias("mtime")
    notes = users.where("user_id % 2 = 0").select(
        user.alias("path"), F.concat(F.lit("first "), F.col("user_id").cast("string")).alias("raw"), long_ago
    ).union(users.select(F.concat(F.lit("old/"), user), F.lit("old"), long_ago))
    writes = X.decided_writes(X.decide(*_pending(spark, sf)))
    return X.apply_writes(notes, writes, "2024-02-01 00:00:00").select("path", "raw")


# Audit, increments and streams ---------------------------------------------


@query(
    "audit_for_date",
    """SELECT ts, event_type AS operation, 'user/'||user_id||'.md' AS path, props AS detail FROM events WHERE ts::DATE = DATE '2024-01-15'""",
)
def _(spark, sf):
    return audit.audit_for_date(B.event_log(spark, sf), "2024-01-15").select("ts", "operation", "path", "detail")


@query("audit_summary", "SELECT max(ts)::DATE AS last_log_date, max(ts) AS last_write FROM events")
def _(spark, sf):
    return audit.audit_summary(B.event_log(spark, sf))


@query(
    "incremental_diff",
    """SELECT path, CASE WHEN okey%7=0 THEN 'deleted' WHEN okey%7=1 THEN 'changed' ELSE 'same' END AS change FROM meet
       UNION ALL SELECT replace(path, 'Meetings/', 'Meetings/new-'), 'new' FROM meet WHERE okey%7=3""",
)
def _(spark, sf):
    old = E.under(B.corpus(spark, sf).notes, "Meetings/").select("path", "mtime")
    key = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint")
    later = F.when(key % 7 == 1, F.expr("INTERVAL 2 MILLISECONDS")).otherwise(F.expr("INTERVAL 500 MICROSECONDS"))
    kept = old.where(key % 7 != 0).select("path", (F.col("mtime") + later).alias("mtime"))
    added = old.where(key % 7 == 3).select(
        F.regexp_replace("path", "^Meetings/", "Meetings/new-").alias("path"), "mtime"
    )
    return I.incremental_diff(old, kept.union(added))


@query(
    "listing_events",
    """SELECT path, make_timestamp(2001, 1, 1, 0, 0, 0.0) AS ts, CASE WHEN k % 7 = 0 THEN 'unlink' ELSE 'change' END AS event FROM (
         SELECT path, length(path) AS k FROM notes) WHERE k % 7 IN (0, 1)
       UNION ALL SELECT 'New/'||path, make_timestamp(2001, 1, 1, 0, 0, 0.0), 'add' FROM notes WHERE length(path) % 7 = 3""",
)
def _(spark, sf):
    # A second listing of all notes: some gone, some touched, some new.
    old = B.corpus(spark, sf).notes.select("path", "mtime")
    key = F.length("path") % 7
    later = F.when(key == 1, F.expr("INTERVAL 2 MILLISECONDS")).otherwise(F.expr("INTERVAL 0 MILLISECONDS"))
    kept = old.where(key != 0).select("path", (F.col("mtime") + later).alias("mtime"))
    added = old.where(key == 3).select(F.concat(F.lit("New/"), "path").alias("path"), "mtime")
    events = watch.listing_events(old, kept.union(added), "2001-01-01 00:00:00")
    return events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "latest_state",
    """SELECT 'user/'||user_id||'.md' AS path, max(ts) AS ts,
         arg_max(CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END, (ts, event_id)) AS event
       FROM events GROUP BY user_id""",
)
def _(spark, sf):
    return changes.latest_state(B.file_events(spark, sf))


@query(
    "audit_round_trip",
    """SELECT ts, ts::DATE AS log_date, CASE WHEN value >= 10 THEN 'gated' ELSE 'auto' END AS tier, event_type AS operation,
         'user/'||user_id||'.md' AS path, props AS detail FROM events""",
)
def _(spark, sf):
    log, place = B.event_log(spark, sf), fresh_path(spark, "log")
    audit.append_log(log.where("operation = 'click'"), place)
    audit.append_log(log.where("operation IS DISTINCT FROM 'click'"), place)
    return audit.read_log(spark, place)


@query("snapshot_round_trip", f"SELECT path, title, {_TAGS} FROM notes")
def _(spark, sf):
    place = fresh_path(spark, "snapshot")
    snapshots.save_snapshot(spark, place, B.corpus(spark, sf).notes, L.resolve_links)
    return snapshots.load_snapshot(spark, place)[0].select("path", "title", joined("tags"))


@query(
    "note_errors",
    """SELECT 'c/'||c_custkey||'.md' AS path, 'frontmatter is not valid YAML' AS reason FROM customer WHERE c_custkey % 3 = 0""",
)
def _(spark, sf):
    key = F.col("c_custkey").cast("string")
    broken = F.when(F.col("c_custkey") % 3 == 0, "---\ntags: [a\n---\n# x\n").when(F.col("c_custkey") % 3 == 1, "---\na: 1\n---\n# x\n")
    raw = B.table(spark, sf, "customer").select(
        F.concat(F.lit("c/"), key, F.lit(".md")).alias("path"),
        broken.otherwise("# no frontmatter\n").alias("raw"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("mtime"),
        F.lit(1).cast("long").alias("length"),
    )
    return P.note_errors(raw)


@query(
    "debounced_bursts",
    """SELECT path, min(ts) AS start, max(ts) AS ts, arg_max(event, (ts, event_id)) AS event FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
           SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 300 MILLISECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
           FROM (SELECT 'user/'||user_id||'.md' AS path, make_timestamp(epoch_us(ts) // 3600 // 1000 * 1000) AS ts, event_id,
             CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event FROM events)
           WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)))
       GROUP BY path, burst""",
)
def _(spark, sf):
    # The events come 3,600 times as fast, in whole milliseconds: bursts and ties for the real gap.
    fast = F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp)) div 3600 div 1000 * 1000")).cast("timestamp_ntz")
    return changes.debounce(B.file_events(spark, sf).withColumn("ts", fast))


@query(
    "debounced_changes",
    """SELECT path, min(ts) AS start, max(ts) AS ts, arg_max(event, ts) AS event FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
           SELECT 'user/'||user_id||'.md' AS path, ts,
             CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event,
             CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR
                  OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events))
       GROUP BY path, burst""",
)
def _(spark, sf):
    # A gap of one hour: the events are far sparser than file changes.
    return changes.debounce(B.file_events(spark, sf), "1 hour")
