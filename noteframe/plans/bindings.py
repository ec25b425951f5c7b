"""Note corpora rendered from the given relational and text tables.

Customers, orders, line items, parts and suppliers become markdown notes, which
then go through the full parse. Every list inside a note is bounded by its
construction: line items of one order are dealt to pages, order history enters a
note per quarter, people and parts by key ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.functions import markdown as md
from noteframe.operators.token_index import TokenIndex
from noteframe.plans.tables import NoteTables
from noteframe.session import cut, fresh_path, tune
from noteframe.sources import buckets

AS_OF = "2001-08-01"
PAGE_LINES = 200
TURNS_PER_NOTE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table with long texts; one of fewer files than cores is dealt over the cores.

    The rows are the same either way. A large table is read as it lies.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores, key)


def guid(*parts) -> Column:
    """A GUID-shaped text from a hash of the parts."""
    h = F.md5(F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat_ws(
        "-", *[F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _name(column: str) -> Column:
    return F.replace(F.col(column), F.lit("#"), F.lit(" "))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        _name("c_name").alias("n"),
        F.col("c_nationkey").alias("nat"),
        F.lower("c_mktsegment").alias("seg"),
    ).withColumn(
        "path",
        F.when(F.col("k") % 10 == 0, _text("Customers/", n, ".md")).otherwise(
            _text("Customers/", n, "/", n, ".md")
        ),
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sk"), _name("s_name").alias("sn"), F.col("s_nationkey").alias("snat")
    )


def _block(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    """Bounded list lines of a customer as one text."""
    return rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("_l")).select(
        "k", F.array_join(F.transform("_l", lambda r: r["line"]), "\n").alias(name)
    )


def _parts_of(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    """(k, i, p_name, pk): the parts with keys k, k+1, .. of each customer."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name")
    wanted = _customers(spark, sf_dir).select(
        "k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")
    ).withColumn("pk", F.col("k") + F.col("i"))
    return wanted.join(part, "pk")


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, q, d, cnt): orders per customer and quarter, combined map-side."""
    day = F.col("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_custkey").alias("k"),
            _text(F.year(day).cast("string"), "-Q", F.quarter(day).cast("string")).alias("q"),
            F.date_format(day, "yyyy-MM-dd").alias("d"),
            F.col("o_orderkey"),
        )
        .groupBy("k", "q")
        .agg(
            F.max("d").alias("d"),
            F.count(F.lit(1)).alias("cnt"),
            F.max(F.struct("d", "o_orderkey"))["o_orderkey"].alias("last_order"),
        )
    )


def _customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _customers(spark, sf_dir)
    k, i = F.col("k"), F.col("i")
    supp = _suppliers(spark, sf_dir)
    seats = cust.select("k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn(
        "sk", F.expr("k div 15 + i")
    )
    sn = F.col("sn")
    team_line = (
        F.when(i == 0, _text("- [[", sn, "]] — Architect"))
        .when(i == 1, _text("- ", sn, " (Lead)"))
        .when(i == 2, _text("- ", sn, " - Owner"))
        .otherwise(_text("- ", sn))
    )
    team = _block(seats.join(supp, "sk"), "i", team_line, "team")

    label = _text(F.col("p_name"), " ", F.col("pk").cast("string"))
    has_guid = (k + i) % 3 != 0
    g = guid("o", k.cast("string"), i.cast("string"))
    opp_line = (
        F.when(i == 0, _text("- ", label, F.when(has_guid, _text(" (`opportunityid: ", g, "`)")).otherwise("")))
        .when(i == 1, _text("- ", label, F.when(has_guid, _text(" `", g, "`")).otherwise("")))
        .otherwise(_text("* [x] ", label, F.when(has_guid, _text(" (", g, ")")).otherwise("")))
    )
    opps = _block(_parts_of(spark, sf_dir, 3), "i", opp_line, "opps")

    sep = F.when(k % 11 == 0, ": ").otherwise(" ")
    ins_line = _text("- ", F.col("d"), sep, F.col("cnt").cast("string"), " orders")
    quarters = _quarters(spark, sf_dir)
    insights = _block(quarters, "q", ins_line, "insights")
    meet_line = _text(
        "  - path: Meetings/", F.col("d"), "-", F.col("last_order").cast("string"), ".md\n",
        '    date: "', F.col("d"), '"',
    )
    recent = _block(quarters.where(k % 6 == 1), "q", meet_line, "recent")

    full = cust.join(team, "k", "left").join(opps, "k", "left").join(insights, "k", "left").join(recent, "k", "left")
    n, ks, nat, seg = F.col("n"), k.cast("string"), F.col("nat").cast("string"), F.col("seg")
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.when(k % 13 == 0, "tags: customer").otherwise(_text("tags: [customer, ", seg, "]")),
        F.when(k % 7 == 1, _text("tpid: ", (k + 100000).cast("string")))
        .when(k % 7 != 0, _text('tpid: "', (k + 100000).cast("string"), '"')),
        F.when(k % 4 == 0, _text('accountid: "ACC-', ks, '"')).when(
            k % 4 == 1, _text('MSX:\n  accountId: "MSX-', ks, '"\n  tpid: "9', ks, '"')
        ),
        _text("status: ", F.element_at(F.array(F.lit("active"), F.lit("at-risk"), F.lit("closed")), (k % 3 + 1).cast("int"))),
        _text("priority: ", nat),
        _text("vip: ", F.when(k % 5 == 0, "true").otherwise("false")),
        F.when(k % 3 == 1, _text('last_validated: "2001-07-', F.lpad((k % 28 + 1).cast("string"), 2, "0"), '"')),
        F.when(F.col("recent").isNotNull(), _text("recent_meetings:\n", F.col("recent"))),
        F.lit("---"),
    )
    stage = F.when(
        k % 4 == 0,
        _text("- Stage ", ks, " (MS-", (k * 2).cast("string"), ", `milestoneid: ", guid("s", ks), "`)"),
    ).otherwise(_text("- Stage ", ks, " (MS-", (k * 2).cast("string"), ")"))
    second = F.when(k % 3 == 0, "- Kickoff planned").otherwise(
        _text("- Milestone #", (k * 2 + 1).cast("string"), " go-live")
    )
    team_head = F.when(k % 16 == 1, "## Key Stakeholders\n").otherwise("## Team\n")
    body = F.concat_ws(
        "\n",
        F.when(k % 9 != 0, _text("# ", n, " Account\n")),
        _text("Segment account of nation. #nation-", nat),
        F.when((k % 8 != 0) & F.col("team").isNotNull(), _text(team_head, F.col("team"))),
        F.when(k % 4 != 3, _text("## Opportunities\n", F.coalesce("opps", F.lit("")))),
        _text("## Milestones\n", stage, "\n", second),
        F.when(k % 5 != 2, _text("## Agent Insights\n", F.coalesce("insights", F.lit("")), "\nReviewed quarterly.")),
        F.when(k % 2 == 0, _text("## Connect Hooks\n- Hook for ", n)),
        F.when(k % 3 == 0, _text("## Next Steps\n- [ ] Send summary @team_", nat, "\n- [x] Archive notes")),
    )
    mtime = F.timestamp_seconds(F.unix_timestamp(F.lit("2001-07-01 00:00:00")) + (k % 60) * 86400)
    return full.select("path", _text(front, "\n", body, "\n").alias("raw"), mtime.alias("mtime"))


def _sub_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _customers(spark, sf_dir).where(F.col("k") % 10 != 0)
    k, i, n = F.col("k"), F.col("i"), F.col("n")
    ks, istr = k.cast("string"), i.cast("string")
    stamp = F.lit("2001-06-15 00:00:00").cast("timestamp")
    deals = cust.where(k % 4 == 1).join(_parts_of(spark, sf_dir, 2), "k")
    deal = F.concat_ws(
        "\n",
        F.lit("---\ntags: [opportunity]"),
        F.when(i == 0, _text('guid: "', guid("d", ks, istr), '"')).when(
            k % 8 == 1, _text('opportunityId: "', guid("d", ks, istr), '"')
        ),
        F.when(i == 0, "status: open").otherwise("status: won"),
        _text('stage: "S', (k % 5).cast("string"), '"'),
        _text("owner: Owner ", F.col("nat").cast("string")),
        _text('salesplay: "Play ', istr, '"'),
        F.when(i == 0, 'last_validated: "2001-06-01"'),
        _text("---\n# ", F.col("p_name"), " deal ", ks, "-", istr, "\n"),
    )
    opp = deals.select(
        _text("Customers/", n, "/opportunities/Deal ", ks, "-", istr, ".md").alias("path"),
        deal.alias("raw"),
        stamp.alias("mtime"),
    )
    goal = F.concat_ws(
        "\n",
        F.lit("---\ntags: [milestone]"),
        F.when(k % 8 == 2, _text('milestoneId: "', guid("m", ks), '"')).otherwise(
            _text('milestone_number: "', ks, '"')
        ),
        F.lit('status: on-track\nmilestonedate: "2001-09-01"'),
        _text("opportunity: Deal ", ks, "-0"),
        _text("---\n# Milestone ", ks, "\n"),
    )
    ms = cust.where(k % 4 == 2).select(
        _text("Customers/", n, "/milestones/M ", ks, ".md").alias("path"), goal.alias("raw"), stamp.alias("mtime")
    )
    q = F.col("q")
    ins = cust.where(k % 5 == 1).join(_quarters(spark, sf_dir), "k").select(
        _text("Customers/", n, "/insights/", q, ".md").alias("path"),
        _text("- ", F.col("d"), " ", F.col("cnt").cast("string"), " orders\n\nClosed ", q, "\n").alias("raw"),
        stamp.alias("mtime"),
    )
    return opp.unionByName(ms).unionByName(ins)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their page within the order, by line number.

    A line of a further page also stands, with ``own`` false, for the first page of its order, which every order has.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity"
    )
    page = F.expr(f"(l_linenumber - 1) div {PAGE_LINES}")
    rows = rows.withColumn("_page", page).where("_page >= 0")
    pages = F.when(F.col("_page") > 0, F.array("_page", F.lit(0).cast("long"))).otherwise(F.array("_page"))
    return rows.withColumn("page", F.explode(pages)).withColumn("own", F.col("page") == F.col("_page")).drop("_page")


def _meeting_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    supp = _suppliers(spark, sf_dir)
    lines = _lines(spark, sf_dir).join(supp, F.col("l_suppkey") == F.col("sk"))
    own, sn = F.col("own"), F.col("sn")
    box = F.when(F.col("l_linestatus") == "F", "x").otherwise(" ")
    task = _text(
        "- [", box, "] Ship part ", F.col("l_partkey").cast("string"), " line ",
        F.col("l_linenumber").cast("string"), " @Supplier_", F.col("l_suppkey").cast("string"),
    )
    # Lines are dealt by order once, before they become text, and meet their order where they lie.
    dealt = lines.select("l_orderkey", "page", "own", "l_partkey", "l_linenumber", "l_suppkey", "l_linestatus", "sn")
    pages = dealt.repartition("l_orderkey").groupBy("l_orderkey", "page").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(own, task))), "\n").alias("tasks"),
        F.sort_array(F.collect_set(F.when(own, sn))).alias("people"),
        F.sort_array(F.collect_set(F.when(own & (F.col("l_linestatus") == "O"), sn))).alias("owners"),
    )
    orders = table(spark, sf_dir, "orders").join(
        _customers(spark, sf_dir).select(F.col("k").alias("o_custkey"), "n"), "o_custkey"
    )
    full = orders.join(pages, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    full = full.withColumn("page", F.coalesce("page", F.lit(0).cast("long")))
    ok, ck, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    tracked = ck % 50 != 0
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        _text("tags: [meeting, ", F.lower("o_orderpriority"), "]"),
        F.when(ok % 40 == 7, _text("date: ", day))
        .when(ok % 40 == 11, 'date: "soon"')
        .when(ok % 40 != 9, _text('date: "', day, '"')),
        F.when(tracked, _text("customer: ", n)),
        _text("status: ", F.col("o_orderstatus")),
        _text("total: ", F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.when(
            (ok % 2 == 0) & (F.size("owners") > 0), _text("action_owners: [", F.array_join("owners", ", "), "]")
        ),
        F.lit("---"),
    )
    path_link = F.when(ck % 10 == 0, _text("[[Customers/", n, "]]")).otherwise(
        _text("[[Customers/", n, "/", n, "]]")
    )
    link = (
        F.when(ok % 3 == 0, _text("[[", n, "]]"))
        .when(ok % 3 == 1, _text("[[", n, "|the account]]"))
        .otherwise(path_link)
    )
    people = F.array_join(F.transform("people", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    body = F.concat_ws(
        "\n",
        _text("# Order ", ok.cast("string"), " review\n"),
        _text("## Attendees\n", F.coalesce(people, F.lit(""))),
        F.lit("## Discussion"),
        F.when(tracked, _text("Account ", link, " reviewed.")),
        _text("## Action Items\n", F.coalesce("tasks", F.lit(""))),
    )
    path = _text(
        "Meetings/", day, "-", ok.cast("string"),
        F.when(F.col("page") > 0, _text("-p", F.col("page").cast("string"))).otherwise(""), ".md",
    )
    mtime = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 9 HOURS")
    return full.select(path.alias("path"), _text(front, "\n", body, "\n").alias("raw"), mtime.alias("mtime"))


def _people_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _customers(spark, sf_dir).select(F.expr("k div 15").alias("sk"), "k", "n")
    lists = known.groupBy("sk").agg(F.sort_array(F.collect_list("n")).alias("customers"))
    s = _suppliers(spark, sf_dir).join(lists, "sk", "left")
    k, sn = F.col("sk"), F.col("sn")
    kind = F.when(k % 2 == 0, "internal").otherwise("partner")
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        _text("tags: [person, ", kind, "]"),
        _text("company: Firm ", F.col("snat").cast("string")),
        F.when(k % 5 != 0, _text("org: ", kind)),
        F.when(
            (k % 7 != 3) & F.col("customers").isNotNull(),
            _text("customers: [", F.array_join("customers", ", "), "]"),
        ),
        _text('email: "s', k.cast("string"), '@example.com"'),
        F.lit("---"),
    )
    body = F.concat_ws(
        "\n",
        _text("# ", F.when(k % 6 == 0, _text("Person ", k.cast("string"))).otherwise(sn)),
        F.when(F.col("customers").isNotNull(), _text("Supports [[", F.element_at("customers", 1), "]].")),
    )
    return s.select(
        _text("People/", sn, ".md").alias("path"),
        _text(front, "\n", body, "\n").alias("raw"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("mtime"),
    )


def relational_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw notes of the whole relational data set."""
    parts = [f(spark, sf_dir) for f in (_customer_notes, _sub_notes, _meeting_notes, _people_notes)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.withColumn("length", F.length("raw").cast("long"))


_RAW: dict[tuple[str, str], DataFrame] = {}
_CORPORA: dict[tuple[str, str], NoteTables] = {}


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered notes, written once per application as files would be."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RAW:
        _RAW[key] = cut(relational_notes(spark, sf_dir))
    return _RAW[key]


def corpus(spark: SparkSession, sf_dir: str) -> NoteTables:
    """The parsed relational corpus, indexed once per application.

    The index is a Parquet snapshot in the shared folder, as a user would keep
    it; every query reads the columns it needs from there. The rendered notes are parsed
    as they come, unless they have been written for another use before.
    """
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        root = fresh_path(spark, "corpus")
        raw = _RAW[key] if key in _RAW else relational_notes(spark, sf_dir)
        _CORPORA[key] = NoteTables.from_raw(raw).save(spark, root)
    return _CORPORA[key]


_STORES: dict = {}


def bucket_store(spark: SparkSession, sf_dir: str) -> buckets.BucketStore:
    """The relational corpus as a bucketed snapshot, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = buckets.create(spark, fresh_path(spark, "buckets"), corpus(spark, sf_dir).notes, count=32)
    return _STORES[key]


def refreshed_store(spark: SparkSession, sf_dir: str) -> buckets.BucketStore:
    """``bucket_store`` after two batches: some customers leave, half of them come back."""
    key = (spark.sparkContext.applicationId, sf_dir, "refreshed")
    if key not in _STORES:
        raw, left = raw_corpus(spark, sf_dir), _customers(spark, sf_dir).where("k % 9 = 0")
        store = buckets.apply_batch(bucket_store(spark, sf_dir), raw.limit(0), left.select("path"))
        back = raw.join(left.where("k % 18 = 0").select("path"), "path", "left_semi")
        _STORES[key] = buckets.apply_batch(store, back)
    return _STORES[key]


def restored_store(spark: SparkSession, sf_dir: str) -> buckets.BucketStore:
    """``refreshed_store`` after a third batch, with which the other half comes back: all notes again."""
    key = (spark.sparkContext.applicationId, sf_dir, "restored")
    if key not in _STORES:
        left = _customers(spark, sf_dir).where("k % 9 = 0 AND k % 18 <> 0").select("path")
        back = raw_corpus(spark, sf_dir).join(left, "path", "left_semi")
        _STORES[key] = buckets.apply_batch(refreshed_store(spark, sf_dir), back)
    return _STORES[key]


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: first line as title, language and source as tags."""
    tune(spark)
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.to_json(F.struct("quality", "toxic")).alias("_fm"),
    )
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.trim(F.substring_index("text", "\n", 1)).alias("title"),
        F.array("lang", "source").alias("tags"),
        F.array().cast("array<string>").alias("headings"),
        F.col("text").alias("body"),
        F.try_parse_json(F.coalesce("_fm", F.lit("{}"))).alias("frontmatter"),
        F.lit(None).cast("timestamp").alias("mtime"),
    )


_INDEXES: dict = {}


def document_index(spark: SparkSession, sf_dir: str) -> tuple[TokenIndex, DataFrame]:
    """The token index of the document notes and their (path, title), written once per application."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        notes = document_notes(spark, sf_dir)
        _INDEXES[key] = TokenIndex.build(spark, fresh_path(spark, "index"), notes), cut(notes.select("path", "title"))
    return _INDEXES[key]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an edit log, one entry per event."""
    tune(spark)
    return table(spark, sf_dir, "events").select(
        "ts",
        F.to_date("ts").alias("log_date"),
        F.when(F.col("value") >= 10, "gated").otherwise("auto").alias("tier"),
        F.col("event_type").alias("operation"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("props").alias("detail"),
    )


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes: (ts, path, event)."""
    tune(spark)
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink")
    return table(spark, sf_dir, "events").select(
        "ts",
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        kind.otherwise("change").alias("event"),
        "event_id",
    )


def customers_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer notes tagged with a code of every part they ordered: (path, tags), often dozens of tags."""
    tune(spark)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 200).cast("string").alias("tag"))
    bought = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey")
    tags = bought.groupBy("c_custkey").agg(F.collect_set("tag").alias("tags"))  # at most 200 codes
    return table(spark, sf_dir, "customer").select("c_custkey").join(tags, "c_custkey", "left").select(
        F.concat(F.lit("Customers/C"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-line notes with JSON frontmatter."""
    tune(spark)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"),
        F.try_parse_json("props").alias("frontmatter"),
    )


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes with a section per turn, 50 turns to a note."""
    tune(spark)
    turns = table(spark, sf_dir, "conversations")
    page = F.expr(f"turn div {TURNS_PER_NOTE}")
    block = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"))
    return (
        turns.groupBy("conv_id", page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("block")))).alias("_t"))
        .select(
            F.concat_ws("", F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("page").cast("string"), F.lit(".md")).alias("path"),
            F.array_join(F.transform("_t", lambda t: t["block"]), "\n").alias("body"),
        )
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their ``<h1>`` title and link targets."""
    tune(spark)
    html = F.col("html")
    return text_table(spark, sf_dir, "pages", "page_id").select(
        "page_id",
        F.trim(md.found(html, r"(?s)<h1>(.*?)</h1>")).alias("title"),
        F.array_distinct(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("hrefs"),
    )
