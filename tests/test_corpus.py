import datetime
import re

from noteframe.plans import bindings as B


def relational(spark, folder, lines):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    day = datetime.date(1996, 3, 4)
    save("customer", [(7, "Customer#7", 1, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    save("supplier", [(1, "Supplier#1", 2), (2, "Supplier#2", 3)], "s_suppkey long, s_name string, s_nationkey int")
    save(
        "orders",
        [(10, 7, day, "O", 5.0, "1-URGENT"), (11, 7, day, "O", 6.0, "1-URGENT"), (12, 7, day, "F", 7.0, "1-URGENT")],
        "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_totalprice double, o_orderpriority string",
    )
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_quantity double"
    save("lineitem", lines, schema)
    return str(folder)


LINES = [(10, 1, 5, 1, "O", 1.0), (10, 201, 6, 2, "F", 1.0), (10, 202, 6, 9, "F", 1.0)]
LINES += [(11, 450, 8, 2, "O", 1.0), (11, None, 8, 1, "O", 1.0), (99, 1, 5, 1, "O", 1.0)]


def test_pages_of_an_order(spark, tmp_path):
    """Every order has a first page, also where all its lines are on later ones; unknown suppliers and lines without number are left out."""
    found = {r.path: r.raw for r in B._meeting_notes(spark, relational(spark, tmp_path / "t", LINES)).collect()}
    names = ["10", "10-p1", "11", "11-p2", "12"]
    assert set(found) == {f"Meetings/1996-03-04-{n}.md" for n in names}
    tasks = {n: re.findall(r"(?m)^- \[.\] .*$", found[f"Meetings/1996-03-04-{n}.md"]) for n in names}
    assert tasks["10"] == ["- [ ] Ship part 5 line 1 @Supplier_1"]
    assert tasks["10-p1"] == ["- [x] Ship part 6 line 201 @Supplier_2"]
    assert tasks["11-p2"] == ["- [ ] Ship part 8 line 450 @Supplier_2"]
    assert tasks["11"] == tasks["12"] == []
    people = {n: re.findall(r"\[\[Supplier (\d)\]\]", found[f"Meetings/1996-03-04-{n}.md"]) for n in names}
    assert people == {"10": ["1"], "10-p1": ["2"], "11": [], "11-p2": ["2"], "12": []}
    assert "action_owners: [Supplier 1]" in found["Meetings/1996-03-04-10.md"]
    assert "action_owners" not in found["Meetings/1996-03-04-10-p1.md"]


def test_lines_are_read_and_dealt_once(spark, tmp_path):
    """Lines and orders are scanned once, and pages meet their orders where they were made."""
    plan = B._meeting_notes(spark, relational(spark, tmp_path / "t", LINES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet [l_") == plan.count("Scan parquet [o_") == 1
    assert len(re.findall(r"hashpartitioning\(l_orderkey", plan)) <= 1


def test_corpus_does_not_write_the_raw_notes_first(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(B, "cut", lambda df: written.append(df.columns) or df)
    folder = relational(spark, tmp_path / "t", LINES)
    spark.createDataFrame([(7, "bolt"), (8, "nut")], "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    tables = B.corpus(spark, folder)
    assert tables.notes.count() > 5 and not written
