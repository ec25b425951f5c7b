import pytest
from pyspark.sql import functions as F

from noteframe.operators import links as L
from noteframe.operators import predicate as Q
from noteframe.operators import skew
from noteframe.operators import stats as A

FERN = "Customers/Fern Ltd/Fern Ltd.md"


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_resolution_by_path_title_and_stem(garden):
    got = {(r.src, r.target): r.dst for r in garden.links.collect()}
    assert got[("Customers/Moor.md", "Ida Moss")] == "People/Ida Moss.md"
    assert got[("Customers/Moor.md", "Nowhere")] is None
    assert got[("Meetings/2024-05-20-fern.md", "Customers/Fern Ltd/Fern Ltd")] == FERN
    assert got[("People/Ida Moss.md", "Fern Ltd")] == FERN


def test_back_and_forward_links(spark, garden):
    back = L.backlinks(garden.links, garden.notes, paths(spark, "People/Ida Moss.md")).collect()
    assert {r.path for r in back} == {"Customers/Moor.md", FERN, "Meetings/2024-05-20-fern.md"}
    out = L.forward_links(garden.links, garden.notes, paths(spark, "Customers/Moor.md")).collect()
    assert [(r.seed, r.path, r.title) for r in out] == [("Customers/Moor.md", "People/Ida Moss.md", "Ida Moss")]


def brute_hops(edges, seed, hops):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, frontier, found = {seed}, {seed}, {}
    for hop in range(1, hops + 1):
        frontier = {n for f in frontier for n in near.get(f, ()) if n not in seen}
        seen |= frontier
        found.update({n: hop for n in frontier})
    return found


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_hops_match_a_walk_also_through_a_hub(spark, hot_rows):
    edge_list = [(f"n{i}", "hub") for i in range(20)] + [("hub", "far"), ("far", "end"), ("n0", "n1"), ("n1", "n0"), ("end", "end")]
    links = spark.createDataFrame([(a, b, b) for a, b in edge_list], "src string, target string, dst string")
    names = {n for e in edge_list for n in e}
    notes = spark.createDataFrame([(n, n, ["t"] if n == "n3" else []) for n in names], "path string, title string, tags array<string>")
    seeds = ["n0", "end", "n7"]
    for hops in (1, 2, 6):
        rows = L.related_notes(links, notes, paths(spark, *seeds), hops, hot_rows=hot_rows).collect()
        for seed in seeds:
            assert {r.path: r.hop for r in rows if r.seed == seed} == brute_hops(edge_list, seed, hops)
    rows = L.related_notes(links, notes, paths(spark, "n0"), 2, Q.search_filter(tags=["t"]), hot_rows).collect()
    assert [r.path for r in rows] == ["n3"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    big = spark.createDataFrame(
        [("hot", i) for i in range(50)] + [("warm", i) for i in range(3)] + [("gone", 1), (None, 2)], "k string, v int"
    )
    small = spark.createDataFrame([("hot", "x"), ("warm", "y"), ("warm", "z"), ("other", "q")], "k string, w string")
    plain = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    spread = skew.spread_join(big, small, "k", how, salt_by=["v"], hot_rows=10)
    assert sorted(map(tuple, spread.collect()), key=str) == plain


def test_paged_collect_keeps_every_row(spark):
    rows = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 1), ("b", 0)], "k string, v int")
    pages = skew.paged_collect(rows, ["k"], F.col("v"), ["v"], page_rows=10).collect()
    assert sorted(v for p in pages if p.k == "a" for v in p["items"]) == list(range(25))
    assert len([p for p in pages if p.k == "a"]) > 1
    assert [(p.page, p["items"]) for p in pages if p.k == "b"] == [(0, [0, 1])]


def test_no_page_is_larger_than_asked_for(spark):
    rows = spark.range(3_000).selectExpr("id AS k", "explode(sequence(1, 5)) AS v").union(
        spark.range(20_000).selectExpr("-1L AS k", "cast(id AS int) AS v")
    )
    pages = skew.paged_collect(rows, ["k"], F.col("v"), ["v"], page_rows=2)
    sizes = pages.select("k", "page", F.size("items").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] == 2
    assert sizes.agg(F.sum("n")).first()[0] == 35_000
    assert sizes.select("k", "page").distinct().count() == sizes.count()
    # Rows that are dealt alike still fill several pages.
    alike = skew.paged_collect(rows.where("k = -1").limit(100), ["k"], F.col("v"), ["k"], page_rows=30)
    assert sorted(len(r["items"]) for r in alike.collect()) == [10, 30, 30, 30]


def test_stats(garden):
    row = A.corpus_stats(garden.notes, garden.links).first()
    assert row.note_count == 13
    assert row.link_count == garden.edges.count() == 5
    assert A.most_linked(garden.notes, garden.links, 1).first().path == "People/Ida Moss.md"
    assert A.top_tags(garden.notes, 1).first().asDict() == {"tag": "customer", "note_count": 2}
    folders = {r.folder: r.note_count for r in A.folder_counts(garden.notes).collect()}
    assert folders["/"] == 13 and folders["Customers"] == 6 and folders["Customers/Fern Ltd/insights"] == 3
    parts = {r.part for r in A.overview(garden.notes, garden.links).collect()}
    assert parts == {"stats", "top_tag", "most_linked", "folder"}


def test_traverse_directions(spark, garden):
    seeds = paths(spark, "People/Ida Moss.md")
    count = lambda d: L.traverse(garden.links, garden.notes, seeds, d, 1).count()
    assert (count("in"), count("out"), count("neighborhood")) == (3, 1, 3)
    with pytest.raises(ValueError):
        L.traverse(garden.links, garden.notes, seeds, "sideways")


def test_title_dictionary_takes_the_last_path(spark):
    notes = spark.createDataFrame([("a/x.md", "Same"), ("b/y.md", "same")], "path string, title string")
    assert {r.key: r.path for r in L.title_dict(notes).collect()} == {"same": "b/y.md", "x": "a/x.md", "y": "b/y.md"}


def test_last_hop_is_not_written(spark, monkeypatch):
    """Only the edges and the hops that conduct are written; the last hop goes straight to its titles."""
    links = spark.createDataFrame([("a", "h"), ("b", "h"), ("h", "c")], "src string, dst string")
    notes = spark.createDataFrame([(n, n.upper(), ["t"]) for n in "abch"], "path string, title string, tags array<string>")
    written = []
    monkeypatch.setattr(L, "cut", lambda df: written.append(df.columns) or df)
    found = L.related_notes(links, notes, paths(spark, "a"), 2)
    assert {(r.path, r.hop, r.title) for r in found.collect()} == {("h", 1, "H"), ("b", 2, "B"), ("c", 2, "C")}
    assert written == [["src", "dst"], ["seed", "node", "hop"]]
