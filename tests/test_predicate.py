from noteframe.operators import predicate as Q
from noteframe.operators import validate as V


def found(garden, **options):
    return [r.path for r in Q.query_notes(garden.notes, Q.QueryOptions(**options)).collect()]


FERN = "Customers/Fern Ltd/Fern Ltd.md"


def test_fields(garden):
    assert found(garden, where={"status": "ACTIVE"}) == [FERN]
    assert found(garden, where={"customers": "FERN LTD"}) == ["People/Ida Moss.md"]
    assert found(garden, where={"priority": 3}) == [FERN]
    assert found(garden, where={"priority": 3.0}) == [FERN]
    assert found(garden, where={"priority": "3"}) == []
    assert found(garden, where={"vip": True}) == [FERN]
    assert found(garden, where={"vip": 1}) == []
    assert found(garden, where={"tags": ["CUSTOMER", "retail"]}) == [FERN]
    assert set(found(garden, where={"tags": "Customer"})) == {FERN, "Customers/Moor.md"}
    assert found(garden, where={"tags": ["customer", "nope"]}) == []
    assert set(found(garden, where={"folder": "People/"})) == {"People/Ida Moss.md", "People/bo.md"}


def test_and_or_folder(garden):
    assert found(garden, where={"tags": "customer"}, all_of=[{"vip": True}]) == [FERN]
    assert found(garden, where={"tags": "person"}, any_of=[{"vip": True}, {"company": "peat"}]) == ["People/Ida Moss.md"]
    assert found(garden, where={"customer": "moor"}, folder="Meetings/2019") == ["Meetings/2019-01-01-moor.md"]


def test_order_and_limit(garden):
    order = found(garden, folder="Meetings/", order_by="date")
    assert order == ["Meetings/lost.md", "Meetings/undated.md", "Meetings/2019-01-01-moor.md", "Meetings/2024-05-20-fern.md"]
    assert found(garden, folder="Meetings/", order_by="-date", limit=1) == ["Meetings/2024-05-20-fern.md"]
    assert found(garden, folder="Meetings/", order_by="title")[0] == "Meetings/2024-05-20-fern.md"


def test_lookup_and_tag(garden):
    assert [r.path for r in Q.frontmatter_lookup(garden.fields, "TPID", "712").collect()] == [FERN]
    assert [r.path for r in Q.notes_by_tag(garden.notes, "Retail").collect()] == [FERN]
    assert Q.notes_by_tag(garden.notes, "retail").count() == 0


def test_validation(spark):
    rows = [
        ("01234567-89ab-cdef-0123-456789abcdef", "2024-02-29", "a/b.md", "Fern"),
        ("nope", "2024-02-30", "/etc/x", "a/b"),
        (None, "2024-01-01T10:00:00Z", "a/../../b", ".."),
        ("x", "2024-13-01", "C:\\x", ""),
        ("x", "someday", "..\\up.md", "a\x00"),
        ("x", "2024-1-1", "x" * 501, "n" * 201),
    ]
    df = spark.createDataFrame(rows, "g string, d string, p string, n string")
    reasons = lambda col, rule: [r.reason for r in V.checked(df, {col: rule}).collect()]
    assert reasons("g", "guid") == [None] + ["g: not a GUID"] * 5
    assert [r is None for r in reasons("d", "date")] == [True, False, True, False, False, False]
    assert reasons("p", "path") == [
        None, "p: absolute path", "p: path leaves the root", "p: absolute path", "p: path leaves the root", "p: path longer than 500",
    ]
    assert reasons("n", "name") == [
        None, "n: name holds a separator", "n: name holds dots", "n: empty name", "n: name holds a null byte", "n: name longer than 200",
    ]
    good, bad = V.validate_rows(df, {"g": "guid", "d": "date", "p": "path", "n": "name"})
    assert good.count() == 1 and bad.count() == 5
