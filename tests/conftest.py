import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from noteframe.session import tune

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="noteframe-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


GARDEN = {
    "Customers/Fern Ltd/Fern Ltd.md": """---
tags: [customer, Retail]
tpid: "771200"
status: Active
priority: 3
vip: true
last_validated: "2024-05-01"
MSX:
  accountId: "M-9"
recent_meetings:
  - path: Meetings/2024-05-20-fern.md
    date: "2024-05-20"
  - path: Meetings/2020-01-01-old.md
    date: "2020-01-01"
  - path: Meetings/nodate.md
---
# Fern Limited

Grows things. #greenhouse

## Team
- [[Ida Moss]] — Gardener
- Bo Reed (Lead)

## Opportunities
- Glass roof (`opportunityid: 01234567-89ab-cdef-0123-456789abcdef`)
- Water pump

## Milestones
- Phase one (MS-12)
- Plain goal

## Agent Insights
- 2024-01-05 wants more light
- 2024-05-28 soil is fine
- 2023-01-01: colon form

## Connect Hooks
- hook text

## Next
- [ ] Order seeds @bo
- [x] Pay bill [[Ida Moss]]
""",
    "Customers/Fern Ltd/opportunities/Roof.md": '---\nguid: "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"\nstatus: open\n---\n# Roof deal\n',
    "Customers/Fern Ltd/insights/2023-Q4.md": "- old entry\n",
    "Customers/Fern Ltd/insights/2024-Q1.md": "- first\n\n- second\n",
    "Customers/Fern Ltd/insights/2024-Q2.md": "* third\n",
    "Customers/Moor.md": "---\ntags: customer\ntpid: 5555\n---\n# Moor\nSee [[Ida Moss|Ida]] and [[Nowhere]].\n",
    "People/Ida Moss.md": "---\ntags: [person]\ncompany: Peat\norg: internal\ncustomers: [fern ltd]\n---\n# Ida Moss\nWorks on [[Fern Ltd]].\n",
    "People/bo.md": "---\ntags: [person]\n---\n# Bo Reed\n",
    "Meetings/2024-05-20-fern.md": '---\ndate: "2024-05-20"\ncustomer: Fern Ltd\naction_owners: [Bo Reed]\n---\n# Fern review\n[[Ida Moss]] and [[Customers/Fern Ltd/Fern Ltd#Team]]\n- [ ] Call back\n- [ ] Send plan [[Ida Moss]]\n- [X] Done thing\n',
    "Meetings/2019-01-01-moor.md": '---\ndate: "2019-01-01"\ncustomer: moor\n---\n# Moor visit\n',
    "Meetings/undated.md": "---\ncustomer: Moor\n---\nNo title here\n- [ ] Undated task\n",
    "Meetings/lost.md": "# Lost one\nNobody named.\n",
    "broken.md": "---\ntags: [a\n---\n# Broken\n",
    "plain.txt": "just text #inline-tag and more",
}


@pytest.fixture(scope="session")
def garden(spark):
    from pyspark.sql import functions as F

    from noteframe import NoteTables

    rows = [(path, raw, len(raw)) for path, raw in GARDEN.items()]
    raw = spark.createDataFrame(rows, "path string, raw string, length long").withColumn(
        "mtime", F.lit("2024-06-01 10:00:00").cast("timestamp")
    )
    tables = NoteTables.from_raw(raw.select("path", "raw", "mtime", "length"))
    tables.notes.cache()
    tables.links.cache()
    return tables


@pytest.fixture(scope="session")
def garden_raw(spark):
    from pyspark.sql import functions as F

    rows = [(path, raw, len(raw)) for path, raw in GARDEN.items()]
    return spark.createDataFrame(rows, "path string, raw string, length long").withColumn(
        "mtime", F.lit("2024-06-01 10:00:00").cast("timestamp")
    )
