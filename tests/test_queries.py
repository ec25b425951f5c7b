"""Registered queries against their SQL at the smallest scale.

A spread of operators by default; NOTEFRAME_ALL=1 runs every query.
"""

import os

import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_point
from noteframe.plans.catalog import CATALOG

from compare import compare, connect

SF = "/root/testdata/sf0.001"
CORE = [
    "note_headings", "note_tags", "read_sections", "action_items", "opportunities", "milestones", "recent_insights",
    "customer_meetings", "query_notes_or", "query_notes_order", "frontmatter_lookup", "resolve_titles", "resolved_links",
    "related_filtered", "similar_customers", "open_items", "correlate_person", "corpus_stats", "folder_counts",
    "customer_freshness", "prefetch_filters", "lexical_search", "lexical_search_bulk", "search_broad", "edit_results",
    "edit_append", "promote_routing", "debounced_changes", "health_issues", "search_blank", "applied_decisions", "promoted_notes",
]
EMPTY = {"query_notes_strict"}  # a literal of another type matches nothing
NAMES = list(CATALOG) if os.environ.get("NOTEFRAME_ALL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem, count = compare(spark, con, CATALOG[name], SF)
    assert problem is None
    assert count > 0 or name in EMPTY


def test_entry_point_lists_match():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_flagship_has_rows(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["customer", "part", "key", "label", "detail"] and df.count() > 0
