"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. The notes are
rendered first; their index build is timed, the queries then run on the index. Every query answers a whole
batch: all customers, people or notes at once, or all search words.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from noteframe.plans import bindings  # noqa: E402
from noteframe.plans.catalog import CATALOG  # noqa: E402

HEADLINE = [
    "corpus_stats",
    "most_linked",
    "top_tags",
    "note_metadata",
    "query_notes_and",
    "frontmatter_lookup",
    "lexical_search",
    "fuzzy_search",
    "content_search",
    "search_cascade",
    "search_full",
    "search_broad",
    "lexical_search_bulk",
    "backlinks",
    "related_filtered",
    "open_items",
    "customer_freshness",
    "health_issues",
    "prefetch_filters",
    "customer_context",
    "customer_context_brief",
    "person_context",
    "edit_results",
    "promote_routing",
    "incremental_diff",
    "latest_state",
    "resolved_links",
    "similar_customers",
    "overview",
    "health_report",
    "runtime_health",
    "correlate_person",
    "correlate_customer",
    "debounced_changes",
    "applied_decisions",
    "promoted_notes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)

    bindings.raw_corpus(spark, sf_dir)  # the notes to index; not part of the work
    timed("index_build", lambda: bindings.corpus(spark, sf_dir))
    for name in HEADLINE:
        run = CATALOG[name].run
        # The noop sink computes every column of every row and keeps nothing.
        timed(name, lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "note_corpus_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
