"""Run registered queries next to their SQL: python tests/compare.py sf0.01 [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES: list[float] = []


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) else round(value, 9))
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def family(kind) -> str:
    """Broad type family of a Spark or DuckDB type name."""
    kind = str(kind).lower()
    for name, words in {
        "integer": ("int", "long", "short"),
        "floating": ("double", "float"),
        "decimal": ("decimal",),
        "text": ("string", "varchar"),
        "boolean": ("bool",),
        "time": ("timestamp",),
        "day": ("date",),
    }.items():
        if any(w in kind for w in words):
            return name
    return kind


def compare(spark, con, query, sf_dir):
    """(problem or None, row count)."""
    start = time.time()
    df = query.run(spark, sf_dir)
    ours_names, ours = rows_of(df.columns, df.collect())
    TIMES.append(time.time() - start)
    if query.sql is None:
        return None, sum(ours.values())
    res = con.execute(query.sql)
    names = [d[0] for d in res.description]
    want_names, want = rows_of(names, res.fetchall())
    count = sum(ours.values())
    kinds = {f.name: family(f.dataType) for f in df.schema}
    want_kinds = {d[0]: family(d[1]) for d in res.description}
    if kinds != want_kinds and count:
        odd = {n: (kinds[n], want_kinds.get(n)) for n in kinds if kinds[n] != want_kinds.get(n)}
        return f"types differ {odd}", count
    if ours_names != want_names:
        return f"columns {ours_names} != {want_names}", count
    if ours != want:
        extra, missing = ours - want, want - ours
        return (
            f"{sum(extra.values())} extra {list(extra)[:2]}\n      {sum(missing.values())} missing {list(missing)[:2]}",
            count,
        )
    return None, count


def main():
    from pyspark.sql import SparkSession

    from noteframe.plans.catalog import CATALOG

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(CATALOG)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, count = compare(spark, con, CATALOG[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        spent = TIMES[-1] if TIMES else 0.0
        print(f"{'FAIL' if problem else 'ok':5}{name:28}{count:8}{spent:8.2f}s of {time.time() - start:.2f}s", flush=True)
        if problem:
            print("      " + problem, flush=True)
    print(f"{bad} of {len(names)} differ", flush=True)


if __name__ == "__main__":
    main()
