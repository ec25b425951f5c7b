"""Joins and groupings that stay balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteframe.session import cut



def hot_keys(df: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """Every key with more than ``hot_rows`` rows and the number of shares it is split into.

    Counts are combined map-side, so a hot key itself costs nothing here. There
    are fewer than rows / ``hot_rows`` such keys. The list is written: all uses
    see the same one, and Spark knows its size.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    return cut(counts.select(*on, F.ceil(F.col("_n") / hot_rows).alias("_shares")))


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str] | str,
    how: str = "inner",
    salt_by: list[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join that stays balanced when one key of ``big`` holds most rows.

    Without ``hot_rows`` the adaptive planner splits a hot partition (see
    ``session.tune``). With it, keys of more rows are found first and salted: their rows are dealt to
    shares by a hash of ``salt_by``, and the rows of ``small`` with that key are
    repeated once per share. Both give the same rows. ``how`` is inner, left,
    left_semi or left_anti, seen from ``big``.
    """
    on = [on] if isinstance(on, str) else list(on)
    if hot_rows is None:
        return big.join(small, on, how)
    hot = hot_keys(big.where(_all_set(on)), on, hot_rows)
    salted_by = salt_by or [c for c in big.columns if c not in on] or on
    spread = F.pmod(F.xxhash64(*salted_by), F.col("_shares"))
    left = big.join(hot, on, "left")
    left = left.withColumn("_salt", F.when(F.col("_shares").isNull(), 0).otherwise(spread)).drop("_shares")
    right = small.join(hot, on, "left")
    right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)) - 1))
    ).drop("_shares")
    return left.join(right, on + ["_salt"], how).drop("_salt")


def _all_set(on: list[str]) -> Column:
    cond = F.lit(True)
    for name in on:
        cond = cond & F.col(name).isNotNull()
    return cond


def paged_collect(
    rows: DataFrame, keys: list[str], item: Column, page_by: list[str], page_rows: int = 1_000
) -> DataFrame:
    """Nest rows into sorted arrays of at most ``page_rows``, in pages where a key has more.

    A key with up to ``page_rows`` rows gives one row with page 0. A heavier key
    is dealt by hash into as many shares as it needs pages; a share that comes out
    larger is continued on further pages, so no row holds more and no task a
    whole hot group. The pages of a key partition its rows.
    """
    many = hot_keys(rows, keys, page_rows)
    share = F.when(F.col("_shares").isNull(), 0).otherwise(F.pmod(F.xxhash64(*page_by), F.col("_shares")))
    dealt = rows.join(many, keys, "left").select(
        *keys, F.coalesce("_shares", F.lit(1)).alias("_shares"), share.alias("_share"), item.alias("_item")
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_share").orderBy("_item")) - 1
    page = F.col("_share") + F.floor(place / page_rows) * F.col("_shares")
    return (
        dealt.select(*keys, page.cast("long").alias("page"), "_item")
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list("_item")).alias("items"))
    )
