"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that parts words: blank and U+0009 to U+000D.
NOT_WHITE = "[^\\x20\\x09-\\x0D]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def packed(rows: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one struct column, so that new columns clash with none of its own."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name))
