"""Frontmatter predicates compiled to one Spark filter."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteframe.config import DEFAULT, NoteConfig
from noteframe.functions import frontmatter as fm
from noteframe.functions import markdown as md
from noteframe.session import cut

NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


@dataclass(frozen=True)
class QueryOptions:
    """``where`` and every entry of ``all_of`` and one entry of ``any_of``."""

    where: dict = field(default_factory=dict)
    all_of: list = field(default_factory=list)
    any_of: list = field(default_factory=list)
    order_by: str | None = None
    limit: int | None = None
    folder: str | None = None


def _any_tag(tag: str) -> Column:
    return F.exists("tags", lambda t: F.lower(t) == tag.lower())


def _tags_match(expected) -> Column:
    if isinstance(expected, str):
        return _any_tag(expected)
    if isinstance(expected, (list, tuple)):
        if not all(isinstance(tag, str) for tag in expected):
            return F.lit(False)
        return reduce(Column.__and__, [_any_tag(tag) for tag in expected], F.lit(True))
    return F.lit(False)


def strictly_equal(variant: Column, expected) -> Column:
    """Same kind and same value; text is compared with its letter case."""
    shape = fm.kind(variant)
    if expected is None:
        hit = shape == "VOID"
    elif isinstance(expected, bool):
        hit = (shape == "BOOLEAN") & (F.try_variant_get(variant, "$", "boolean") == F.lit(expected))
    elif isinstance(expected, (int, float)):
        number = F.try_variant_get(variant, "$", "double")
        hit = F.rlike(shape, F.lit(NUMERIC)) & (number == F.lit(float(expected)))
    elif isinstance(expected, str):
        hit = fm.string_only(variant) == expected
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def field_matches(key: str, expected, config: NoteConfig = DEFAULT) -> Column:
    """One field of a predicate as a boolean column, never NULL."""
    if key in ("tags", config.tags_field):
        return F.coalesce(_tags_match(expected), F.lit(False))
    if key == "folder":
        return F.startswith(F.col("path"), F.lit(expected)) if isinstance(expected, str) else F.lit(False)
    name = config.physical_field(key)
    actual = fm.value(F.col("frontmatter"), name)
    if isinstance(expected, str):
        same = F.lower(fm.string_only(actual)) == expected.lower()
        member = F.exists(fm.strings(F.col("frontmatter"), name), lambda v: F.lower(v) == expected.lower())
        return F.coalesce(F.when(fm.is_array(actual), member).otherwise(same), F.lit(False))
    return strictly_equal(actual, expected)


def predicate(fields: dict, config: NoteConfig = DEFAULT) -> Column:
    return reduce(Column.__and__, [field_matches(k, v, config) for k, v in fields.items()], F.lit(True))


def _order(order_by: str, config: NoteConfig) -> list[Column]:
    """Sort keys: absent first, then days, numbers and text; path breaks ties."""
    down = order_by.startswith("-")
    name = order_by.removeprefix("-")
    if name in ("title", "path"):
        text, number = F.col(name), F.lit(None).cast("double")
    else:
        front, key = F.col("frontmatter"), config.physical_field(name)
        text = fm.scalar_text(front, key)
        number = F.when(
            F.rlike(fm.kind(fm.value(front, key)), F.lit(NUMERIC)), F.try_variant_get(front, fm.key_path(key), "double")
        )
    keys = [text.isNotNull(), md.iso_date(text), number, F.collate(text, "UNICODE")]
    directed = [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]
    return directed + [F.col("path").asc()]


def query_notes(notes: DataFrame, options: QueryOptions, config: NoteConfig = DEFAULT) -> DataFrame:
    """(path, title, tags) of matching notes, in order if one is asked for."""
    cond = predicate(options.where, config)
    for fields in options.all_of:
        cond = cond & predicate(fields, config)
    if options.any_of:
        cond = cond & reduce(Column.__or__, [predicate(fields, config) for fields in options.any_of])
    out = notes_by_folder(notes, options.folder or "").where(cond)
    if options.order_by:
        out = out.orderBy(*_order(options.order_by, config))
    if options.limit:
        out = out.limit(options.limit)
    return out.select("path", "title", "tags")


def notes_by_folder(notes: DataFrame, folder: str) -> DataFrame:
    """Notes below a path prefix; a prefix with a slash also prunes partitions."""
    if not folder:
        return notes
    cond = F.startswith(F.col("path"), F.lit(folder))
    if "root" in notes.columns and "/" in folder:
        cond = cond & (F.col("root") == folder.split("/")[0])
    return notes.where(cond)


def notes_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    """Notes with exactly this tag, letter case included."""
    return notes.where(F.array_contains("tags", tag))


def search_filter(
    folder: str | None = None, tags: list[str] | None = None, frontmatter: dict | None = None
) -> Column:
    """Filter of searches and traversals: prefix, any tag as written, strict values."""
    cond = F.lit(True)
    if folder:
        cond = cond & F.startswith(F.col("path"), F.lit(folder))
    if tags:
        cond = cond & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    for key, expected in (frontmatter or {}).items():
        cond = cond & strictly_equal(fm.value(F.col("frontmatter"), key), expected)
    return cond


def frontmatter_lookup(
    fields: DataFrame, key: str, fragment: str, limit: int | None = None
) -> DataFrame:
    """Distinct paths with a value of ``key`` containing the fragment."""
    hits = fields.where(
        (F.col("key") == key.lower()) & F.contains(F.col("value"), F.lit(fragment.lower()))
    )
    paths = hits.select("path").distinct()
    return paths.orderBy("path").limit(limit) if limit else paths


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """A sorted table with the number of each row, from 1.

    The sort ranges the rows over tasks; each task numbers its own, and the counts of the tasks before are added. Only these counts, one for
    each task, meet in one place.
    """
    rows = cut(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
    place = (F.col("_before") + inside + 1).alias(name)
    return rows.join(F.broadcast(offsets), "_part").select(*ordered.columns, place)
