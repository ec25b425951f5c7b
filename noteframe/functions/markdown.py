"""Markdown extraction as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what counts as a title, heading, link, tag, task or identifier.
TITLE = r"(?m)^#\s+(.+)$"
HEADING_2_3 = r"(?m)^#{2,3}\s+(.+)$"
SECTION_START = r"(?m)(?=^#{1,6}[^\S\n]+.)"
SECTION_HEAD = r"\A(#{1,6})[^\S\n]+([^\n]+)"
WIKILINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
INLINE_TAG = r"(?:^|\s)#([a-zA-Z][\w\-/]*)"
TASK = r"(?m)^[-*]\s+\[([ xX])\]\s+(.+)$"
GUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"
ITEM_NAME = r"^[-*]\s+(?:\[.\]\s+)?(.+?)(?:\s*[\(`]|$)"
LIST_ITEM = r"^[-*]\s+(?:\[.\]\s+)?(.+)"
MILESTONE_NO = r"(?i)(?:milestone\s*#?\s*|MS-?)(\d+)"
MEMBER_ROLE = r"^(.+?)\s*(?:—|–|-|\()\s*(.+?)(?:\))?$"
DATED_ITEM = r"^[-*]\s+(\d{4}-\d{2}-\d{2})\s+(.+)$"
ISO_DAY = r"\d{4}-\d{2}-\d{2}"


def found(column: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, NULL instead of empty text."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def _all(column: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title(path: Column, body: Column) -> Column:
    h1 = F.trim(F.regexp_extract(body, TITLE, 1))
    return F.when(F.rlike(body, F.lit(TITLE)), h1).otherwise(stem(path))


def headings(body: Column) -> Column:
    return F.transform(_all(body, HEADING_2_3, 1), lambda h: F.trim(h))


def wikilinks(body: Column) -> Column:
    return F.array_distinct(F.transform(_all(body, WIKILINK, 1), lambda t: F.trim(t)))


def inline_tags(body: Column) -> Column:
    return _all(body, INLINE_TAG, 1)


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))


def excerpt(body: Column, chars: int = 200) -> Column:
    return F.nullif(F.trim(F.replace(F.substring(body, 1, chars), F.lit("\n"), F.lit(" "))), F.lit(""))


def snippet(body: Column, chars: int = 10_000) -> Column:
    """Preview column; the search operators read the whole body."""
    return F.substring(body, 1, chars)


def ref(path: Column, heading: Column | None = None) -> Column:
    return path if heading is None else F.concat_ws("#", path, heading)


def strip(text: Column) -> Column:
    """Trim any whitespace, newlines included, as one linear pass per side."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\s+", ""), r"\s+\z", "")


def section_pieces(body: Column) -> Column:
    """Sections in text order as (level, heading, content), duplicates kept.

    The text is split before every heading line, so it is read once.
    """
    pieces = F.filter(F.split(body, SECTION_START), lambda p: F.rlike(p, F.lit(SECTION_HEAD)))
    heads = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(F.regexp_extract(p, SECTION_HEAD, 1)).alias("level"),
            F.trim(F.regexp_extract(p, SECTION_HEAD, 2)).alias("heading"),
            F.when(F.instr(p, "\n") > 0, strip(F.substr(p, F.instr(p, "\n") + 1)))
            .otherwise(F.lit(""))
            .alias("content"),
        ),
    )
    return F.filter(heads, lambda s: s["heading"] != "")


def lines(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def task_rows(body: Column) -> Column:
    """Tasks of a body as an array of (done, text, assignee)."""

    def one(match):
        words = F.trim(F.regexp_extract(match, TASK, 2))
        return F.struct(
            (F.lower(F.regexp_extract(match, TASK, 1)) == "x").alias("done"),
            words.alias("text"),
            F.coalesce(found(words, r"\[\[([^\]]+)\]\]"), found(words, r"@(\w+)")).alias("assignee"),
        )

    return F.transform(_all(body, TASK, 0), one)


def _drop_bullet(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^(.*?)[-*]\s+", "$1"))


def opportunity(line: Column) -> Column:
    """(name, guid) of one section line; NULL when the line names none."""
    guid = found(line, GUID)
    bare = F.regexp_extract(_drop_bullet(line), r"^(.*?)\s*(?:[\(`]|$)", 1)
    name = F.when(F.rlike(line, F.lit(ITEM_NAME)), F.trim(F.regexp_extract(line, ITEM_NAME, 1))).when(
        guid.isNotNull(), F.trim(bare)
    )
    return F.when(name.isNotNull(), F.struct(name.alias("name"), guid.alias("guid")))


def milestone(line: Column) -> Column:
    """(name, id, number) of one section line; NULL when the line names none."""
    guid, number = found(line, GUID), found(line, MILESTONE_NO)
    named = F.rlike(line, F.lit(ITEM_NAME))
    name = F.when(named, F.trim(F.regexp_extract(line, ITEM_NAME, 1))).otherwise(_drop_bullet(line))
    return F.when(
        named | guid.isNotNull() | number.isNotNull(),
        F.struct(name.alias("name"), guid.alias("id"), number.alias("number")),
    )


def member(line: Column) -> Column:
    """(name, role) of one team line; NULL for anything but a list item."""
    entry = F.trim(F.regexp_extract(line, LIST_ITEM, 1))
    split = F.rlike(entry, F.lit(MEMBER_ROLE))
    raw_name = F.when(split, F.regexp_extract(entry, MEMBER_ROLE, 1)).otherwise(entry)
    name = F.trim(F.regexp_replace(raw_name, r"\[\[|\]\]", ""))
    role = F.when(split, F.trim(F.regexp_extract(entry, MEMBER_ROLE, 2)))
    return F.when(
        F.rlike(line, F.lit(LIST_ITEM)), F.struct(name.alias("name"), role.alias("role"))
    )


def insight(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^[-*]\s+", ""))


def day_in(text: Column) -> Column:
    """Latest ISO day mentioned in a text, by text order of the days."""
    return F.array_max(_all(text, ISO_DAY, 0))


def iso_date(text: Column) -> Column:
    """DATE of an ISO day or timestamp text, NULL when it is no real date."""
    shaped = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"))
    return F.when(shaped, F.substring(text, 1, 10).try_cast("date"))


def folder_of(path: Column) -> Column:
    """Parent folder with a trailing slash, ``(root)`` for a top-level note."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*/)[^/]*$", 1)).otherwise("(root)")


def customer_of(path: Column, root: str) -> Column:
    """Customer name from a path below the customers root, both layouts."""
    inner = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    return F.when(F.contains(inner, F.lit("/")), F.substring_index(inner, "/", 1)).otherwise(
        F.regexp_replace(inner, r"\.(?i:md|markdown|txt)$", "")
    )
