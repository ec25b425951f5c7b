"""Raw notes to the notes table, and the long tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.config import DEFAULT, NoteConfig
from noteframe.functions import frontmatter as fm
from noteframe.functions import markdown as md


def _split(raw_notes: DataFrame) -> DataFrame:
    clean = raw_notes.withColumn("raw", F.replace("raw", F.lit("\r\n"), F.lit("\n")))
    block, body = fm.split_note(F.col("raw"))
    parts = clean.withColumn("_block", block).withColumn("body", body)
    # Python sees the frontmatter block alone, never the body.
    return parts.withColumn("_json", fm.yaml_to_json(F.col("_block")))


def _broken():
    return F.col("_block").isNotNull() & F.col("_json").isNull()


def parse_notes(raw_notes: DataFrame, config: NoteConfig = DEFAULT) -> DataFrame:
    """One row per readable note. Narrow: no shuffle, one Arrow call for YAML."""
    parsed = _split(raw_notes).where(~_broken())
    parsed = parsed.withColumn(
        "frontmatter", F.try_parse_json(F.coalesce("_json", F.lit("{}")))
    )
    tag_field = F.col("frontmatter")
    listed = fm.strings(tag_field, config.tags_field)
    single = fm.text(tag_field, config.tags_field)
    declared = F.coalesce(listed, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))
    body = F.col("body")
    return parsed.select(
        "path",
        md.title(F.col("path"), body).alias("title"),
        F.array_distinct(F.concat(declared, md.inline_tags(body))).alias("tags"),
        md.headings(body).alias("headings"),
        "body",
        "frontmatter",
        md.wikilinks(body).alias("raw_links"),
        md.word_count(body).alias("word_count"),
        "mtime",
        "raw",
    )


def note_errors(raw_notes: DataFrame) -> DataFrame:
    """Notes whose frontmatter does not parse."""
    return _split(raw_notes).where(_broken()).select(
        "path", F.lit("frontmatter is not valid YAML").alias("reason")
    )


def note_tags(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode("tags").alias("tag"))


def note_sections(notes: DataFrame) -> DataFrame:
    """(path, ordinal, level, heading, content); a repeated heading keeps its
    first place and its last content."""
    staged = notes.select("path", md.section_pieces(F.col("body")).alias("_pieces"))
    staged = staged.select("path", "_pieces", F.transform("_pieces", lambda s: s["heading"]).alias("_heads"))
    staged = staged.select(
        "path",
        F.array_distinct("_heads").alias("_names"),
        F.reverse("_pieces").alias("_rev"),
        F.reverse("_heads").alias("_rheads"),
    )
    rows = staged.select("path", "_rev", "_rheads", F.posexplode("_names").alias("ordinal", "heading"))
    last = F.element_at("_rev", F.array_position("_rheads", F.col("heading")).cast("int"))
    return rows.select(
        "path", "ordinal", last["level"].alias("level"), "heading", last["content"].alias("content")
    )


def note_tasks(notes: DataFrame) -> DataFrame:
    """(path, ordinal, done, text, assignee)."""
    return notes.select("path", F.posexplode(md.task_rows(F.col("body"))).alias("ordinal", "_t")).select(
        "path", "ordinal", "_t.done", "_t.text", "_t.assignee"
    )


def note_fields(notes: DataFrame) -> DataFrame:
    """(path, key, value): every frontmatter value as lower-case text.

    Arrays give a row per scalar element, objects their JSON text.
    """
    flat = notes.select("path", "frontmatter").lateralJoin(
        notes.sparkSession.tvf.variant_explode(F.col("frontmatter").outer())
    )
    scalar = lambda v: F.when(
        ~F.rlike(fm.kind(v), F.lit("^(ARRAY|OBJECT|VOID)")), F.try_variant_get(v, "$", "string")
    )
    entry = F.col("value")
    many = F.transform(F.try_variant_get(entry, "$", "array<variant>"), scalar)
    nested = F.when(F.startswith(fm.kind(entry), F.lit("OBJECT")), F.array(F.to_json(entry)))
    values = (
        F.when(fm.is_array(entry), many)
        .when(nested.isNotNull(), nested)
        .otherwise(F.array(scalar(entry)))
    )
    return (
        flat.select("path", F.lower("key").alias("key"), F.explode(values).alias("value"))
        .where(F.col("value").isNotNull())
        .withColumn("value", F.lower("value"))
    )


def note_metadata(notes: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Peek row per note: times, size and all section headings in order."""
    picked = notes if requests is None else notes.join(requests.select("path").distinct(), "path", "left_semi")
    heads = F.array_distinct(F.transform(md.section_pieces(F.col("body")), lambda s: s["heading"]))
    return picked.select(
        "path",
        "path",
        "title",
        "frontmatter",
        F.lit(None).cast("timestamp").alias("created_at"),
        F.col("mtime").alias("modified_at"),
        (F.unix_micros("mtime") / 1000).alias("mtime_ms"),
        "word_count",
        heads.alias("headings"),
    ).toDF(
        "path", "ref", "title", "frontmatter", "created_at", "modified_at", "mtime_ms", "word_count", "headings"
    )


def read_sections(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested (path, heading) sections; a miss carries the headings there are."""
    wanted = requests.select("path", "heading").distinct()
    hits = notes.join(wanted.select("path").distinct(), "path", "left_semi")
    found = note_sections(hits)
    names = hits.select(
        "path",
        F.array_distinct(F.transform(md.section_pieces(F.col("body")), lambda s: s["heading"])).alias("_names"),
    )
    joined = wanted.join(found.select("path", "heading", "content"), ["path", "heading"], "left")
    joined = joined.join(names, "path", "left")
    missing = F.col("content").isNull()
    return joined.select(
        "path",
        "heading",
        F.concat_ws("#", "path", "heading").alias("ref"),
        F.when(missing, "NOT_FOUND").otherwise("OK").alias("status"),
        "content",
        F.when(missing, F.col("_names")).alias("available_headings"),
    )
