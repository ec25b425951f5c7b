"""Conversations rebuilt from quotations.

Lines that begin with ``>`` are quotes, nested as often as the mark repeats. Runs of one level
make passages; an unquoted message has passages too, its paragraphs, and its single lines, sentences and
whole body beside them. Normalised passages are hashed and joined to the earliest earlier
message of the conversation that says them itself. A message answers the latest message that its
quotes of the shallowest known level come from. Threads follow from these links by pointer doubling.

Everything is columns and joins: a passage that many messages share is one row per conversation
before it is joined, so a hot conversation or a common line pairs nothing.

Defined results: a null text is an empty one; messages without ``conv_id`` or ``turn`` are threads of
their own; rows with the same ``conv_id`` and ``turn`` are one place in the conversation and answer the
latest message that any of them quotes; a message that quotes nothing known starts a thread; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.llm.native import bind
from noteframe.session import cut

QUOTE = r"^[ \t]*((>[ \t]?)+)"
# "On Monday X wrote:" above a quote, in the languages of the corpus.
ATTRIBUTION = r"(?i)^\s*\S.*\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
SENTENCE_END = r"[.!?]+[ \t\n]+"
# A role mark within a text, with the backslashes that earlier escapes put into it.
ROLE_MARK = r"<(\\*)\|"
RUN, MARK = "\x01", "\x02"


def _lines(text: Column) -> Column:
    """``level, content`` of every line."""
    plain = F.translate(F.coalesce(text, F.lit("")), RUN + MARK + "\r", "")

    def one(line: Column) -> Column:
        return F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(line, QUOTE, "").alias("content"),
        )

    return F.transform(F.split(plain, "\n", -1), one)


def _without_attributions(lines: Column) -> Column:
    """Lines but those that introduce the quote right below them."""
    return F.filter(
        lines,
        lambda x, i: ~(
            (x["level"] == 0)
            & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
            & x["content"].rlike(ATTRIBUTION)
        ),
    )


def normal(text: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _runs(lines: Column) -> Column:
    """Passages: neighbouring lines of one level without a blank line between, as ``level, text``."""

    def piece(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        same = (before["level"] == x["level"]) & (F.trim(before["content"]) != "") & (F.trim(x["content"]) != "")
        head = F.concat(F.lit(RUN), x["level"].cast("string"), F.lit(MARK))
        return F.concat(F.when(F.coalesce(same, F.lit(False)), F.lit("\n")).otherwise(head), x["content"])

    joined = F.array_join(F.transform(lines, piece), "")
    runs = F.transform(
        F.split(joined, RUN),
        lambda r: F.struct(
            F.substring_index(r, MARK, 1).try_cast("int").alias("level"), F.substring_index(r, MARK, -1).alias("text")
        ),
    )
    return F.filter(runs, lambda r: r["level"].isNotNull() & (normal(r["text"]) != ""))


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, body, passages`` (``level, text``) of every message."""
    lines = bind(_lines(F.col("text")), _without_attributions)
    rows = messages.select("conv_id", "turn", "role", lines.alias("lines"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    body = F.array_join(F.transform(own, lambda x: x["content"]), "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")
    return rows.select("conv_id", "turn", "role", body.alias("body"), bind(F.col("lines"), _runs).alias("passages"))


def _keys(passage: Column) -> Column:
    """Hashes of a passage, of its lines and of its sentences."""
    texts = F.concat(F.array(passage), F.split(passage, "\n"), F.split(passage, SENTENCE_END))
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normal), lambda t: t != ""), lambda t: F.md5(t)))


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn`` of every place that quotes an earlier message at any level."""
    placed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = F.filter("passages", lambda p: p["level"] == 0)
    own = F.flatten(F.transform(F.concat(F.transform(said, lambda p: p["text"]), F.array("body")), _keys))
    sources = placed.select("conv_id", "turn", F.explode(F.array_distinct(own)).alias("key"))
    sources = sources.groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    quotes = placed.select("conv_id", "turn", F.explode(quoted).alias("p"))
    quotes = quotes.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_keys(F.col("p.text"))).alias("key"))
    quotes = quotes.groupBy("conv_id", "turn", "key").agg(F.min("level").alias("level"))
    return (
        quotes.join(sources, ["conv_id", "key"])
        .where("source < turn")
        .groupBy("conv_id", "turn")
        .agg(F.max_by("source", F.struct(-F.col("level"), F.col("source"))).alias("parent_turn"))
    )


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, thread_turn, depth`` of every answering place, by pointer doubling.

    Each round doubles the distance followed and is written to the shared folder.
    """
    state = cut(links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        state = cut(
            state.join(above, ["conv_id", "up"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("top", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("top").isNotNull().alias("moved"),
            )
        )
        if state.where("moved").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
        state = state.drop("moved")


def escaped(text: Column) -> Column:
    """The text without role marks: one backslash more stands within each ``<|``, and taking one out gives the text back."""
    return F.regexp_replace(text, ROLE_MARK, r"<\\$1|")


def linked(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, placed in its conversation.

    ``conv_id, turn, role, body, n_quotes, max_level, parent_turn, thread_turn, depth, formatted``; a
    conversation reads in the order ``thread_turn, depth, turn``. ``formatted`` is the chat form of the message; role
    marks inside roles and bodies are escaped, so no text can open a turn.
    """
    rows = cut(parsed(messages.select("conv_id", "turn", "role", "text")))
    links = cut(reply_links(rows))
    placed = links.join(threads(links), ["conv_id", "turn"])
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.size(quoted).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"),
        "parent_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(
            F.lit("<|"), escaped(F.coalesce("role", F.lit("unknown"))), F.lit("|>\n"), escaped(F.col("body")), F.lit("\n")
        ).alias("formatted"),
    )
