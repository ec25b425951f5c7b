"""Quality rules whose limits are learnt from the corpus.

Every document gets counts of words, symbols, repeated lines and repeated word
windows. Mergeable KLL sketches hold the distribution of three ratios per language
and source; a group with few documents borrows the merged sketch of its
language, a language with few the merged sketch of everything. A document is
rejected where a ratio lies beyond the fence ``Q3 + k * spread`` (for the word length also
below ``Q1 - k * spread``) of its group, or where it fails the base rule.

Defined results: a null or blank text has zero counts and fails the base rule;
null languages and sources are groups of their own; repeated rows are judged one
by one, nothing is keyed by ``doc_id``; other columns are carried along or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.llm.native import NOT_WHITE, bind, packed, words
from noteframe.session import cut

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8  # words in a window that may repeat


@dataclass(frozen=True)
class Fence:
    """How far a ratio may lie from the middle half of its group."""

    k: float
    least_spread: float  # resolution of the ratio; keeps the fence of a constant group open
    two_sided: bool = False


FENCES = {
    "symbol_ratio": Fence(4.0, 0.01),
    "dup_line_ratio": Fence(4.0, 0.1),
    "word_length": Fence(8.0, 0.1, two_sided=True),
}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    min_group: int = 200  # documents below which a group borrows the wider sketch
    sketch_k: int = 4096  # rank error about 0.1 %; exact up to this many documents


RULES = QualityRules()


def _repeat_words(w: Column) -> Column:
    """Words inside windows that occur at least twice, each word once."""

    def covered(starts: Column) -> Column:
        # Each window adds what the next one does not cover; the last adds all of it.
        steps = F.zip_with(
            F.slice(starts, 1, F.size(starts) - 1),
            F.slice(starts, 2, F.size(starts) - 1),
            lambda a, b: F.least(F.lit(WINDOW), b - a),
        )
        return F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)

    def repeated(s: Column) -> Column:
        # s: (hash, position) in order, so equal windows are neighbours.
        same_as = lambda i, x, step: F.coalesce(F.get(s, i + step)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same_as(i, x, -1) | same_as(i, x, 1))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            bind(bind(pairs, repeated), covered)
        )

    hashes = bind(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda one: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(one, i, WINDOW))),
    )
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(bind(hashes, count))


def _counts(text: Column, with_repeats: bool) -> Column:
    """All counts of one text as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_WHITE))

    def build(w: Column) -> Column:
        return bind(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                F.size(ln).cast("long").alias("n_lines"),
                (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                (_repeat_words(w) if with_repeats else F.lit(None)).cast("long").alias("n_repeat_words"),
            ),
        )

    return bind(words(text), build)


def _ratios(c: Column) -> dict[str, Column]:
    part = lambda a, b: F.when(c[b] > 0, c[a].cast("double") / c[b].cast("double"))
    return {
        "symbol_ratio": part("n_symbols", "word_chars"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "word_length": part("word_chars", "n_words"),
    }


def thresholds(counted: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """``q_lang, q_source`` and the low and high fence of every ratio.

    ``counted`` has ``lang, source, counts``. Sketches are merged map-side, so a
    group of any size moves as one sketch per task. One row per group.
    """
    c = F.col("counts")
    seen = counted.where(c["n_words"] >= rules.min_words).select(
        "lang", "source", *[r.alias(n) for n, r in _ratios(c).items()]
    )
    groups = cut(
        seen.groupBy("lang", "source").agg(
            F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(n, rules.sketch_k).alias(n) for n in FENCES]
        )
    )
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(n, rules.sketch_k).alias(n) for n in FENCES]]
    langs = groups.groupBy(F.col("lang").alias("l_lang")).agg(*merged)
    langs = langs.select("l_lang", F.col("n").alias("l_n"), *[F.col(n).alias(f"l_{n}") for n in FENCES])
    whole = groups.agg(*[F.kll_merge_agg_double(n, rules.sketch_k).alias(f"a_{n}") for n in FENCES])
    # whole is one row; the literal key keeps it an equi-join.
    wide = (
        groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))
        .withColumn("one", F.lit(1))
        .join(whole.withColumn("one", F.lit(1)), "one")
    )
    out = [F.col("lang").alias("q_lang"), F.col("source").alias("q_source")]
    for name, fence in FENCES.items():
        sketch = (
            F.when(F.col("n") >= rules.min_group, F.col(name))
            .when(F.col("l_n") >= rules.min_group, F.col(f"l_{name}"))
            .otherwise(F.col(f"a_{name}"))
        )
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        reach = F.lit(fence.k) * F.greatest(q3 - q1, F.lit(fence.least_spread))
        out.append((q3 + reach).alias(f"{name}_high"))
        out.append((q1 - reach if fence.two_sided else F.lit(None).cast("double")).alias(f"{name}_low"))
    return cut(wide.select(*out))


def _verdict(rows: DataFrame, limits: DataFrame, lang: str, source: str, rules: QualityRules) -> DataFrame:
    """``rows`` with ``base_failed`` and ``kept``.

    The limits are a written table of one short row per language and source: Spark
    knows its size, broadcasts it while it is small and joins it by key beyond that.
    """
    rows = rows.join(
        limits, F.col(lang).eqNullSafe(F.col("q_lang")) & F.col(source).eqNullSafe(F.col("q_source")), "left"
    )
    c = F.col("counts")
    failed = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])
    odd = F.lit(False)
    for name, ratio in _ratios(c).items():
        odd = odd | F.coalesce(ratio > F.col(f"{name}_high"), F.lit(False))
        if FENCES[name].two_sided:
            odd = odd | F.coalesce(ratio < F.col(f"{name}_low"), F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)


def quality_counts(docs: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """``doc_id``, the counts, the base verdict and the final verdict.

    Texts are read once; sketches and limits work on the written counts.
    """
    counted = cut(docs.select("doc_id", "lang", "source", _counts(F.col("text"), True).alias("counts")))
    judged = _verdict(counted, thresholds(counted, rules), "lang", "source", rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"counts.{n}") for n in names], "base_failed", "kept")


def keep_good(docs: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are read twice, first for the limits without the costly window counts, so
    that no text is written or shuffled and no row needs a key.
    """
    limits = thresholds(docs.select("lang", "source", _counts(F.col("text"), False).alias("counts")), rules)
    rows = packed(docs).withColumn("counts", _counts(F.col("row.text"), True))
    return _verdict(rows, limits, "row.lang", "row.source", rules).where("kept").select("row.*")
