"""Exact substring matching between a text table and a pattern table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.session import cut

GRAM = 3
FEW = 256  # keys up to which a text is searched for each, which is cheaper than to list all of its own


def runs_of(items, size: int, glue: str = ""):
    """Runs of ``size`` neighbouring items, glued; linear in the array length."""
    out = items
    for step in range(1, size):
        shifted = F.slice(items, F.lit(step + 1), F.size(items))
        out = F.zip_with(out, shifted, lambda a, b: F.concat(a, F.lit(glue), b))
    return out if size == 1 else F.filter(out, lambda run: run.isNotNull())


def _grams(text, size: int):
    """Distinct character n-grams."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_distinct(runs_of(chars, size))


def contains_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern) for every text that contains a pattern, for any number of patterns.

    ``texts`` is (text_id, text), ``patterns`` is (pattern); both are compared
    as they are and blank patterns are left out. Patterns are anchored: a text can hold a pattern
    only if it holds each inner word of it, or each 3-gram where it has no inner
    word. An equi-join on the rarest of these gives the candidates, which are
    then tested. Where few such keys are needed, texts are searched for these; else their own keys are listed.
    """
    patterns = patterns.select("pattern").where(F.rlike("pattern", F.lit(r"(?U)\S"))).distinct()
    words = F.split("pattern", r"\s+")
    # Words between the first and the last one stand whole in the text as well.
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    kind = F.when(F.size(inner) > 0, 0).otherwise(F.least(F.length("pattern"), F.lit(GRAM)))
    kinded = patterns.select("pattern", kind.alias("kind"), inner.alias("inner"))
    kinds = [k for k in range(GRAM + 1) if not kinded.where(F.col("kind") == k).isEmpty()]

    def keys(k: int, text, tokens):
        return tokens if k == 0 else _grams(text, k)

    wanted = kinded.select("pattern", F.lit("").alias("gram"), "kind").where(F.lit(False))
    for k in kinds:
        wanted = wanted.union(
            kinded.where(F.col("kind") == k).select(
                "pattern", F.explode(F.array_distinct(keys(k, F.col("pattern"), F.col("inner")))).alias("gram"), "kind"
            )
        )
    # Pattern keys, anchors and candidates are small next to the texts. Written
    # tables have a known size, so Spark broadcasts them exactly when they fit
    # and the texts then stay where they are; else it shuffles both sides.
    wanted = cut(wanted)
    needed = wanted.select("gram").distinct()
    if not kinds:
        return texts.select("text_id", F.lit("").alias("pattern")).where(F.lit(False))
    tokens = F.array_distinct(F.split("text", r"\s+"))
    few = wanted.select((F.col("kind") == 0).alias("word"), "gram").distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        of = lambda word: F.array(*[F.lit(r["gram"]) for r in few if r["word"] == word]).cast("array<string>")
        whole = F.array_intersect(tokens, of(True)) if 0 in kinds else of(True)
        inside = F.filter(of(False), lambda g: F.contains(F.col("text"), g))
        all_keys = F.array_distinct(F.concat(whole, inside))
    else:
        all_keys = F.array_distinct(F.concat(*[keys(k, F.col("text"), tokens) for k in kinds]))
    text_grams = texts.select("text_id", F.explode(all_keys).alias("gram"))
    # How common each needed key is; counts are combined before the shuffle.
    common = text_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(needed, "gram", "left_semi")
    anchors = cut(
        wanted.join(common, "gram", "left")
        .groupBy("pattern")
        .agg(
            F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"),
            F.min(F.coalesce("n", F.lit(0))).alias("n"),
        )
        .where(F.col("n") > 0)
        .select("pattern", "gram")
    )
    candidates = cut(text_grams.join(anchors, "gram").select("text_id", "pattern"))
    return (
        candidates.join(texts, "text_id")
        .where(F.contains(F.col("text"), F.col("pattern")))
        .select("text_id", "pattern")
    )
