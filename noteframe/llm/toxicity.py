"""Toxic documents by expressions of whole words and two Kneser-Ney character models.

Expressions are runs of one to three whole words of any script; where a script puts no blanks, its
characters are the words. The documents of each class that hold an expression are counted in
tables as large as the corpus asks, and the distinct expressions of every text are joined to
them. An expression's evidence is the difference of its two Kneser-Ney log-likelihoods with the class as
context: counts are discounted, and what that frees goes to the shared continuation counts (in how many classes an expression is found), so that
a rare expression says little. It counts from ``least`` on, and a document has its strongest. Distinct expressions of a
class are counted by a mergeable sketch (within about 1 %). A bit table drops most rows that cannot join before they are moved; it decides nothing.

The character models tell new endings of a known stem. Letters fold to an alphabet of 32 symbols (0 parts words), so that a stem is known under
any ending and the 4-gram counts of a class are a dense array of 32 ** 4 entries whatever the
corpus. Counts come from every labelled training text. The top order is counted per
class; lower orders are continuation counts pooled over both classes, so that rare
expressions back off to the same probabilities. A word's evidence is its toxic minus its
ordinary log-likelihood over its length; a document is read off its strongest expression, its strongest word and its mean,
through a logistic fit on training rows, whose own document does not count as evidence for them.

Defined results: null and empty texts have no evidence (all features 0) and get a
score like others; rows without ``doc_id`` are scored and never train; of repeated labels of one
document the highest counts, null labels do not count; without toxic training rows every
score is 0, without ordinary ones 1; other columns are ignored or carried along.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.llm.rowset import bit_table, may_hold, without
from noteframe.session import cut

ORDER = 4
SYMBOLS = 32
CHUNK_CHARS = 1 << 19
CHUNK_WORDS = 1 << 17
WORDS = 3
PLACES = 13  # 2 ** 13 registers: distinct counts within about 1 %
PAIRS, SEEN = 0, 1
_NO_BLANKS = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
WORD = rf"[{_NO_BLANKS}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_NO_BLANKS}]]+"
GRAMS = SYMBOLS**ORDER


@dataclass(frozen=True)
class Toxicity:
    discount: float = 0.75
    fit_rows: int = 20_000  # bound of the labelled rows that the three logistic weights are fitted on
    least: float = 2.5  # log-likelihood ratio from which an expression counts
    folds: int = 5  # rows whose crc32(doc_id) is 0 modulo this never train


PLAN = Toxicity()


def _fold_table() -> np.ndarray:
    """Symbol of every code point: 1-26 letters without marks, 0 white space, the rest 27-31."""
    table = (27 + np.arange(0x110000) % 5).astype(np.uint8)
    for code in range(0x250):
        char = chr(code)
        base = unicodedata.normalize("NFKD", char).lower()[:1]
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        elif char.isspace() or code < 32:
            table[code] = 0
        elif code < 128:
            table[code] = 27 if char.isdigit() else 28
    table[[0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = 0
    return table


_FOLD = _fold_table()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram codes, and for each its word and its text. Contexts end at word borders."""
    joined = "\n".join(texts) + "\n"
    codes = _FOLD[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    gram, inside = codes.copy(), np.ones(len(codes), bool)
    for k in range(1, ORDER):
        back = np.zeros_like(codes)
        back[k:] = codes[:-k]
        back[~inside] = 0
        gram += back << (5 * k)
        inside &= back != 0
    # A border after a border ends no word.
    real = (codes != 0) | np.concatenate([[False], codes[:-1] != 0])
    word = np.cumsum(codes == 0) - (codes == 0)
    return gram[real], word[real], owner[real]


def _slices(texts: list[str]):
    """Row ranges of at most CHUNK_CHARS characters, or one longer text."""
    start = size = 0
    for row, text in enumerate(texts):
        if size and size + len(text) > CHUNK_CHARS:
            yield start, row
            start, size = row, 0
        size += len(text) + 1
    if size:
        yield start, len(texts)


def _count(batches):
    """Per task the non-zero 4-gram counts of each class, at most 2 * 32 ** 4 rows."""
    counts = np.zeros((2, GRAMS), np.int64)
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
        toxic = batch.column(1).to_numpy()
        for a, b in _slices(texts):
            gram, _, owner = grams(texts[a:b])
            for label in (0, 1):
                counts[label] += np.bincount(gram[toxic[a:b][owner] == label], minlength=GRAMS)
    label, gram = np.nonzero(counts)
    for k in range(0, len(gram), 50_000):
        part = slice(k, k + 50_000)
        arrays = [pa.array(label[part]), pa.array(gram[part]), pa.array(counts[label[part], gram[part]])]
        yield pa.RecordBatch.from_arrays(arrays, ["label", "gram", "n"])


def _smoothed(counts: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
    """Interpolated Kneser-Ney probabilities of one order over the order below."""
    total = counts.sum(axis=-1, keepdims=True)
    kinds = (counts > 0).sum(axis=-1, keepdims=True)
    backoff = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - discount, 0) / np.maximum(total, 1) + backoff * lower


def evidence(counts: np.ndarray, discount: float = PLAN.discount) -> np.ndarray:
    """Toxic minus ordinary log-probability of every 4-gram's last symbol."""
    classes = counts.reshape(2, *[SYMBOLS] * ORDER)
    levels = [(classes.sum(axis=0) > 0).sum(axis=0)]  # distinct left contexts, both classes together
    while levels[-1].ndim > 1:
        levels.append((levels[-1] > 0).sum(axis=0))
    shared = np.full(SYMBOLS, 1 / SYMBOLS)
    for level in reversed(levels):
        shared = _smoothed(level, shared, discount)
    ordinary, toxic = (np.log(_smoothed(c, shared, discount)) for c in classes)
    return (toxic - ordinary).ravel().astype(np.float32)


def read_off(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the evidence of its strongest word and of the whole text, per symbol."""
    worst, mean = np.zeros(len(texts)), np.zeros(len(texts))
    for a, b in _slices(texts):
        gram, word, owner = grams(texts[a:b])
        if not len(gram):
            continue
        value = table[gram].astype(np.float64)
        n = np.bincount(owner, minlength=b - a)
        mean[a:b] = np.bincount(owner, value, minlength=b - a) / np.maximum(n, 1)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(first, len(word)))
        strongest = np.full(b - a, -np.inf)
        np.maximum.at(strongest, owner[first], np.add.reduceat(value, first) / sizes)
        worst[a:b] = np.where(np.isfinite(strongest), strongest, 0.0)
    return worst, mean


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights (bias last) by Newton steps on standardised features."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    weights, ridge = np.zeros(design.shape[1]), np.diag([1e-3 * len(x)] * x.shape[1] + [1e-9])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - ridge @ weights
        weights += np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge, slope)
    plain = weights[:-1] / spread
    return np.append(plain, weights[-1] - (plain * middle).sum())


def held_out(plan: Toxicity = PLAN) -> Column:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % plan.folds
    return F.coalesce(fold == 0, F.lit(False))


def _features(table: np.ndarray, spark):
    shared = spark.sparkContext.broadcast(table)  # always 32 ** 4 floats

    @F.pandas_udf("worst double, mean double")
    def features(texts: pd.Series) -> pd.DataFrame:
        worst, mean = read_off(["" if t is None else t for t in texts], shared.value)
        return pd.DataFrame({"worst": worst, "mean": mean})

    return features


def hashed_words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def expressions(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of one to WORDS words, and the row of each."""
    own = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    found, rows, run = [own], [owner], own
    for k in range(1, min(WORDS, len(own))):
        run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[k:]
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[:-k] == owner[k:]
        found.append(run[inside])
        rows.append(owner[k:][inside])
    return np.concatenate(found).view(np.int64), np.concatenate(rows)


def _distinct(words: pa.Array, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct expressions of each row that may be in the bit table."""
    gram, row = expressions(words)
    if bits is not None:
        may = may_hold(bits, gram)
        gram, row = gram[may], row[may]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[first], row[first]


def _word_slices(words: pa.Array):
    """The rows in runs of at most CHUNK_WORDS words, or one longer text."""
    sizes = np.diff(words.offsets.to_numpy())
    start = size = 0
    for row, n in enumerate(sizes):
        if size and size + n > CHUNK_WORDS:
            yield start, row
            start, size = row, 0
        size += n
    if len(sizes):
        yield start, len(sizes)


def _records(columns: dict[str, np.ndarray]):
    for k in range(0, len(next(iter(columns.values()))), 50_000):
        yield pa.RecordBatch.from_pydict({name: pa.array(c[k : k + 50_000]) for name, c in columns.items()})


def registers(gram: np.ndarray) -> np.ndarray:
    """Where a hash falls in a distinct-count sketch, and the first bit set there: ``place * 64 + rank``."""
    mixed = gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    place, rest = mixed >> np.uint64(64 - PLACES), (mixed & np.uint64((1 << 48) - 1)) + np.uint64(1)
    rank = 49 - np.frexp(rest.astype(np.float64))[1]
    return place.astype(np.int64) * 64 + np.maximum(rank, 1)


def distinct_count(found: np.ndarray) -> float:
    """The distinct hashes behind the ``registers`` found."""
    ranks = np.zeros(1 << PLACES, np.int64)
    np.maximum.at(ranks, found // 64, found % 64)
    m, empty = len(ranks), int((ranks == 0).sum())
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0**-ranks)
    return m * np.log(m / empty) if raw < 2.5 * m and empty else float(raw)


def _count_expressions(batches):
    """Per task and class: held expressions (kind ``PAIRS``), and the sketch of the distinct ones (kind ``SEEN``)."""
    pairs, seen = np.zeros(2, np.int64), [np.zeros(1 << (PLACES + 6), bool) for _ in range(2)]
    for batch in batches:
        words, toxic = batch.column(0), batch.column(1).to_numpy()
        for a, b in _word_slices(words):
            gram, row = _distinct(words.slice(a, b - a), None)
            label = toxic[a:b][row]
            for c in (0, 1):
                mine = gram[label == c]
                pairs[c] += len(mine)
                seen[c][registers(mine)] = True
    at = [np.flatnonzero(s) for s in seen]
    label = np.repeat([0, 1, 0, 1], [1, 1, len(at[0]), len(at[1])])
    kind = np.repeat([PAIRS, SEEN], [2, len(at[0]) + len(at[1])])
    gram = np.concatenate([[0, 0], *at])
    n = np.concatenate([pairs, np.ones(len(gram) - 2, np.int64)])
    yield from _records({"label": label, "kind": kind, "gram": gram, "n": n})


def expression_totals(words: DataFrame) -> tuple[list[int], list[float]]:
    """For the ordinary and the toxic texts: held expressions (once a text), and how many differ."""
    found = words.mapInArrow(_count_expressions, "label long, kind long, gram long, n long")
    found = found.groupBy("label", "kind", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most 2 ** 13 * 50 rows
    pairs = found[found.kind == PAIRS].groupby("label").n.sum()
    seen = found[found.kind == SEEN]
    return [int(pairs.get(c, 0)) for c in (0, 1)], [distinct_count(seen[seen.label == c].gram.to_numpy()) for c in (0, 1)]


def _toxic_grams(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b in _word_slices(batch.column(0)):
                gram, _ = _distinct(batch.column(0).slice(a, b - a), None)
                yield from _records({"gram": np.unique(gram)})

    return words.where("toxic = 1").select("w").mapInArrow(run, "gram long")


def _texts_with(words: DataFrame, bits) -> DataFrame:
    """``gram, t, o``: toxic and ordinary texts that hold each expression that may be in the bit table."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for a, b in _word_slices(batch.column(0)):
                gram, row = _distinct(batch.column(0).slice(a, b - a), bits.value)
                gram, at = np.unique(gram, return_inverse=True)
                t = np.bincount(at, toxic[a:b][row], minlength=len(gram)).astype(np.int32)
                yield from _records({"gram": gram, "t": t, "o": np.bincount(at, minlength=len(gram)).astype(np.int32) - t})

    counts = words.select("w", "toxic").mapInArrow(run, "gram long, t int, o int")
    return counts.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


VARIANTS = ["plain", "in_toxic", "in_ordinary"]


def raised(t: Column, o: Column, pairs: list[int], seen: list[float], plan: Toxicity) -> Column:
    """Toxic minus ordinary Kneser-Ney log-probability of an expression after its class, from ``least`` on.

    The class is the context: its counts are discounted, and what that frees goes to the shared continuation
    probability, the classes that an expression is found in over all such pairs. Found in no toxic text it is 0.
    """
    kinds = (t > 0).cast("double") + (o > 0).cast("double")
    shared = kinds / F.lit(max(sum(seen), 1.0))

    def likelihood(n: Column, c: int) -> Column:
        freed = plan.discount * seen[c]
        return (F.greatest(n - F.lit(plan.discount), F.lit(0.0)) + F.lit(freed) * shared) / F.lit(float(max(pairs[c], 1)))

    value = F.log(likelihood(t, 1)) - F.log(likelihood(o, 0))
    return F.when(t > 0, F.greatest(value - F.lit(plan.least), F.lit(0.0))).otherwise(0.0)


def word_evidence(train: DataFrame, plan: Toxicity = PLAN) -> tuple[DataFrame, list[Column]]:
    """``gram, t, o``: toxic and ordinary training texts with each expression that speaks for toxicity, and its
    evidence for any text, and for a toxic and an ordinary training text without its own count.
    Expressions of no toxic text speak for none and are left out."""
    words = train.select(hashed_words(F.col("text")).alias("w"), "toxic")
    pairs, seen = expression_totals(words)
    both = _texts_with(words, bit_table(_toxic_grams(words), pairs[1])).where("t > 0")
    t, o = F.col("t"), F.col("o")
    left = [(t, o), (t - 1, o), (t, F.greatest(o - 1, F.lit(0)))]
    values = [raised(a, b, pairs, seen, plan) for a, b in left] if min(pairs) else [F.lit(0.0)] * 3
    return cut(both.where(F.greatest(*values) > 0)), [v.alias(name) for v, name in zip(values, VARIANTS, strict=True)]


def _key(text: Column) -> list[Column]:
    """What evidence is joined by: it depends on the text alone."""
    return [F.xxhash64(text).alias("key"), F.coalesce(F.length(text), F.lit(0)).alias("chars")]


def strongest(docs: DataFrame, known: DataFrame, values: list[Column]) -> DataFrame:
    """``key, chars`` of every text with a known expression, and its strongest evidence of each kind."""
    bits = bit_table(known)

    def run(batches):
        for batch in batches:
            key, chars = (batch.column(k).to_numpy() for k in (0, 1))
            for a, b in _word_slices(batch.column(2)):
                gram, row = _distinct(batch.column(2).slice(a, b - a), bits.value)
                yield from _records({"key": key[a:b][row], "chars": chars[a:b][row], "gram": gram})

    held = docs.select(*_key(F.col("text")), hashed_words(F.col("text")).alias("w"))
    held = held.mapInArrow(run, "key long, chars int, gram long")
    held = held.join(known, "gram").select("key", "chars", *values)
    return held.groupBy("key", "chars").agg(*[F.max(v).alias(v) for v in VARIANTS])


def _of_class(docs: DataFrame, marked: DataFrame, toxic: int, plan: Toxicity) -> DataFrame:
    """``text, toxic``: the training texts of one class, picked where they stand; only ids are moved to the labels."""
    named = docs.where(F.col("doc_id").isNotNull() & ~held_out(plan)).select("doc_id", "text")
    others = named.select("doc_id").distinct().join(marked.where(F.col("toxic") == toxic), "doc_id", "left_anti")
    kept = without(named, {"doc_id": F.col("row.doc_id")}, cut(others))
    return kept.select("text", F.lit(toxic).alias("toxic"))


def scored(docs: DataFrame, labels: DataFrame, plan: Toxicity = PLAN) -> tuple[DataFrame, Column]:
    """Narrow rows of all documents (``doc_id, held_out, key, chars`` and features), and the score over them.

    Texts stay where they are, but for the few whose id shares its bits with others by chance; the training texts are written once.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = cut(marked)
    train = cut(_of_class(docs, marked, 0, plan).unionByName(_of_class(docs, marked, 1, plan)))
    seen = train.mapInArrow(_count, "label long, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    found = cut(seen).toArrow()  # at most 2 * 32 ** 4 rows
    counts = np.zeros((2, GRAMS), np.int64)
    counts[found["label"].to_numpy(), found["gram"].to_numpy()] = found["n"].to_numpy()
    features = _features(evidence(counts, plan.discount), spark)
    rows = cut(docs.select("doc_id", held_out(plan).alias("held_out"), *_key(F.col("text")), features("text").alias("f")))
    words = cut(strongest(docs, *word_evidence(train, plan)))
    rows = rows.join(words, ["key", "chars"], "left").select(
        "doc_id", "held_out", "key", "chars", "f.worst", "f.mean", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in VARIANTS]
    )
    own = F.when(F.col("toxic") == 1, F.col("in_toxic")).otherwise(F.col("in_ordinary"))
    fit = rows.where("NOT held_out").join(marked, "doc_id").select("doc_id", "worst", "mean", own.alias("words"), "toxic")
    fit = fit.orderBy(F.xxhash64("doc_id"), "worst", "mean", "words").limit(plan.fit_rows).toPandas()
    if fit["toxic"].nunique() < 2:
        return rows, F.lit(1.0 if len(fit) and fit["toxic"].max() else 0.0)
    *weights, bias = map(float, _logistic(fit[["worst", "mean", "words"]].to_numpy(), fit["toxic"].to_numpy(float)))
    total = F.lit(bias)
    for name, weight in zip(("worst", "mean", "plain"), weights, strict=True):
        total = total + F.lit(weight) * F.col(name)
    return rows, 1 / (1 + F.exp(-total))


def toxicity_scores(docs: DataFrame, labels: DataFrame, plan: Toxicity = PLAN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows, score = scored(docs, labels, plan)
    rows = rows.select("doc_id", "held_out", score.cast("double").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, plan: Toxicity = PLAN) -> DataFrame:
    """The documents scored below 0.5, with their own columns. Equal texts have equal scores."""
    rows, score = scored(docs, labels, plan)
    gone = cut(rows.where(score >= 0.5).select("key", "chars").distinct())
    key, chars = _key(F.col("row.text"))
    return without(docs, {"key": key, "chars": chars}, gone)
