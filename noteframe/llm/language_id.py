"""Language of whole texts by a string kernel.

The kernel is the blended spectrum of presence: two texts are as alike as the number of character n-grams, of one to
``order`` characters, that both hold, divided by the root of the product of their own numbers. Texts are folded first: letters and
marks in lower case, every run of other characters one blank, a blank at both ends. A few sampled texts are the landmarks of a Nyström
approximation; one-versus-rest kernel ridge regression on a bounded sample weights them. Documents are scored in batches: presence times
landmarks gives the kernel, the kernel times the dual weights the scores.

What is learned is bounded by the parameters of :class:`LanguageId` alone: the sample holds distinct texts, as many
of each language, so that neither a frequent language nor copies fill it. Every document is scored by all its n-grams.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when no row can be learned from; rows
without ``doc_id`` are held out; equal scores go to the language that sorts first; repeated rows are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteframe.session import cut

UNKNOWN = "und"
_SLICE = 1 << 20  # characters whose n-grams are sorted at once
_BITS = 21  # of a code point


@dataclass(frozen=True)
class LanguageId:
    order: int = 3  # longest n-gram; three code points fill one integer
    folds: int = 3
    held_fold: int = 1
    fit_rows: int = 1_600  # distinct texts learned from, shared among the languages
    landmarks: int = 160
    features: int = 65_536  # n-grams of the landmarks, those that most of them hold
    languages: int = 256  # the most frequent are learned
    ridge: float = 1e-4
    batch: int = 64


PLAN = LanguageId()


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted n-grams
    presence: np.ndarray  # n-gram x landmark
    sizes: np.ndarray  # n-grams of each landmark
    dual: np.ndarray  # landmark x language
    bias: np.ndarray


def held_out(plan: LanguageId = PLAN) -> Column:
    fold = F.crc32(F.col("doc_id").cast("string")) % plan.folds
    return F.coalesce(fold == plan.held_fold, F.lit(True))


@functools.cache
def _folding() -> np.ndarray:
    """For every code point the one it counts as."""
    out = np.full(0x110000, 32, np.uint64)
    for point in range(0x110000):
        if unicodedata.category(chr(point))[0] in "LM":
            low = chr(point).lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def folded(text: str) -> np.ndarray:
    """Code points of the folded text, a blank before and after."""
    points = _folding()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]


def grams(text: str, order: int) -> np.ndarray:
    """The distinct n-grams of a text as sorted integers, sliced so that a long text needs little memory."""
    points = folded(text)
    found = []
    for start in range(0, len(points), _SLICE):
        part = points[start : start + _SLICE + order - 1]
        for n in range(1, order + 1):
            value = np.zeros(max(0, len(part) - n + 1), np.uint64)
            for k in range(n):
                value = value << np.uint64(_BITS) | part[k : k + len(value)]
            found.append(np.unique(value))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
    # Longer n-grams are larger integers, so the parts of one slice are in order already.
    return np.concatenate(found) if len(points) <= _SLICE else np.unique(np.concatenate(found))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def kernel(model: Model, sets: list[np.ndarray]) -> np.ndarray:
    """Texts, given as n-gram sets, against the landmarks."""
    present = np.zeros((len(sets), len(model.vocabulary)), np.float32)
    for row, held in zip(present, sets, strict=True):
        at = np.searchsorted(model.vocabulary, held)
        at[at == len(model.vocabulary)] = 0
        row[at[model.vocabulary[at] == held]] = 1
    sizes = np.array([max(1, len(held)) for held in sets], np.float64)
    return (present @ model.presence) / np.sqrt(np.outer(sizes, model.sizes))


def fit(sets: list[np.ndarray], labels: list[str], plan: LanguageId = PLAN) -> Model | None:
    """Landmarks from the first texts of each language, dual weights from all."""
    languages = sorted(set(labels))
    if not languages:
        return None
    share = max(1, plan.landmarks // len(languages))
    marks = [k for name in languages for k in [i for i, x in enumerate(labels) if x == name][:share]]
    every, held_by = np.unique(np.concatenate([sets[k] for k in marks]), return_counts=True)
    vocabulary = np.sort(every[np.lexsort((every, -held_by))[: plan.features]])
    presence = np.zeros((len(vocabulary), len(marks)), np.float32)
    for column, k in enumerate(marks):
        presence[np.isin(vocabulary, sets[k], assume_unique=True), column] = 1
    sizes = np.array([len(sets[k]) for k in marks], np.float64)
    plain = Model(languages, vocabulary, presence, sizes, np.zeros((len(marks), 0)), np.zeros(0))
    among = kernel(plain, [sets[k] for k in marks])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    live = values > 1e-9 * values[-1]
    root = vectors[:, live] / np.sqrt(values[live])
    mapped = np.concatenate([kernel(plain, sets[k : k + plan.batch]) for k in range(0, len(sets), plan.batch)]) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    centre, level = mapped.mean(axis=0), target.mean(axis=0)
    moved = mapped - centre
    weight = np.linalg.solve(
        moved.T @ moved + plan.ridge * len(sets) * np.eye(moved.shape[1]), moved.T @ (target - level)
    )
    return Model(languages, vocabulary, presence, sizes, root @ weight, level - centre @ weight)


def sample(docs: DataFrame, plan: LanguageId = PLAN) -> DataFrame:
    """``lang, key, text``: distinct texts of the most frequent languages, the same number at most of each."""
    known = docs.where(~held_out(plan) & F.col("lang").isNotNull() & F.regexp_like("text", F.lit("\\p{L}")))
    known = known.select("lang", "text", F.xxhash64("text").alias("key"))
    # Only languages and hashes are shuffled to choose; both lists are bounded by the plan.
    keys = cut(known.select("lang", "key").distinct())
    top = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(plan.languages).select("lang")
    names = [r["lang"] for r in top.collect()]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    share = max(1, plan.fit_rows // max(1, len(names)))
    drawn = keys.where(F.col("lang").isin(names)).select("lang", "key", place.alias("place")).where(F.col("place") <= share)
    held = known.join(F.broadcast(drawn.drop("place")), ["lang", "key"])  # at most fit_rows rows, or one a language
    return held.groupBy("lang", "key").agg(F.min("text").alias("text"))


def _gram_sets(plan: LanguageId):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, key in zip(*batch.columns, strict=True):
                held = grams(text.as_py(), plan.order).view(np.int64)
                row = [pa.array([lang.as_py()]), pa.array([key.as_py()]), pa.array([held], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, ["lang", "key", "grams"])

    return run


def learned(docs: DataFrame, plan: LanguageId = PLAN) -> Model | None:
    """The model of the sampled texts of the folds that are not held out."""
    sets = sample(docs, plan).select("lang", "text", "key")
    sets = sets.mapInArrow(_gram_sets(plan), "lang string, key long, grams array<long>")
    found = sets.orderBy("lang", "key").toArrow()
    return fit([np.array(g, np.int64).view(np.uint64) for g in found["grams"].to_pylist()], found["lang"].to_pylist(), plan)


def _scores(model: Model | None, plan: LanguageId):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, best = [UNKNOWN] * len(batch), np.zeros(len(batch))
            rows, sets = [], []
            for row, text in enumerate(batch.column(2) if model else []):
                text = text.as_py()
                if _has_letter(text):
                    rows.append(row)
                    sets.append(grams(text, plan.order))
                if sets and (len(sets) == plan.batch or row + 1 == len(batch)):
                    value = kernel(model, sets) @ model.dual + model.bias
                    chosen = value.argmax(axis=1)
                    for at, k, f in zip(rows, chosen.tolist(), value.max(axis=1).tolist(), strict=True):
                        names[at], best[at] = model.languages[k], min(1.0, max(0.0, (f + 1) / 2))
                    rows, sets = [], []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def languages(docs: DataFrame, plan: LanguageId = PLAN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = learned(docs, plan)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(plan).alias("held_out"), "text")
    return rows.mapInArrow(_scores(model, plan), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
