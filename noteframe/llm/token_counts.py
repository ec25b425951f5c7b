"""Token counts under a unigram model, worked out in a trie of distinct pre-tokens.

Pre-tokens are the units that no vocabulary piece crosses. The distinct ones of a chunk of texts
are walked in trie order (sorted, each sharing its prefix with the one before), so the forward
scores of the best segmentation are computed once per shared prefix; the count at each
terminal is kept for the task. A document's count is the sum over its pre-tokens. All
of it is narrow: no shuffle.

Scores are those of the vocabulary file, whatever algorithm it was made for. Ties go to the
longer last piece. A character without a piece costs ten more than the worst piece and counts as its
bytes where the model falls back to bytes, else a run of such characters is one token.

Defined results: a null or empty text has no tokens; repeated rows and rows without ``doc_id``
are counted like others; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noteframe.llm.pieces import PieceModel, UnitTable, load, slices, units

UNKNOWN_PENALTY = 10.0


def trie_counts(model: PieceModel, sorted_units: list[str]) -> list[int]:
    """Tokens of the best segmentation of each unit; 0 for a single unknown character without byte fallback."""
    score_of, longest = model.scores.get, max(map(len, model.scores))
    unknown = model.lowest - UNKNOWN_PENALTY
    best, tokens, counts, before = [0.0], [0], [], ""
    for unit in sorted_units:
        shared = len(os.path.commonprefix((before, unit)))
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(unit) + 1):
            top, count = None, 0
            for start in range(max(0, end - longest), end):
                score = score_of(unit[start:end])
                if score is not None:
                    score += best[start]
                    if top is None or score > top:
                        top, count = score, tokens[start] + 1
                elif start == end - 1:
                    score = best[start] + unknown
                    if top is None or score > top:
                        size = len(unit[start:end].encode()) if model.byte_fallback else 0
                        top, count = score, tokens[start] + size
            best.append(top)
            tokens.append(count)
        counts.append(tokens[-1])
        before = unit
    return counts


def counter(model: PieceModel) -> UnitTable:
    """The counts of all pre-tokens met so far."""

    def solve(missing: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(missing), np.int64), np.array(trie_counts(model, missing), np.int64)

    return UnitTable(solve)


def count(model: PieceModel, table: UnitTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of each text."""
    found, per_text, *_ = units(model, texts)
    sizes = table.look_up(found)[1][0] if found else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), per_text)
    if not model.byte_fallback and len(sizes):
        lone = sizes == 0
        follows = np.concatenate([[False], lone[:-1] & (owner[1:] == owner[:-1])])
        sizes = sizes + (lone & ~follows)
    return np.bincount(owner, sizes, minlength=len(texts)).astype(np.int64), per_text


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for every row. ``model_path`` is read on every executor."""

    def run(batches):
        model = load(model_path)
        table = counter(model)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                tokens, pretokens = count(model, table, texts[a:b])
                arrays = [batch.column(0).slice(a, b - a), pa.array(pretokens, pa.int64()), pa.array(tokens)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
