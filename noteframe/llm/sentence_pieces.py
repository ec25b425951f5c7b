"""SentencePiece encoding with byte spans, and decoding.

The text is normalised through the model's compiled character map with an alignment to its
bytes, cut where no vocabulary piece can cross, and each distinct unit is segmented once per task by
the library's own merges (with its normaliser switched off). Every piece is then projected
to the bytes of the original text. All of it is narrow: no shuffle.

Defined results: a null text is an empty one and has no pieces; repeated rows and rows without
``doc_id`` are encoded like others; other columns are ignored. Pieces made of bytes of one
character share the span of that character; the leading blank added by the model has an empty span.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.llm.pieces import BYTE, UNKNOWN, PieceModel, UnitTable, load, slices, units


def _odd_spans(model: PieceModel, unit: str, ids: list[int]) -> tuple[list[int], list[int]]:
    """First and end character of each id of a unit that has byte or unknown pieces."""
    first, last, at, left = [], [], 0, 0
    for i in ids:
        if model.kinds[i] == BYTE:
            left = (left or len(unit[at].encode())) - 1
            first.append(at)
            last.append(at + 1)
            at += not left
        else:
            # An unknown piece stands for a character that is a unit of its own.
            first.append(at)
            at += len(unit) if model.kinds[i] == UNKNOWN else int(model.lengths[i])
            last.append(at)
    return first, last


def _solver(model: PieceModel):
    """Ids of each unit, and the first and end character of each id within it."""

    def solve(missing: list[str]) -> tuple[np.ndarray, ...]:
        found = model.segmenter.encode(missing, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
        lengths = model.lengths[ids]
        end = np.cumsum(lengths)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        end -= np.repeat(np.concatenate([[0], end])[borders[:-1]], sizes)
        start = end - lengths
        odd = np.isin(model.kinds[ids], (BYTE, UNKNOWN))
        for k in np.unique(np.repeat(np.arange(len(found)), sizes)[odd]).tolist():
            part = slice(borders[k], borders[k + 1])
            start[part], end[part] = _odd_spans(model, missing[k], found[k])
        return sizes, ids, start, end

    return solve


def encode(model: PieceModel, table: UnitTable, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Ids, start bytes and end bytes of all texts, and where each text's pieces begin."""
    found, per_text, unit_at, first, last = units(model, texts)
    if not found:
        none = np.zeros(0, np.int32)
        return none, none, none, np.zeros(len(texts) + 1, np.int64)
    sizes, (ids, start, end) = table.look_up(found)
    base = np.repeat(unit_at, sizes)
    start, end = first[start + base], last[end + base - 1]
    owner = np.repeat(np.repeat(np.arange(len(texts)), per_text), sizes)
    if not model.byte_fallback:
        # Neighbouring unknown pieces of a text are one piece.
        again = (model.kinds[ids] == UNKNOWN) & np.concatenate([[False], model.kinds[ids[:-1]] == UNKNOWN])
        again[1:] &= owner[1:] == owner[:-1]
        heads = np.flatnonzero(~again)
        end = end[np.append(heads[1:], len(ids)) - 1]
        ids, start, owner = ids[heads], start[heads], owner[heads]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    return ids, start.astype(np.int32), end.astype(np.int32), ends


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends, decoded``: pieces, their byte spans, and the text decoded from the ids.

    ``model_path`` is read on every executor.
    """

    def run(batches):
        model = load(model_path)
        table = UnitTable(_solver(model))
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, start, end, at = encode(model, table, texts[a:b])
                flat, marks = ids.tolist(), at.tolist()
                back = [model.library.decode(flat[x:y]) for x, y in zip(marks, marks[1:], strict=False)]
                lists = [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(x)) for x in (ids, start, end)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *lists, pa.array(back, pa.string())], names
                )

    names = ["doc_id", "ids", "starts", "ends", "decoded"]
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    )


def token_sizes(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for every row: how many ids ``encoded`` gives, without the ids."""

    def run(batches):
        model = load(model_path)
        table = UnitTable(_solver(model))
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                *_, at = encode(model, table, texts[a:b])
                sizes = pa.array(np.diff(at).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes], ["doc_id", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"),
    )
