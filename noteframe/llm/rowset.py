"""Rows chosen by key sets of any size without moving the rows.

A set of keys becomes a table of bits of bounded size, which tells most rows that are surely not in
the set. Only keys of the others are shuffled to the set itself, so every answer is exact and long rows stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.llm.native import packed
from noteframe.session import cut

CHUNK_BITS = 18
MOST_BITS = 28  # 32 MB at any number of keys
BUFFER = 1 << 20  # hashes that a task deals to chunks at once
PROBES = (12, 30, 46)  # where a hash holds its three places in the chunk that its low bits name


def bit_table(grams: DataFrame, most: int | None = None):
    """Broadcast bits of the hashes ``gram``: about 16 a row, at most ``2 ** MOST_BITS``. ``most`` bounds the rows where they are not to be counted."""
    rows = grams.count() if most is None else most
    size = 1 << int(np.clip(int(16 * rows).bit_length(), CHUNK_BITS, MOST_BITS))
    chunks = size >> CHUNK_BITS

    def deal(held: list[np.ndarray]):
        gram = np.unique(np.concatenate(held))
        part = gram & (chunks - 1)
        gram = gram[np.argsort(part, kind="stable")]
        ends = np.cumsum(np.bincount(part, minlength=chunks))
        for k in np.flatnonzero(np.diff(ends, prepend=0)):
            own = gram[ends[k - 1] if k else 0 : ends[k]]
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(k)]), "grams": pa.array([own.tobytes()], pa.binary())})

    def dealt(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(batch)
            if size >= BUFFER:
                yield from deal(held)
                held, size = [], 0
        if size:
            yield from deal(held)

    def chunk(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << CHUNK_BITS, np.uint8)
        for held in table["grams"]:
            gram = np.frombuffer(held.as_buffer(), np.int64)
            for shift in PROBES:
                on[(gram >> shift) & ((1 << CHUNK_BITS) - 1)] = 1
        packed_bits = np.packbits(on, bitorder="little").tobytes()
        return pa.table({"part": pa.array([table["part"][0].as_py()]), "bits": pa.array([packed_bits], pa.binary())})

    parts = grams.select("gram").mapInArrow(dealt, "part long, grams binary")
    found = parts.groupBy("part").applyInArrow(chunk, "part long, bits binary").toArrow()
    bits = np.zeros((chunks, 1 << (CHUNK_BITS - 3)), np.uint8)
    for part, held in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        bits[part] = np.frombuffer(held, np.uint8)
    return grams.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the table; never false for one that is."""
    part = gram & (len(bits) - 1)
    may = np.ones(len(gram), bool)
    for shift in PROBES:
        at = (gram >> shift) & ((1 << CHUNK_BITS) - 1)
        may &= (bits[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return may


def maybe_in(keys: list[Column], table: DataFrame) -> Column:
    """Whether ``keys`` may be a row of ``table``: only the hash of the keys leaves the row."""
    bits = bit_table(table.select(F.xxhash64(*table.columns).alias("gram")))

    @F.pandas_udf("boolean")
    def held(gram: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, gram.to_numpy()))

    return held(F.xxhash64(*keys))


def _chosen(rows: DataFrame, keys: dict[str, Column], table: DataFrame, inside: bool) -> DataFrame:
    names = list(keys)
    held = packed(rows).select("row", *[c.alias(n) for n, c in keys.items()])
    may = maybe_in([F.col(n) for n in names], table.select(*names))
    wanted = held.where(may).select(*names).distinct()
    wanted = cut(wanted.join(table, names, "left_semi" if inside else "left_anti"))
    # Outside a set few keys are wanted: those that share their bits with it by chance.
    few = maybe_in([F.col(n) for n in names], wanted)
    found = held.where(may & few).join(wanted, names, "left_semi").select("row.*")
    return found if inside else held.where(~may).select("row.*").unionByName(found)


def without(rows: DataFrame, keys: dict[str, Column], table: DataFrame) -> DataFrame:
    """The rows whose keys are not in ``table``, with their own columns.

    ``keys`` are expressions over ``rows`` (as ``row.column``) that are never null, under the names of the columns of ``table``.
    """
    return _chosen(rows, keys, table, False)


def within(rows: DataFrame, keys: dict[str, Column], table: DataFrame) -> DataFrame:
    """The rows whose keys are in ``table``, with their own columns."""
    return _chosen(rows, keys, table, True)
