"""Whitening of vectors from a bit-sliced scatter matrix.

Every entry ``c`` becomes the integer ``x = floor(64 c) + 1000000``. Equal vectors are one row of the fit
list. Its scatter matrix is counted, not multiplied: in blocks of rows each dimension is shifted to its least value,
its bit planes are packed across the rows into 64-bit words, and the popcounts of the ANDs of two planes, weighted
by their powers of two, are the exact cross-product of two dimensions. Tasks add their blocks up and Spark
sums the tasks, so the driver receives one integer for each pair of dimensions, whatever the number of rows. Products are centred as
integers (``n * sum(x_i x_j) - S_i S_j``) before the one division that makes them doubles for ``eigh``.

Defined results: vectors that are null or hold null or non-finite entries have no row; rows without ``vec_id`` and repeated
rows are kept as they are. The width is the most frequent length of at least one (the longer of two as frequent);
a vector of another length is not fitted and has null ``deviation`` and ``whitened``. Entries beyond
2**56 in size count as 2**56. Narrow vectors have as many components as dimensions; a component without
variance has null ``whitened`` and takes no part in ``identity_error``. A ``deviation`` beyond a long is null; ``deviation_exact`` holds it
up to 38 digits. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
ENTRY = 2.0**56  # larger entries count as this much, so that 64 times it is a long
BLOCK = 4_096  # rows whose bit planes are packed at once
COMPONENTS = 16
_LIMB = 40
OUT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_exact decimal(38,0)"
)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gave: its size, sums less the shift, components and their eigenvalues."""

    n: int
    sums: np.ndarray  # of x - SHIFT, Python integers
    vectors: np.ndarray  # one column per component
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def bit_planes(z: np.ndarray, bits: int) -> np.ndarray:
    """``(dimension, bit, word)``: bit planes of unsigned ``z`` (rows x dimensions), 64 rows in a word."""
    words = -(-len(z) // 64)
    planes = np.zeros((z.shape[1], bits, words * 8), np.uint8)
    for p in range(bits):
        packed = np.packbits((z.T >> np.uint64(p)) & np.uint64(1) != 0, axis=1)
        planes[:, p, : packed.shape[1]] = packed
    return planes.view(np.uint64)


def block_products(y: np.ndarray) -> np.ndarray:
    """Exact products of all pairs of columns of ``(1, y)``, as Python integers."""
    rows, width = y.shape
    low = y.min(axis=0)
    z = (y - low).view(np.uint64)
    bits = max(1, int(z.max(initial=0)).bit_length())
    planes = bit_planes(z, bits)
    # 64-bit sums where they cannot overflow, else Python integers.
    kind = np.int64 if 2 * bits + rows.bit_length() < 62 else object
    weight = np.array([1 << q for q in range(bits)], kind)
    sums = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(kind) @ weight
    cross = np.zeros((width, width), kind)
    for i in range(width):
        for p in range(bits):
            if planes[i, p].any():
                both = np.bitwise_count(planes[i:] & planes[i, p]).sum(axis=2, dtype=np.int64)
                cross[i, i:] += (both.astype(kind) @ weight) * weight[p]
    cross, sums, low = cross.astype(object), sums.astype(object), low.astype(object)
    out = np.zeros((width + 1, width + 1), object)
    out[0, 0] = rows
    out[0, 1:] = sums + rows * low
    out[1:, 1:] = np.triu(cross + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _scatter(width: int):
    """The products of one task, each cut into limbs that sum without overflow."""
    i, j = np.triu_indices(width + 1)

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            y = _matrix(batch.column(0), width)
            for k in range(0, len(y), BLOCK):
                total += block_products(y[k : k + BLOCK])
        if not total[0, 0]:
            return
        values, mask = total[i, j], (1 << _LIMB) - 1
        for k in range(0, len(i), 50_000):
            part = values[k : k + 50_000]
            limbs = [part & mask, part >> _LIMB & mask, part >> 2 * _LIMB]
            columns = [i[k : k + 50_000], j[k : k + 50_000], *(x.astype(np.int64) for x in limbs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "a", "b", "c"])

    return run


def whitening(products: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Components from the summed products of ``(1, y)``, centred as integers."""
    n, sums = int(products[0, 0]), products[0, 1:]
    cross = np.triu(products[1:, 1:]) + np.triu(products[1:, 1:], 1).T
    centred = n * cross - np.outer(sums, sums)
    cov = (centred / (n * n)).astype(np.float64)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0)[:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(centred) / (n * n))
    live = values > len(cov) * np.finfo(float).eps * values[0]
    scaled = vectors[:, live] / np.sqrt(values[live])
    off = np.abs(scaled.T @ cov @ scaled - np.eye(scaled.shape[1])).max(initial=0.0)
    explained = values / trace if trace else np.zeros_like(values)
    return Whitening(n, sums, vectors, np.where(live, values, 0.0), explained, float(off))


def _project(fit: Whitening, width: int):
    """The rows of the result of each vector, one per component."""
    each = len(fit.values)
    scaled = np.divide(fit.vectors, np.sqrt(fit.values), out=np.zeros_like(fit.vectors), where=fit.values > 0)
    far = int(np.abs(fit.sums).max())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                part = batch.slice(k, 2_000)
                ids, column = part.column(0), part.column(1)
                fits = pa.compute.equal(pa.compute.list_value_length(column), width).to_numpy(zero_copy_only=False)
                y = _matrix(column.filter(pa.array(fits)), width)
                reach = fit.n * int(np.abs(y).max(initial=0)) + far
                moved = fit.n * (y if reach < 1 << 62 else y.astype(object)) - fit.sums.astype(np.int64 if reach < 1 << 62 else object)
                wide = moved if width * reach**2 < 1 << 63 else moved.astype(object)
                squares = (wide * wide).sum(axis=1)
                white = (moved.astype(np.float64) / fit.n) @ scaled
                at = np.flatnonzero(fits)
                deviation, exact = np.full(len(part), None, object), np.full(len(part), None, object)
                for row, value in zip(at.tolist(), squares.tolist(), strict=True):
                    deviation[row] = value if value < 1 << 63 else None
                    exact[row] = Decimal(value) if value < 10**38 else None
                out = np.full((len(part), each), np.nan)
                out[at] = np.where(fit.values > 0, white, np.nan)
                flat, rows = out.ravel(), np.repeat(np.arange(len(part)), each)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(rows), fit.n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(rows)),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(np.tile(fit.explained, len(part))),
                        pa.array(np.full(len(rows), fit.identity_error)),
                        pa.array(exact, pa.decimal128(38, 0)).take(pa.array(rows)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return run


def integers(rows: DataFrame) -> DataFrame:
    """``vec_id, y`` with ``y = floor(64 c)`` for every vector whose entries are all finite."""
    entries = F.col("embedding").cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = rows.where(F.coalesce(good, F.lit(False)))
    bounded = F.transform(entries, lambda c: F.floor(SCALE * F.greatest(F.least(c, F.lit(ENTRY)), F.lit(-ENTRY))))
    return held.select("vec_id", bounded.alias("y"))


def fitted(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of ``width`` entries."""
    # A vector that many rows share is dropped to one in each task, before the shuffle.
    once = vectors.where(F.size("y") == width).select("y").distinct()
    parts = once.mapInArrow(_scatter(width), "i long, j long, a long, b long, c long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "abc"]).toArrow()  # one row per pair of dimensions
    products = np.zeros((width + 1, width + 1), object)
    for i, j, a, b, c in zip(*(column.to_pylist() for column in sums.columns), strict=True):
        products[i, j] = a + (b << _LIMB) + (c << 2 * _LIMB)
    return whitening(products, components)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    vectors = integers(rows)
    sizes = vectors.where(F.size("y") > 0).groupBy(F.size("y").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return vectors.where("false").selectExpr("vec_id", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in OUT.split(", ")])
    fit = fitted(vectors, common["size"], components)
    return vectors.mapInArrow(_project(fit, common["size"]), f"vec_id {kind}, {OUT}")
