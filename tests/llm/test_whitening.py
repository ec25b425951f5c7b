"""Bit-sliced whitening against plain integer and numpy sums."""

import numpy as np
import pytest

from noteframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", None) for i, v in rows], SCHEMA)


def integers(v):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]


def brute_force(rows, components=16):
    xs = {tuple(integers(v)) for _, v in rows}
    n, width = len(xs), len(next(iter(xs)))
    sums = [sum(x[d] for x in xs) for d in range(width)]
    centred = np.array([[float(x[d]) - sums[d] / n for d in range(width)] for x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in rows:
        x = integers(v)
        deviation = sum((n * x[d] - sums[d]) ** 2 for d in range(width))
        out[i] = (n, deviation, (np.array([x[d] - sums[d] / n for d in range(width)]) @ vectors) / np.sqrt(values))
    return out, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("width", [5, 24])
def test_equals_brute_force(spark, width):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(width, width))
    rows = [(k, (rng.normal(size=width) @ mixed * 0.2).tolist()) for k in range(300)]
    rows += [(400 + k, rows[0][1]) for k in range(150)] + [(None, rows[1][1])]
    want, explained = brute_force(rows)
    got = whitening.whitened(frame(spark, rows)).collect()
    each = min(16, width)
    assert len(got) == len(rows) * each and {r.component for r in got} == set(range(1, each + 1))
    signs = {r.component: np.sign(r.whitened * want[0][2][r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        n, deviation, white = want[r.vec_id]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation)
        assert r.whitened == pytest.approx(signs[r.component] * white[r.component - 1], rel=1e-7, abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-10


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(5)
    for reach, rows in ((3, 1), (40, 700), (2**40, 130), (2**62, 65)):
        y = rng.integers(-reach, reach, (rows, 4), dtype=np.int64)
        one = np.hstack([np.ones((rows, 1), object), y.astype(object)])
        want = np.triu(one.T @ one)
        got = whitening.block_products(y)
        assert (got[0] == want[0]).all() and (np.triu(got[1:, 1:]) == want[1:, 1:]).all()


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.1, 0.2]), (2, [0.5, -0.2]), (3, None), (4, [0.1, None]), (5, [nan, 0.1]), (6, [inf, 0.1]), (7, []), (8, [1.0])]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in (1, 2, 7, 8) for c in (1, 2)}
    # Two vectors vary along one line only; vectors of another length are not fitted.
    assert all((r.whitened is None) == (r.component == 2 or r.vec_id in (7, 8)) for r in got)
    assert all((r.deviation is None) == (r.vec_id in (7, 8)) and r.n == 2 for r in got)
    assert {round(abs(r.whitened), 9) for r in got if r.whitened is not None} == {1.0}
    huge = whitening.whitened(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id < 3) and all(np.isfinite(r.whitened) for r in huge if r.component == 1)
    same = whitening.whitened(frame(spark, [(1, [0.5]), (2, [0.5])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, 0.0)] * 2
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, [])])).collect() == []
