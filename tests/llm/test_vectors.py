"""The multi-index against all pairs, its traversal, and edge cases."""

import numpy as np
import pytest

from noteframe.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, weight int"


def brute_force(ids, rows, limit=0.9):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= limit
    group = list(range(len(ids)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(a), find(b)
        if a != b:
            group[max(a, b)] = min(a, b)
    return {i: (int(near[k].sum()) - 1, ids[find(k)]) for k, i in enumerate(ids)}


def planted(width=24, seed=3):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=width) for _ in range(500)]
    for base in rows[:40]:
        base = base / np.linalg.norm(base)
        for cosine in rng.uniform(0.86, 0.999, 6):
            aside = rng.normal(size=width)
            aside -= (aside @ base) * base
            rows.append(cosine * base + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside))
    rows += [rows[0]] * 30 + [2 * rows[1]] * 3
    return np.array(rows, np.float32)


def test_recall_and_precision_against_all_pairs(spark):
    rows = planted()
    ids = list(range(len(rows)))
    frame = spark.createDataFrame([(i, r.tolist(), 0, "x", 1) for i, r in enumerate(rows)], SCHEMA)
    plan = vectors.MultiIndex(cell_rows=16, block_rows=50)
    got = {r.vec_id: r for r in vectors.near_vectors(frame, plan).collect()}
    want = brute_force(ids, rows.astype(np.float64))
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == want[i][1] for i in ids) >= 0.99 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("inner", [6, 12])
def test_recall_where_vectors_vary_in_few_directions(spark, inner):
    rng = np.random.default_rng(inner)
    base = rng.normal(size=(inner, 48))
    spread = rng.normal(size=(1_500, inner))
    near = spread[rng.integers(0, 1_500, 1_500)] + rng.normal(size=(1_500, inner)) * 0.25
    rows = (np.vstack([spread, near]) @ base + rng.normal(size=(3_000, 48)) * 0.05).astype(np.float32)
    frame = spark.createDataFrame([(i, r.tolist(), 0, "x", 1) for i, r in enumerate(rows)], SCHEMA)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame, vectors.MultiIndex(cell_rows=12)).collect()}
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert want.sum() > 1_000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum()


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, one), (2, [2.0, 4.0, 6.0, 8.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 3.0, 4.0])]
    rows += [(7, [float("nan"), 2.0, 3.0, 4.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (None, one), (1, one)]
    rows += [(10, [3e38, -3e38, 3e38, -3e38]), (11, [1e-38, -1e-38] * 2), (12, [-0.0, 1.0, 0.0, 0.0]), (13, [0.0, 1.0, 0.0, -0.0])]
    frame = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = vectors.near_vectors(frame).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by_id[1] == (2, 1, True) and by_id[2] == (2, 1, False) and by_id[None] == (0, None, True)
    assert all(by_id[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9))
    assert by_id[10] == (1, 10, True) and by_id[11] == (1, 10, False)
    assert by_id[12] == (1, 12, True) and by_id[13] == (1, 12, False)
    assert vectors.near_vectors(frame.limit(0)).collect() == []
    assert [r.n_links for r in vectors.near_vectors(frame.where("vec_id = 3")).collect()] == [0]


def test_traversal_goes_by_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(9)
    sums = a[:, None] + b
    cells = list(vectors.traverse(a, b, 0.8))
    found = [sums[c] for c in cells]
    assert found == sorted(found)
    assert set(cells) == {tuple(c) for c in np.argwhere(sums <= sums.min() + 0.8).tolist()}
