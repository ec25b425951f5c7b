"""Near duplicates against all pairs, and SuperMinHash against true similarity."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from noteframe.llm import near_dups
from noteframe.llm.groups import components

SCHEMA = "doc_id long, text string, id string, component string"


def shingles(text, size):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).split() if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute_force(rows, plan):
    sets = {i: shingles(t, plan.words) for i, t in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= plan.percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def planted(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = ["", None, "  \n", "One", "one", "ONE two Three", "one two three"]
    for size in (20, 60, 200, 700):
        base = [word() for _ in range(size)]
        for share in (0.0, 0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08):
            for _ in range(4):
                copy = [word() if rnd.random() < share else w for w in base]
                texts.append(" ".join(copy[: int(len(copy) * rnd.choice((1, 1, 0.9, 0.82, 0.78)))]))
    # Documents that share a passage but are not alike.
    texts += [" ".join(passage + [word() for _ in range(rnd.randrange(20, 90))]) for _ in range(60)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("plan", [near_dups.CONTRACT, near_dups.PIPELINE])
def test_equals_all_pairs(spark, plan):
    rows = planted(plan.words)
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, plan).collect()}
    assert got == brute_force(rows, plan)
    stayed = near_dups.keep_one(docs, plan)
    assert stayed.columns == docs.columns
    assert sorted(r.doc_id for r in stayed.collect()) == sorted(i for i, v in got.items() if v[2])


def test_leftover_groups_are_joined_exactly(spark):
    """A few bands leave most links to the prefix join over differences."""
    plan = near_dups.NearDup(bands=26, rows=2)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(f"v{rnd.randrange(9999)}" if rnd.random() < 0.03 else w for w in base) for _ in range(120)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, plan).collect()}
    assert got == brute_force(rows, plan)


def test_rows_without_or_with_repeated_ids(spark):
    text = "the same five words again and again here"
    rows = [(None, text), (None, text), (7, text), (7, text), (3, text), (9, "something else entirely, with words")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect() if r.doc_id)
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    assert sorted((r.doc_id or 0) for r in near_dups.keep_one(docs).collect()) == [3, 9]


def test_keep_one_judges_texts_not_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (None, b), (None, c), (None, c), (5, None), (6, ""), (None, None), (None, " ")]
    rows += [(8, c + " longer"), (9, "alone with its six words here"), (9, "alone with its six words here")]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    stayed = near_dups.keep_one(docs)
    assert stayed.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in stayed.collect())
    # 2 speaks for a, 8 for c; b is left once, under either row; texts without words all stay.
    b_rows = {k: n for k, n in kept.items() if k[1] == b}
    assert sum(b_rows.values()) == 1
    want = {(2, a + " more"): 1, (8, c + " longer"): 1, (9, rows[-1][1]): 1}
    want |= {(5, None): 1, (6, ""): 1, (None, None): 1, (None, " "): 1}
    assert {k: n for k, n in kept.items() if k[1] != b} == want
    assert near_dups.keep_one(docs.limit(0)).collect() == []


def test_empty_table(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = pool[:300], pool[100:]
        values, owner = np.concatenate([a, b]), np.repeat([0, 1], [300, 300])
        low = near_dups.superminhash(values, owner, 2, 128)
        errors.append((low[0] == low[1]).mean() - 0.5)
        assert np.isfinite(low).all()
    assert abs(np.mean(errors)) < 0.02
    # Plain MinHash has variance s (1 - s) / m; correlated ranks stay below it.
    assert np.std(errors) < np.sqrt(0.25 / 128) * 1.15


def test_superminhash_of_small_sets_fills_all_slots():
    low = near_dups.superminhash(np.array([1, 2], np.uint64), np.array([0, 0]), 1, 64)
    assert np.isfinite(low).all()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (3, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(10, 61)} == {3} and {got[k] for k in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_permutations_are_held_by_blocks(monkeypatch):
    rnd = np.random.default_rng(4)
    values = rnd.integers(0, 1 << 63, 300_000).astype(np.uint64)
    owner = np.repeat(np.arange(1_000), 300)
    tracemalloc.start()
    low = near_dups.superminhash(values, owner, 1_000, 130)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all permutations at once take 39 MB, and twice that while they are thinned out
    monkeypatch.setattr(near_dups, "BLOCK", 777)
    some = owner < 20
    assert np.array_equal(near_dups.superminhash(values[some], owner[some], 20, 130), low[:20])


def test_texts_without_a_shared_bucket_are_not_moved(spark, monkeypatch):
    """Without broadcasts too, a text is tested by its id before it is shuffled."""
    plans = {}

    def noted(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return df.localCheckpoint()

    monkeypatch.setattr(near_dups, "cut", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k, " ".join(f"w{k // 2 if k < 4 else k}x{j}" for j in range(30)), None, None) for k in range(40)]
        docs = spark.createDataFrame(rows, SCHEMA)
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: k - k % 2 if k < 4 else k for k in range(40)}
    plan = plans["id", "set"].splitlines()
    scan = next(i for i, line in enumerate(plan) if "Scan ExistingRDD" in line and "text" in line)
    moved = max(i for i, line in enumerate(plan[:scan]) if "Exchange" in line)
    assert any("ArrowEvalPython" in line for line in plan[moved:scan])
