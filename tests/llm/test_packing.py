"""The counted plan against best fit one piece at a time, and whole packings."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noteframe.llm import packing

SCHEMA = "doc_id long, text string, length string, part int"


def one_by_one(lengths, opens):
    """Best-fit decreasing without counting: contents of every bin."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= length]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            best = [opens(length), []]
            bins.append(best)
        best[0] -= length
        best[1].append(length)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_one_by_one(seed):
    rnd = random.Random(seed)
    plan = packing.Packing(capacities=(16, 40, 100))
    lengths = [rnd.choice((rnd.randint(1, 100), rnd.randint(1, 12), 7)) for _ in range(rnd.randint(1, 300))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    costs = []
    for rule in packing.opening_rules(plan):
        counted = packing.best_fit(histogram, rule)
        plain = one_by_one(lengths, rule)
        sizes = lambda bins: sorted(bins)
        assert sizes(b.room for b in counted for _ in range(b.count)) == sizes(b[0] for b in plain)
        size = lambda used: min(s for s in plan.capacities if s >= used)
        costs.append(sum(plan.cost(size(sum(b[1]))) for b in plain))
    chosen = packing.plan_bins(histogram, plan)
    assert sum(b.count * plan.cost(size) for b, size in chosen) == pytest.approx(min(costs))


def test_all_tokens_are_packed_once(spark):
    rnd = random.Random(1)
    texts = [None, "", "one", "word " * 20_000] + ["w " * rnd.randint(0, 900) for _ in range(300)] + ["same length here"] * 200
    rows = [(k if k % 9 else None, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = packing.pack(docs).collect()
    pieces = defaultdict(list)
    for r in out:
        pieces[r.bin_id].append((r.position, r.length, r.bin_size, r.bin_used))
    for items in pieces.values():
        items.sort()
        end = 0
        for position, length, size, used in items:
            assert position == end
            end += length
        assert end == items[0][3] <= items[0][2] and items[0][2] == min(s for s in packing.PLAN.capacities if s >= end)
    want = sum(len((t or "").split()) + 1 for t in texts)
    assert sum(r.length for r in out) == want
    long = sorted((r.first, r.last) for r in out if r.doc_id is not None and r.doc_id == 3 or (r.doc_id is None and r.piece))
    assert len([r for r in out if r.piece]) == 2 and long[-1][1] == 20_001


def test_given_length_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", None, 10), (2, "b", None, 0), (3, "c", None, 30)], SCHEMA)
    out = packing.pack(docs, packing.Packing(capacities=(16, 40)), F.col("part").cast("long")).collect()
    assert sum(r.length for r in out) == 40 and {r.doc_id for r in out} == {1, 3}
    assert packing.pack(docs.limit(0)).collect() == []


def test_queries_pack_tokens_not_words(spark, tmp_path):
    import corpus_pipeline
    from noteframe.llm import catalog, sentence_pieces

    rnd = random.Random(5)
    han = lambda n: "".join(chr(rnd.randint(0x4E00, 0x5FFF)) for _ in range(n))
    rows = [(1, han(20_000), "x", 0), (2, "internationalisation " * 700, "x", 0), (3, None, "x", 0), (4, han(30), "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.doc_id: len(r.ids) for r in sentence_pieces.encoded(docs, catalog.piece_model()).collect()}
    for out in (catalog.QUERIES["op9_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        filled, sizes, lengths = defaultdict(int), {}, defaultdict(int)
        for r in out.collect():
            lengths[r.doc_id] += r.length
            filled[r.bin_id] += r.length
            sizes[r.bin_id] = r.bin_size
            assert r.last - r.first == r.length
        assert lengths == {k: n + 1 for k, n in ids.items()} and ids[1] > 8_192
        assert all(n <= sizes[b] for b, n in filled.items())
