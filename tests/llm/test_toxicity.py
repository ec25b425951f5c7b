"""Kneser-Ney evidence, held-out accuracy and edge cases."""

import random
import zlib

import numpy as np

from noteframe.llm import toxicity as tox

SCHEMA = "doc_id long, text string, score string, toxic int"
LABELS = "doc_id long, quality int, toxic int"
STEMS = ["blarg", "zonkhe", "krupso"]


def corpus(n=900, seed=4):
    rnd = random.Random(seed)
    parts = ["an", "er", "the", "in", "ou", "st", "re", "ti", "on", "le"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(15, 200))]
        bad = k % 8 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            words[rnd.randrange(len(words))] = rnd.choice(STEMS) + rnd.choice(parts)
        rows.append((k, " ".join(words), None, None))
        if k % 3:
            labels.append((k, 1, int(bad)))
    return rows, labels


def test_unlabelled_and_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in tox.toxicity_scores(docs, marks).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    wrong = [k for k, r in got.items() if r.predicted != int(k % 8 == 0)]
    assert len(wrong) <= 0.01 * len(rows)
    stayed = tox.keep_ordinary(docs, marks)
    assert stayed.columns == docs.columns
    assert {r.doc_id for r in stayed.collect()} == {k for k, r in got.items() if not r.predicted}


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (
        {r.doc_id: r.score for r in tox.toxicity_scores(docs, spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, flipped)
    )
    assert a == b


def test_nulls_repeats_and_long_texts(spark):
    rows, labels = corpus(200)
    rows += [(None, "blarg an", None, None), (None, None, None, None), (5000, None, "x", 1), (5001, "", "x", 1)]
    rows += [(8, rows[8][1], None, None), (5002, "an er " * 100_000 + "zonkhean", None, None)]
    labels += [(None, 1, 1), (8, 1, None), (8, 1, 0), (8, 1, 1), (5000, None, 0)]
    got = tox.toxicity_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score and not by_id[None].held_out
    assert by_id[5002].predicted == 1


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", None, None), (2, "c", None, None)], SCHEMA)
    for toxic, want in ((0, 0.0), (1, 1.0), (None, 0.0)):
        marks = spark.createDataFrame([(1, 1, toxic), (2, 1, toxic)], LABELS)
        assert [r.score for r in tox.toxicity_scores(docs, marks).collect()] == [want, want]
    empty = docs.limit(0)
    assert tox.toxicity_scores(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_smoothed_probabilities_add_up():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, (tox.SYMBOLS, tox.SYMBOLS))
    p = tox._smoothed(counts, np.full(tox.SYMBOLS, 1 / tox.SYMBOLS), 0.75)
    assert np.allclose(p.sum(axis=-1), 1)


def test_grams_stop_at_word_borders():
    gram, word, owner = tox.grams(["ab  ab", "", "ab"])
    a, b = 1, 2
    one = [a, a << 5 | b, a << 10 | b << 5]
    assert gram.tolist() == one * 3 and owner.tolist() == [0] * 6 + [2] * 3
    assert len(set(word.tolist())) == 3


def test_expressions_of_several_words_and_other_scripts_are_learned(spark):
    rnd = random.Random(9)
    plain = ["river", "green", "stone", "cloud", "night", "table", "paper", "light", "house", "water"]
    greek, han = [chr(k) for k in range(0x3B1, 0x3C9)], [chr(k) for k in range(0x4E00, 0x4E28)]
    bad_greek = "".join(greek[k] for k in (3, 7, 1, 9, 4))
    bad_han = han[3] + han[30] + han[17]
    rows, labels = [], []
    for k in range(900):
        bad = k % 6 == 0
        kind = k // 6 % 3
        if kind == 0:  # every word is ordinary, only the pair is not
            words = [rnd.choice(plain) for _ in range(40)]
            words = [w for i, w in enumerate(words) if not (i and w == "stone" and words[i - 1] == "green")]
            text = " ".join(words).replace("green stone", "green") + (" night green stone house" if bad else " green night stone")
        elif kind == 1:
            words = ["".join(rnd.choice(greek) for _ in range(5)) for _ in range(40)]
            text = " ".join([*words, bad_greek] if bad else words)
        else:
            text = "".join(rnd.choice(han) for _ in range(60)) + (bad_han if bad else "")
        rows.append((k, text, None, None))
        labels.append((k, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in tox.toxicity_scores(docs, marks).collect() if r.held_out}
    assert len(got) > 100 and {k // 6 % 3 for k in got if k % 6 == 0} == {0, 1, 2}
    assert sum(r.predicted != int(k % 6 == 0) for k, r in got.items()) <= 0.02 * len(got)


def test_expression_evidence_equals_a_plain_model(spark):
    rows, labels = corpus(240, seed=8)
    toxic = {k: t for k, _, t in labels}
    train = spark.createDataFrame([(t, toxic[k]) for k, t, _, _ in rows if k in toxic], "text string, toxic int")
    plan = tox.Toxicity(least=1.0)
    known, values = tox.word_evidence(train, plan)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in known.select("t", "o", *values).distinct().collect()}

    held = {0: {}, 1: {}}
    for k, text, _, _ in rows:
        if k in toxic:
            words = text.split(" ")
            for e in {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}:
                held[toxic[k]][e] = held[toxic[k]].get(e, 0) + 1
    pairs = [sum(held[c].values()) for c in (0, 1)]

    def log_p(n, kinds, c):
        shared = kinds / (len(held[0]) + len(held[1]))
        return np.log((max(n - plan.discount, 0) + plan.discount * len(held[c]) * shared) / pairs[c])

    def evidence(t, o):
        kinds = (t > 0) + (o > 0)
        return max(log_p(t, kinds, 1) - log_p(o, kinds, 0) - plan.least, 0) if t > 0 else 0.0

    wanted = {}
    for e, t in held[1].items():
        o = held[0].get(e, 0)
        value = (evidence(t, o), evidence(t - 1, o), evidence(t, max(o - 1, 0)))
        if max(value) > 0:
            wanted[t, o] = value
    # Distinct expressions are estimated within about 1 %, so a pair of counts right at the threshold may differ.
    assert {p for p, v in wanted.items() if max(v) > 0.1} <= set(got) and len(wanted) > 5
    for p, v in got.items():
        assert np.allclose(v, wanted.get(p, (0, 0, 0)), atol=0.06), p


def test_sketch_counts_distinct_hashes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500, 20_000, 400_000):
        gram = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        found = np.unique(tox.registers(np.concatenate([gram, gram[: n // 2]])))
        assert abs(tox.distinct_count(found) - n) <= 0.04 * n
