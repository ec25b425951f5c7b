"""String kernel against plain sets, held-out accuracy, edge cases."""

import os
import zlib

import numpy as np
import pytest

from noteframe.llm import language_id

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, held_out string, score string"


def plain_set(text, order):
    text = "".join(c.lower() if c.isalpha() else " " for c in text)
    text = f" {' '.join(text.split())} " if text.split() else " "
    return {text[k : k + n] for n in range(1, order + 1) for k in range(len(text) - n + 1)}


def test_kernel_equals_plain_sets(monkeypatch):
    monkeypatch.setattr(language_id, "_SLICE", 7)
    texts = ["Der Tag, 12 Tage!", "the day — the NIGHT", "", "  ", "été à l'île", "日本 語", "x" * 300, "Ǆ \U0001d4d0ab"]
    sets = [language_id.grams(t, 3) for t in texts]
    plain = [plain_set(t, 3) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    labels = ["de", "en", "en", "en", "fr", "ja", "xx", "yy"]
    model = language_id.fit(sets, labels)
    order = [k for name in model.languages for k, x in enumerate(labels) if x == name]
    got = language_id.kernel(model, sets)
    for a in range(len(texts)):
        for column, b in enumerate(order):
            want = len(plain[a] & plain[b]) / np.sqrt(len(plain[a]) * len(plain[b]))
            assert got[a, column] == pytest.approx(want, rel=1e-6)


def test_nystroem_with_all_landmarks_is_kernel_ridge():
    rng = np.random.default_rng(1)
    words = {"aa": "ka lo mi tu", "bb": "strunk plomf grank"}
    labels = [name for name in words for _ in range(12)]
    texts = [" ".join(rng.choice(words[name].split(), 3).tolist() + ["end", "x" * k]) for k, name in enumerate(labels)]
    plan = language_id.LanguageId(landmarks=24, ridge=1e-2)
    sets = [language_id.grams(t, 3) for t in texts]
    model = language_id.fit(sets, labels, plan)
    got = language_id.kernel(model, sets) @ model.dual + model.bias
    plain = [plain_set(t, 3) for t in texts]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in plain] for a in plain])
    n = len(k)
    centring = np.eye(n) - 1 / n
    target = np.where(np.array(labels)[:, None] == np.array(["aa", "bb"]), 1.0, -1.0)
    centred = centring @ k @ centring
    want = centred @ np.linalg.solve(centred + plan.ridge * n * np.eye(n), target - target.mean(0)) + target.mean(0)
    assert np.allclose(got, want, atol=1e-4)


def test_edge_cases(spark):
    text = {"en": "the night and the day of the house", "fr": "la nuit et le jour dans une maison"}
    rows = [(k, f"{text[lang]} {'xyz'[k % 3]}", lang, None) for k in range(60) for lang in ("en", "fr")]
    rows += [(100, None, "en", None), (101, "123 !?", "fr", None), (102, "", None, None), (103, "the day and the night", None, None)]
    rows += [(None, "le jour et la nuit", "fr", None), (0, "la maison", "fr", None), (104, "la nuit " * 40_000, None, None)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = language_id.languages(frame).collect()
    assert len(got) == len(rows)
    for r, (doc, _, lang, _) in zip(got, rows, strict=True):
        assert r.doc_id == doc and r.held_out == (doc is None or zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if doc in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif lang:
            assert r.lang_pred == lang
    assert [r.lang_pred for r in got if r.doc_id in (103, 104)] == ["en", "fr"]
    assert language_id.languages(frame.limit(0)).collect() == []
    unlabelled = frame.where("doc_id >= 103 AND lang IS NULL")
    assert [(r.lang_pred, r.score) for r in language_id.languages(unlabelled).collect()] == [("und", 0)] * 2
    one = frame.where("lang = 'fr' OR doc_id = 103")
    assert {r.lang_pred for r in language_id.languages(one).collect()} == {"fr", "und"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.languages(docs).collect() if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == want[r.doc_id] for r in got)
    assert len(got) > 250 and right >= 0.98 * len(got)
