"""Quality counts and fences against plain Python."""

import random
import re
from collections import Counter

from noteframe.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, counts int"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_counts_equal_plain_python(spark):
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "one", "a b c d e f g h", "x " * 30, "\n".join(["same line here"] * 9), "é🎈 " * 10, "a b #$%"]
    texts += [" ".join(rnd.choice("abc") for _ in range(n)) + rnd.choice(["", "\n", " | ##"]) for n in range(0, 90, 3)]
    texts.append(" ".join(f"w{rnd.randrange(3000)}" for _ in range(20_000)) + "\n" + "tail of eight words that comes back again\n" * 3)
    rows = [(k, t, "en", None, "clash", k) for k, t in enumerate(texts)] + [(None, "a b", None, "s", None, None)] * 2
    got = quality.quality_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, text in enumerate(texts):
        r = by_id[k]
        want = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def corpus():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    rows = []
    for k in range(600):
        words = [word() for _ in range(80)]
        if k % 50 == 0:
            words = [w + "$$$" for w in words]
        rows.append((k, " ".join(words), "en", "hot" if k % 3 else f"s{k % 7}", None, None))
    return rows


def test_fences_reject_outliers_and_keep_the_rest(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = {r.doc_id: r.kept for r in quality.quality_counts(docs).collect()}
    assert {k for k, ok in kept.items() if not ok} == {k for k in range(600) if k % 50 == 0}
    stayed = quality.keep_good(docs)
    assert stayed.columns == docs.columns
    assert {r.doc_id for r in stayed.collect()} == {k for k, ok in kept.items() if ok}


def test_small_groups_borrow_the_wider_sketch(spark):
    rules = quality.QualityRules(min_group=100)
    rows = [(k, "word " + " ".join(f"w{k}{j}" for j in range(40)), "en", "big", None, None) for k in range(200)]
    rows.append((999, " ".join(f"###{j}" for j in range(40)), "en", "tiny", None, None))
    got = {r.doc_id: r.kept for r in quality.quality_counts(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got[0] and not got[999]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.quality_counts(empty).collect() == []
    assert quality.keep_good(empty).collect() == []
