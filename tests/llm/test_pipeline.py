"""The corpus pipeline stage by stage."""

import corpus_pipeline
from noteframe.llm import near_dups, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.columns
    ids = [{r.doc_id for r in docs.collect()}]
    want = [
        lambda d: quality.quality_counts(d).where("kept"),
        lambda d: toxicity.toxicity_scores(d, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0"),
        lambda d: near_dups.near_duplicates(d, near_dups.PIPELINE).where("kept"),
    ]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "packing"]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        kept = {r.doc_id for r in expected(docs).collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == start
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] == kept and ids[-1] <= ids[-2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids[-1] and len(ids[-1]) < len(ids[0])
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids[-1]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated texts, shared and missing ids, columns that clash with those inside, and an empty table."""
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, "en", "s"), (1, good, "en", "s"), (None, good + " more", None, None), (2, None, "en", None), (3, "", None, "s")]
    rows += [(4, " ".join(f"other{k}" for k in range(60)), "en", "s"), (4, " ".join(f"third{k}" for k in range(60)), "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, id long, counts int, kept boolean"
    odd = spark.createDataFrame([(*r, None, "x", 1, 2, 3, False) for r in rows], schema)
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns, name
        texts.append(sorted(((r.doc_id or 0), (r.text or "")[:6]) for r in kept.collect()))
        assert stage(spark, odd.limit(0), SF).collect() == []
    whole = sorted(((r[0] or 0), (r[1] or "")[:6]) for r in rows)
    assert texts[0] == [r for r in whole if r[1]]  # short texts fail the rules
    assert texts[1] == whole  # nothing toxic
    assert texts[2] == sorted({r for r in whole if r[0] or not r[1]})  # the copy without an id goes, both texts of 4 stay
    packed = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in packed(spark, odd, SF).collect()} == {None, 1, 2, 3, 4}
    assert packed(spark, odd.limit(0), SF).collect() == []
