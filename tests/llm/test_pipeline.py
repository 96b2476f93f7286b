"""The pipeline's stages against a plain version of each, on the smallest table and on odd rows."""

import corpus_pipeline
from textloom.llm import language_id, quality

SF_DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "packing"]
    good = corpus_pipeline.quality_rules(spark, docs, SF_DIR)
    passed = {r["doc_id"] for r in docs.select("doc_id", quality.measures(min_words=1).alias("m")).where("m.kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == passed and good.columns == docs.columns
    known = corpus_pipeline.language(spark, good, SF_DIR)
    assert known.columns == docs.columns and known.count() == good.count()  # all of it is prose in known languages
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").join(docs, "doc_id", "left_semi")
    assert labels.join(good, "doc_id", "left_semi").count() >= 0.99 * labels.count()  # clean documents, short ones too, are left alone
    single = corpus_pipeline.near_duplicates(spark, known, SF_DIR)
    groups = single.count()
    assert single.columns == docs.columns and groups < known.count()
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r["text"].lower().split() for r in single.collect())]
    assert not [1 for i, a in enumerate(shingles) for b in shingles[:i] if len(a & b) >= 0.8 * len(a | b)]
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.select("doc_id").distinct().count() == groups


def test_language_stage_rejects_texts_without_letters(spark):
    rows = [(i, "the cat and the dog were in the house " * 5, "en", "s", 1) for i in range(20)] + [(99, "12 34 ... 56", "en", "s", 1), (100, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in language_id.keep_known(docs).collect()} == set(range(20))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
