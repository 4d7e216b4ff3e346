"""The pipeline's stages on the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= docs.count() and kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def texts_of(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages_chain_before_anything_is_written(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = corpus_pipeline.drop_copies(spark, docs, SF), corpus_pipeline.drop_copies(spark, docs.where("doc_id % 2 = 0"), SF)
    near = corpus_pipeline.drop_near_copies(spark, one, SF)
    packed = corpus_pipeline.pack(spark, near, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in near.collect()} <= {r.doc_id for r in one.collect()}
    assert {r.doc_id for r in two.collect()} and all(r.doc_id % 2 == 0 for r in two.collect())


def test_two_pipelines_at_once_and_tables_given_back(spark):
    from concurrent.futures import ThreadPoolExecutor

    from decilog.llm.common import Scratch

    left = Scratch(), Scratch()
    with ThreadPoolExecutor(2) as pool:
        made = [sorted(map(tuple, df.select("doc_id", "piece", "ids_crc32").collect())) for df in pool.map(lambda own: corpus_pipeline.run(spark, SF, own), left)]
    assert made[0] == made[1] and made[0]
    for own in left:
        own.clear()
        assert not own.tables


def test_a_labelled_id_that_many_rows_repeat_is_one_text(spark):
    from decilog.llm.common import labelled_texts

    docs = spark.createDataFrame([(1, f"text {k:04d}") for k in range(3000)] + [(2, "x" * 50), (3, "y"), (4, None), (5, "both"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1), (None, 1), (6, 1), (3, None)], "doc_id long, toxic int")
    assert labelled_texts(docs, labels, "toxic", {1: 10, 0: 10}) == [(1, "text 0000", 1), (2, "x" * 50, 0), (3, "y", 0)]
    assert len(labelled_texts(docs, labels, "toxic", {1: 10, 0: 1})) == 2
    small = labelled_texts(docs, labels, "toxic", {1: 10, 0: 10}, max_chars=20)
    assert sum(len(t) for _, t, _ in small) <= 20
