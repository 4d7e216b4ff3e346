"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from decilog.llm import byte_bpe, chat, exact_dedup, html_extract, license_scan, line_crf, ngram_join, packing, toxicity, url_filter  # noqa: E402

RNG = random.Random(11)
WORDS = "river bank bird depth map course night old new stone field road".split()
LONG = "\n".join(" ".join(RNG.choice(WORDS) + str(RNG.randint(1, 9999)) for _ in range(20)) + "." for _ in range(5000))  # about 800 KB
ROWS = [
    (1, LONG), (2, LONG), (3, LONG + " more"), (4, None), (5, ""), (None, "lone words without an id"), (None, None), (6, "tie one"), (7, "tie  one"), (7, "tie  one"), (8, "x" * 300_000),
    (9, "\n" * 50), (10, " ".join(f"w{k}" for k in range(40))), (11, " ".join(f"w{k}" for k in range(41))),
]
#: Columns whose names operators use inside.
CLASH = ["n", "id", "comp", "token", "place", "bucket", "score", "kept", "row", "best"]
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, None, None), (None, 0, 1), (5, 0, 0), (6, 0, 1), (10, 1, 0), (10, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


OPERATORS = {
    "op2": lambda d, y: ngram_join.jaccard_components(d, 4, 85),
    "op3": lambda d, y: exact_dedup.dedup_groups(d, 3),
    "op7": toxicity.score_documents,
    "op8": line_crf.judge_documents,
    "op10": lambda d, y: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert len(got) == len(ROWS) and sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in ROWS), key=str)
    assert OPERATORS[name](empty(docs), empty(labels)).collect() == []


def test_duplicates_of_long_and_empty_texts(docs):
    near = {r.doc_id: r for r in ngram_join.jaccard_components(docs, 4, 85).collect() if r.doc_id is not None}
    assert [near[k].component_id for k in (1, 2, 3, 10, 11)] == [1, 1, 1, 10, 10] and near[4].n_shingles == near[5].n_shingles == 0 and near[9].component_id == 9
    same = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_groups(docs, 3).collect()]
    assert (1, 1, 2, True) in same and (2, 1, 2, False) in same and (5, 9, 4, False) in same and (9, 9, 4, True) in same and (6, 7, 3, False) in same


def test_packing(docs):
    got = packing.pack_documents(docs, JSON, public_tokenizers.PATTERN, size=256).collect()
    ends = sum(1 for r in got if r.piece == 0)
    assert ends == len(ROWS) and all(0 < r.length <= 256 for r in got) and packing.pack_documents(empty(docs), JSON, public_tokenizers.PATTERN).collect() == []


def test_pages_and_urls(spark):
    page = "<article><h1>Survey</h1><p>" + "The river was followed for nine days and nights by all. " * 20_000 + "</p></article>"
    rows = [(1, "http://a.net/x", page), (1, "http://a.net/x", page), (None, None, None), (2, "", ""), (3, "http://b.org/" + "y/" * 5000, "<p>"), (4, "::" * 10, "plain")]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, text string, host string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and max(r.n_chars for r in got) > 1_000_000 and all(r.n_chars == len(r.text) for r in got)
    urls = url_filter.judge(pages, url_filter.listed_labels(pages)).collect()
    assert len(urls) == len(rows) and all(r.verdict in ("allow", "block") for r in urls)
    assert html_extract.extract(empty(pages)).collect() == []


def test_licences(spark, docs):
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), "text", *CLASH)
    got = license_scan.scan(files).collect()
    assert len(got) == len(ROWS) and all(r.license is None for r in got)


def test_chats(spark):
    rows = [(1, k, "user", "t" * 1000 + str(k)) for k in range(500)] + [(1, None, None, None), (2, 0, "user", "t" * 1000 + "0"), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "conv_id long, turn long, role string, text string, chat string")
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.format_chats(df).collect()}
    assert got == {1: (501, 1), 2: (1, 1)} or got == {1: (501, 1), 2: (1, 1), None: (1, 2)}


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages(spark, docs, tmp_path, monkeypatch, name, step):
    """Each stage on rows with and without ids, and on nothing; labels of both classes are there."""
    found = {"labels": [(k, k % 2, int(k % 3 == 0)) for k in range(1, 12)]}
    spark.createDataFrame(found["labels"], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part, size in ((docs, len(ROWS)), (empty(docs), 0)):
        got = step(spark, part, str(tmp_path))
        rows = got.collect()
        if name != "best_fit_packing":
            assert got.columns == docs.columns and len(rows) <= size
        if name == "exact_dedup":
            assert sorted(str(r.doc_id) for r in rows) == (sorted(["1", "3", "9", "None", "7", "8", "10", "11"]) if size else [])
        if name == "ngram_jaccard":
            assert len(rows) == (sum(1 for _, t in ROWS if not (t or "").split()) + 5 if size else 0)
