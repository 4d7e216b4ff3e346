"""Null and repeated ids in every stage that keeps or drops documents."""

import random

from decilog.llm import exact_dedup, line_crf, ngram_join, toxicity

DOCS = "doc_id long, text string, tag string"


def tags(df):
    return sorted(r.tag for r in df.collect())


def test_exact_copies(spark):
    rows = [(1, "one two", "a"), (None, "one  two ", "b"), (None, "onetwo", "c"), (None, "alone", "d"), (None, "al one", "e"), (None, "al one", "f"), (2, "onetwo", "g"), (2, "other", "h"), (3, "twin", "i"), (3, "twin", "j"), (None, None, "k")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = tags(exact_dedup.keep_unique(df))
    assert len(got) == 5 and {"a", "h", "k"} <= set(got) and len({"e", "f"} & set(got)) == 1 and len({"i", "j"} & set(got)) == 1
    groups = exact_dedup.dedup_groups(df).collect()
    assert len(groups) == len(rows) and {r.keep_id for r in groups if r.doc_id == 1} == {1} and all(r.kept is not None for r in groups)


def test_near_copies(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "a"), (None, text + " more", "b"), (None, "something else that stays in the table here", "c"), (None, None, "d"), (5, "a text that repeats the id of another one", "e"), (4, "x " + text, "f")]
    assert tags(ngram_join.keep_one(spark.createDataFrame(rows, DOCS))) == ["c", "d", "e", "f"]


def test_toxic_rows(spark):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice("river bank bird depth map course night old new".split()) for _ in range(40))
    rows = [(k, plain() + (" moron idiot" if k % 3 == 0 else ""), "old") for k in range(300)]
    new = [(None, plain() + " moron idiot", "bad"), (None, plain(), "good"), (900, plain() + " idiot moron", "bad"), (900, plain(), "good")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = tags(toxicity.drop_toxic(spark.createDataFrame(rows + new, DOCS), labels))
    assert got.count("good") == 2 and "bad" not in got


def test_bad_rows(spark):
    rng = random.Random(5)
    good = lambda: "\n".join(" ".join(rng.choice("river bank bird depth map course night old new".split()) + str(rng.randint(1, 999)) for _ in range(14)) + "." for _ in range(6))
    bad = lambda: " | ".join(str(rng.randint(1, 10**6)) for _ in range(60))
    rows = [(k, good() if k % 2 else bad(), "old") for k in range(80)]
    new = [(None, bad(), "bad"), (None, good(), "good"), (900, bad(), "bad"), (900, good(), "good")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    got = tags(line_crf.keep_good(spark.createDataFrame(rows + new, DOCS), labels))
    assert got.count("good") == 2 and "bad" not in got
