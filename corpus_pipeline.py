"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
``documents``; the last packs what is left. ``run`` writes every stage's result to the
shared folder and rereads it as the next one's input.

A stage's result is a lazy frame. The tables behind it belong to the call: ``run`` hands each
call a ``Scratch`` and clears it once the result is written; a stage called without one leaves
them in the shared folder, so that its caller can chain stages, or hold two results of one
stage, before writing anything.

Every stage takes rows with null or repeated ids, null, empty and very long texts, empty
tables and extra columns; ids are not looked at except to choose which copy stays (the
smallest, null last), and columns that are not text or id pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from decilog.llm import exact_dedup, line_crf, ngram_join, packing, toxicity
from decilog.llm.common import Scratch
from decilog.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """Documents under the toxicity threshold; a row without text has no toxic windows and stays."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """Documents that pass the counts and whose lines are mostly content; a row without text has no words and goes."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """One document of each group with equal text: the longest, then that with the smallest id; rows without text are one group."""
    return exact_dedup.keep_unique(docs, left=left)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8): the smallest id; rows without text all stay."""
    return ngram_join.keep_one(docs, width=5, threshold=80, left=left)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece of a document; a row without text is its end token."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024, left=left)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Trained models and the packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """All stages over ``documents``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The tables behind the result, which the last stage makes lazily, go to ``left``; those of the stages before are deleted.
    """
    docs, before, left = table(spark, sf_dir, "documents"), Scratch(), left or Scratch()
    for name, step in STAGES[:-1]:
        own, after = Scratch(), Scratch()
        docs = after.stage(step(spark, docs, sf_dir, own), f"pipeline-{name}")
        own.clear()
        before.clear()
        before = after
    packed = STAGES[-1][1](spark, docs, sf_dir, left)
    left.tables += before.tables
    return packed
