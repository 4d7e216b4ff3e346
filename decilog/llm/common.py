"""Shared helpers of the text operators: shared-folder tables and column checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) takes a temporary folder; a cluster has
    none to share, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def write_shared(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` written to a new folder below the shared one and read back, with that folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`write_shared` made, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables of one job in the shared folder, deleted together once nothing reads them.

    A table cuts lineage: a lost executor costs a reread, not the work before it.
    An operator that returns a lazy frame leaves the tables behind it to the Scratch it was
    given; whoever gave it clears it when the frame has been written.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def stage(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.tables.append(write_shared(df, name, codec))
        return self.tables[-1][0]

    def drop(self, df: DataFrame) -> None:
        """Delete one of the tables before the others."""
        for own in [t for t in self.tables if t[0] is df]:
            self.tables.remove(own)
            delete_shared(df.sparkSession, own[1])

    def clear(self) -> None:
        while self.tables:
            df, path = self.tables.pop()
            delete_shared(df.sparkSession, path)


#: The internal key of a stage's rows: ids may be null or repeat.
ROW = "_row_key"


def keyed_rows(df: DataFrame, name: str, left: Scratch) -> DataFrame:
    """``df`` with a key of its own for each row, written so that every plan reads the same keys."""
    return left.stage(df.withColumn(ROW, F.monotonically_increasing_id()), name, "zstd")  # whole texts, read twice


def with_verdict(docs: DataFrame, verdicts: Callable[[pa.Array], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``verdicts`` keeps, with all their columns, in one pass.

    Each row is judged by its own text, so null and repeated ids do no harm.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(ROW, T.BooleanType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts(batch.column(at)), pa.bool_())], [*batch.schema.names, ROW])

    return docs.mapInArrow(run, schema).where(ROW).select(*[F.col(f"`{c}`") for c in docs.columns])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], usable: Column | None = None, max_chars: int = 50_000_000) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of a bounded sample, by id: at most ``most[y]`` ids of each label y, and ``max_chars`` characters.

    Ids come in order of a hash, so the sample does not depend on the partitioning. An id
    with several labels is not used. Of rows that repeat an id the shortest text counts, then
    the first in order: one text an id, however many rows there are. Once the texts so far
    exceed ``max_chars``, the rest is not used.
    """
    known = need(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(*most))
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").drop("_y")
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    wanted = F.broadcast(reduce(DataFrame.unionByName, first))  # bounded by ``most``
    found = need(docs, "doc_id", "text").where("text IS NOT NULL").join(wanted, "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("s"))
    so_far = F.sum("s.n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = found.withColumn("_n", so_far).where(F.col("_n") <= max_chars)
    return sorted((r.doc_id, r.text, r.y) for r in kept.select("doc_id", "s.text", "y").collect())


def if_small(table: DataFrame, most: int) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``most`` rows; else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``df``, so that extra or clashing names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
