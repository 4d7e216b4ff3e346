"""Readers, writers and checks of the tables at rest."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a local session takes a temporary folder; a cluster has none to share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-work-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines under a fixed schema; ``bad`` marks lines that do not parse. Blank lines are skipped; partition columns stay."""
    lines = spark.read.text(path).where(F.trim("value") != "")  # with the columns of the folders' names
    fields = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    kept = [c for c in lines.columns if c != "value"]
    got = lines.select(*kept, F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return got.select("r.*", *kept).withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def align_schema(df: DataFrame, required: list[str], defaults: dict[str, Column]) -> DataFrame:
    """``df`` with defaults for missing or null optional columns; a missing required column is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def split_misses(df: DataFrame, table: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the lookup table has, with the value, and those that it lacks."""
    both = df.join(table.select(*keys, value), keys, "left")
    return both.where(F.col(value).isNotNull()), both.where(F.col(value).isNull()).drop(value)


def union_tables(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Tables as one; a key found twice is an error when the rows are read."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return whole.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("key twice:"), *[F.col(k).cast("string") for k in key]))).otherwise(F.lit("ok"))).where("_ok = 'ok'").drop("_n", "_ok")


def validate_matrix(df: DataFrame, classes: DataFrame, a: str, b: str, v: str, tolerance: float = 1e-9) -> DataFrame:
    """What is wrong with a matrix: entries that are missing, off the complement, or outside [0, 1]."""
    name = classes.columns[0]
    want = classes.select(F.col(name).alias(a)).crossJoin(classes.select(F.col(name).alias(b)))
    absent = want.join(df, [a, b], "left_anti").select(a, b, F.lit("missing").alias("error"))
    outside = df.where(~F.col(v).between(0, 1)).select(a, b, F.lit("outside").alias("error"))
    other = df.select(F.col(b).alias(a), F.col(a).alias(b), F.col(v).alias("_w"))
    off = df.join(other, [a, b]).where((F.col(a) < F.col(b)) & (F.abs(F.col(v) + F.col("_w") - 1) > tolerance)).select(a, b, F.lit("complement").alias("error"))
    return absent.unionByName(outside).unionByName(off)


def with_timestamps(df: DataFrame, times: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``df`` with the time of its key; text that is no time gives null."""
    return df.join(times.select(key, F.try_to_timestamp(F.col(text), F.lit(pattern)).alias("ts")), key, "left")


def parse_hand_text(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Event rows of hand texts: id, line, street, seat, action, amount, to_amount.

    A line ``*** NAME ***`` opens a street; ``seat: verb [amount] [to amount]`` is an
    event. Other lines are left out.
    """
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line", "s"))
    opened = F.lower(F.regexp_extract("s", r"^\*\*\* ([A-Z]+) \*\*\*", 1))
    w = Window.partitionBy("id").orderBy("line")
    street = F.last(F.when(opened != "", opened), ignorenulls=True).over(w)
    parsed = lines.withColumns(
        {
            "street": F.coalesce(street, F.lit("preflop")),
            "seat": F.regexp_extract("s", r"^(\w+): (folds|checks|calls|bets|raises)\b", 1), "action": F.regexp_extract("s", r"^(\w+): (folds|checks|calls|bets|raises)\b", 2),
            "amount": F.regexp_extract("s", r"\$([0-9.]+)", 1).try_cast("double"), "to_amount": F.regexp_extract("s", r"to \$([0-9.]+)", 1).try_cast("double"),
        }
    )
    return parsed.where("seat <> ''").select("id", "line", "street", "seat", F.regexp_replace("action", "s$", "").alias("action"), "amount", "to_amount")


def write_partitioned(df: DataFrame, path: str, by: str, max_records: int = 1_000_000) -> None:
    """Compressed Parquet, one folder per value of ``by``; appends."""
    df.write.mode("append").partitionBy(by).option("maxRecordsPerFile", max_records).option("compression", "zstd").parquet(path)


def write_manifest(fit: DataFrame, path: str, version: int) -> None:
    """A z-score fit as a one-row table with its version."""
    from decilog.operators.stats import manifest

    manifest(fit).withColumn("version", F.lit(version)).write.parquet(path)


def load_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The fit; another version is an error when it is read."""
    df = spark.read.parquet(path)
    ok = F.when(F.col("version") == version, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("manifest version "), F.col("version").cast("string"))))
    return df.where(ok)


def sample_decisions(df: DataFrame, where: Column, drop: list[str], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows without the named columns, in a stated order."""
    return df.where(where).drop(*drop).orderBy(*order).offset(offset).limit(limit)


def watermark(df: DataFrame, ts: str) -> DataFrame:
    """The newest time. One row."""
    return df.agg(F.max(ts).alias("watermark"))


def suite_record(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row frames as one nested record."""
    whole = None
    for name, df in parts.items():
        one = df.select(F.struct(*df.columns).alias(name))
        whole = one if whole is None else whole.crossJoin(one)
    return whole
