"""Structured Streaming twins of the session metrics and state tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decilog.functions.predicates import as_of
from decilog.operators import corpus as K
from decilog.sources.io import work_dir


def windowed_rates(stream: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows, sparse rows and their rate per time window and action."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = stream.withWatermark("ts", delay).groupBy(window.alias("w"), "action").agg(F.count(F.lit(1)).alias("n"), F.count_if("sparse").alias("sparse"))
    return got.select(F.col("w.start").alias("start"), "action", "n", "sparse", (F.col("sparse") / F.col("n")).alias("rate"))


def session_metrics(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Rows and mean value per user and session; a session ends after ``gap`` without a row."""
    got = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return got.select("user_id", F.col("w.start").alias("start"), "n", "mean")


def without_repeats(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, state: str | None = None) -> DataFrame:
    """Run over all that the source has now, into Parquet; read back.

    With the same ``path`` and ``state`` (the checkpoint) a later run goes on where this
    one ended; without them both are new folders below the shared one.
    """
    spark = stream.sparkSession
    path, state = path or work_dir(spark, name), state or work_dir(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that no manifest names any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What a manifest says: the version of each bucket that counts.
MANIFEST = "_bucket int, _version long, version long"
#: Manifests that stay: the newest, and the one that a reader, or a batch that is run again, may still need.
KEPT = 2


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifests of a state table that are still there: at most ``KEPT`` + 1 times its buckets rows."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def state_table(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of a state table as its newest manifest names them, or the newest under ``before``."""
    full = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_version", T.LongType())])
    rows = manifests(spark, path)
    found = (rows if before is None else rows.where(F.col("version") < before)).collect()  # a few times the buckets
    newest = max((r.version for r in found), default=None)
    folders = [f"{path}/rows/_bucket={r._bucket}/_version={r._version}" for r in found if r.version == newest]
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/rows").parquet(*folders)


def maintain_state(stream: DataFrame, path: str, state: str, keys: list[str], order: str, buckets: int = 32) -> DataFrame:
    """A table below ``path`` of the newest row per key by ``order``, kept up by every micro-batch.

    Rows lie in ``buckets`` by a hash of the key. A batch rewrites the buckets of its own
    keys alone, as a version with the batch's number, from the manifest before it, and then
    writes the manifest that names the version of each bucket. So a batch that is run again
    after a failure writes the same, a reader sees whole batches, and with the same ``path``
    and ``state`` (the checkpoint) a restarted stream goes on where the last one ended.
    Versions that the last ``KEPT`` manifests do not name are deleted: there are never more
    than that many times ``buckets`` folders, however many batches there were.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = {r._bucket for r in new.select("_bucket").distinct().collect()}  # at most ``buckets``
        known = manifests(session, path).where(F.col("version") < number).collect()
        last = max((r.version for r in known), default=None)
        named = {r._bucket: r._version for r in known if r.version == last}
        old = state_table(session, path, schema, number).where(F.col("_bucket").isin(*touched) if touched else F.lit(False)).drop("_version").select(*new.columns)
        merged = K.upsert_latest(old.limit(0), old.unionByName(new), keys, order).withColumn("_version", F.lit(number).cast("long"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(f"{path}/rows")
        now = named | dict.fromkeys(touched, number)
        session.createDataFrame([(b, v) for b, v in sorted(now.items())], "_bucket int, _version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
        versions = sorted({r.version for r in known} | {number})
        gone = versions[:-KEPT]
        live = {(r._bucket, r._version) for r in known if r.version not in gone} | set(now.items())
        dead = {(r._bucket, r._version) for r in known if r.version in gone} - live
        delete(session, [f"{path}/manifest/version={v}" for v in gone] + [f"{path}/rows/_bucket={b}/_version={v}" for b, v in dead])

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return state_table(spark, path, schema).select(*schema.fieldNames())


def split_late(rows: DataFrame, ts: str, arrival: str, delay: str, by: str = "source") -> DataFrame:
    """Rows marked ``late`` if their time is over ``delay`` before the newest time of their ``by`` that arrived earlier.

    ``arrival`` orders the rows as they came; the batch form of what a watermark drops.
    """
    from pyspark.sql import Window

    day = Window.partitionBy(by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(ts).over(day)
    return rows.withColumn("late", F.coalesce(F.col(ts) < newest - F.expr(f"INTERVAL {delay}"), F.lit(False)))


def quarantine_late(stream: DataFrame, path: str, state: str, ts: str, by: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(kept, late) rows: late if over ``delay`` before the newest time of their ``by`` in earlier micro-batches.

    Both are appended below ``path``, by batch number, next to the newest times so far (a row
    for each ``by``; those of the last ``KEPT`` batches stay): a batch that is run again writes
    the same, and a restarted stream with the same ``path`` and ``state`` knows the newest
    times of the runs before it.
    """
    spark, schema = stream.sparkSession, stream.schema
    seen = T.StructType([T.StructField(by, schema[by].dataType), T.StructField("newest", schema[ts].dataType), T.StructField("batch", T.LongType())])

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(seen).parquet(f"{path}/newest") if exists(session, f"{path}/newest") else session.createDataFrame([], seen)
        numbers = sorted(r.batch for r in before.select("batch").distinct().collect())  # at most KEPT + 1
        newest = before.where(F.col("batch") == max((n for n in numbers if n < number), default=-1)).select(by, F.col("newest").alias("_newest"))
        marked = batch.join(F.broadcast(newest), by, "left").withColumn("_late", F.coalesce(F.col(ts) < F.col("_newest") - F.expr(f"INTERVAL {delay}"), F.lit(False)))
        for name, rows in (("kept", marked.where(~F.col("_late"))), ("late", marked.where("_late"))):
            rows.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        so_far = newest.withColumnRenamed("_newest", "newest").unionByName(batch.select(by, F.col(ts).alias("newest")))
        so_far.groupBy(by).agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        delete(session, [f"{path}/newest/batch={n}" for n in [*(n for n in numbers if n < number), number][:-KEPT]])

    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.schema(schema).parquet(f"{path}/{name}") for name in ("kept", "late"))


def score_stream(stream: DataFrame, score, name: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """Score arriving rows batch by batch with a batch operator; results are appended by batch number.

    ``path`` and ``state`` as in :func:`run_to_table`.
    """
    spark = stream.sparkSession
    path, state = path or work_dir(spark, name), state or work_dir(spark, f"{name}-state")

    def each(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("batch")


def score_versioned(stream: DataFrame, versions: str, corpus: str, score: Callable[[DataFrame, DataFrame], DataFrame], path: str, state: str) -> DataFrame:
    """Score arriving rows against the corpus version that is newest when their batch first runs; results with ``version``.

    versions: a Parquet folder with version and cutoff_ts, corpus: one with added_at and
    removed_at (0: never). A batch writes down its version before it scores: if it is run
    again it takes the same one, and sees the corpus as of the same cutoff, whatever has been
    added since. Results are appended by batch number. Without any version a batch is an error.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        pin = f"{path}/pinned/batch={number}"
        if not exists(session, pin):
            newest = session.read.parquet(versions).agg(F.max(F.struct("version", "cutoff_ts")).alias("v")).where("v IS NOT NULL").select("v.*")
            newest.coalesce(1).write.mode("overwrite").parquet(pin)
        found = session.read.parquet(pin).first()  # one row
        if found is None:
            raise ValueError("there is no corpus version to score against")
        then = session.read.parquet(corpus).where(as_of(F.col("added_at"), F.col("removed_at"), F.lit(found.cutoff_ts)))
        score(batch, then).withColumn("version", F.lit(found.version)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder (or one file) as a stream of its files."""
    return spark.readStream.schema(schema).parquet(path)
