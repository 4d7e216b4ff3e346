"""Queries that run as streams over the events, with the batch result as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.operators import blend as B
from decilog.operators import knn as K
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.plans.vectors import BLEND, d5, nb_sql
from decilog.session import table
from decilog.sources.io import work_dir
from decilog.streaming import stream as T


def arriving(spark, d):
    """The observations as a stream, and a last marker row that lets every window close."""
    path = work_dir(spark, "arriving")
    rows = role(spark, d, "obs").select("obs_id", "cluster_key", "user_id", "action", "value", F.col("ts").cast("timestamp").alias("ts"), "sparse")
    rows.write.parquet(f"{path}/1")
    last = rows.limit(1).withColumns({"ts": F.to_timestamp(F.lit("2030-01-01 00:00:00")), "action": F.lit("end"), "user_id": F.lit(-1).cast("long"), "obs_id": F.lit(-1).cast("long")})
    last.write.parquet(f"{path}/2")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


@query(with_roles("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, action, count(*) AS n, count(*) FILTER (WHERE sparse) AS sparse, round(count(*) FILTER (WHERE sparse) / CAST(count(*) AS DOUBLE), 5) AS rate FROM obs GROUP BY 1, 2"))
def t01_windowed_rates(spark, d):
    got = T.run_to_table(T.windowed_rates(arriving(spark, d), "1 day", delay="40 days"), "rates").where("action <> 'end'")
    return got.select(F.col("start").cast("date").cast("string").alias("day"), "action", "n", "sparse", d5("rate"))


@query(with_roles("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, obs_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM obs), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, obs_id) AS k FROM g)
SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean FROM s GROUP BY user_id, k"""))
def t02_session_metrics(spark, d):
    got = T.run_to_table(T.session_metrics(arriving(spark, d), "12 hours", delay="40 days"), "sessions").where("user_id >= 0")
    return got.select("user_id", "n", F.round("mean", 9).alias("mean"))


@query(with_roles("SELECT action, count(*) AS n FROM obs GROUP BY action"))
def t03_append_once(spark, d):
    """Every row sent twice; the second is dropped."""
    s = arriving(spark, d)
    twice = s.unionByName(s)
    got = T.run_to_table(T.without_repeats(twice, ["obs_id"], "40 days"), "once").where("obs_id >= 0")
    return got.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles(f"WITH {BLEND} SELECT query, action, round(prob, 5) AS prob FROM bl"))
def t04_score_stream(spark, d):
    """Vectors arrive and are blended against the corpus batch by batch."""
    corpus = role(spark, d, "corpus")
    path = work_dir(spark, "vectors")
    table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") % 2).alias("part")).repartition(3, "vec_id").write.parquet(path)
    s = spark.readStream.schema("id long, vec array<float>, part int").option("maxFilesPerTrigger", 1).parquet(path)
    live = corpus.where("active")
    return T.score_stream(s, lambda b: B.blend(K.knn(b, live, ["part"], 10), corpus), "scored").select("query", "action", d5("prob"))


VERSIONED = nb_sql("c.added_at <= CASE WHEN q.id % 2 = 0 THEN 250 ELSE 10000000 END AND (c.removed_at = 0 OR c.removed_at > CASE WHEN q.id % 2 = 0 THEN 250 ELSE 10000000 END)")


@query(with_roles(f"""WITH nb AS ({VERSIONED}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action)
SELECT query, action, round(w / sum(w) OVER (PARTITION BY query), 5) AS prob, query % 2 AS version FROM v WHERE w > 0"""))
def t04_versioned_scores(spark, d):
    """Even rows arrive while version 0 is the newest, odd ones after version 1 was made."""
    source, versions, at, path, state = (work_dir(spark, n) for n in ("asked", "versions", "corpus", "versioned", "versioned-log"))
    corpus = role(spark, d, "corpus")
    corpus.write.parquet(at)
    for number, cutoff in ((0, 250), (1, 10_000_000)):
        spark.createDataFrame([(number, cutoff)], "version long, cutoff_ts long").write.mode("append").parquet(versions)
        corpus.where(F.col("id") % 2 == number).select("id", "vec", "part").write.parquet(f"{source}/{number}")
        s = spark.readStream.schema(corpus.select("id", "vec", "part").schema).option("recursiveFileLookup", "true").parquet(source)
        got = T.score_versioned(s, versions, at, lambda b, then: B.blend(K.knn(b, then, ["part"], 10), then), path, state)
    return got.select("query", "action", d5("prob"), "version")


@query(with_roles("SELECT cluster_key, max(obs_id) AS obs_id, arg_max(action, obs_id) AS action FROM obs GROUP BY cluster_key"))
def t05_maintain_state(spark, d):
    """The state table itself; the stream is stopped and started again half way."""
    source, path, state = (work_dir(spark, n) for n in ("states", "state", "state-log"))
    rows = role(spark, d, "obs").select("cluster_key", "obs_id", "action")
    for half in (0, 1):
        rows.where(F.col("obs_id") % 2 == half).repartition(2, "obs_id").write.parquet(f"{source}/{half}")
        s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        got = T.maintain_state(s, path, state, ["cluster_key"], "obs_id")
    return got


CHUNK = "CAST(floor((obs_id * 7919) % 100003 * 4 / 100003) AS INTEGER)"


@query(with_roles(f"""WITH c AS (SELECT source, ts, {CHUNK} AS chunk FROM obs), t AS (SELECT source, chunk, max(ts) AS top FROM c GROUP BY source, chunk), n AS (SELECT c.*, (SELECT max(top) FROM t WHERE t.source = c.source AND t.chunk < c.chunk) AS newest FROM c)
SELECT source, coalesce(ts < newest - INTERVAL 5 DAY, FALSE) AS late, count(*) AS n FROM n GROUP BY 1, 2"""))
def t06_quarantine_late(spark, d):
    """Rows arrive in four lots; the stream is started anew for each."""
    source, path, state = (work_dir(spark, n) for n in ("lots", "late", "late-log"))
    rows = role(spark, d, "obs").select("obs_id", "source", F.col("ts").cast("timestamp").alias("ts")).withColumn("chunk", F.expr(CHUNK))
    for k in range(4):
        rows.where(F.col("chunk") == k).drop("chunk").coalesce(1).write.parquet(f"{source}/{k}")
        s = spark.readStream.schema("obs_id long, source string, ts timestamp").option("recursiveFileLookup", "true").parquet(source)
        kept, late = T.quarantine_late(s, path, state, "ts", "source", "5 DAYS")
    both = kept.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("source", "late").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("""WITH m AS (SELECT *, max(ts) OVER (PARTITION BY source ORDER BY (obs_id * 7919) % 100003, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM obs) SELECT source, coalesce(ts < top - INTERVAL 5 DAY, FALSE) AS late, count(*) AS n FROM m GROUP BY 1, 2"""))
def t06_split_late(spark, d):
    o = role(spark, d, "obs").withColumn("arrival", F.struct(((F.col("obs_id") * 7919) % 100003).alias("a"), "obs_id"))
    return T.split_late(o, "ts", "arrival", "5 DAYS").groupBy("source", "late").agg(F.count(F.lit(1)).alias("n"))
