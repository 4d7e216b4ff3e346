"""Queries that read and write: JSON lines, partitioned tables, schema and key checks, hand texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from decilog.operators import metrics as M
from decilog.operators import stats as S
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.plans.stats import r4
from decilog.session import table
from decilog.sources import io


@query(with_roles("""SELECT event_type, sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad, count(*) AS n, sum(CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END)::BIGINT AS k FROM events GROUP BY event_type"""))
def s02_read_json_lines(spark, d):
    """The events' payloads as JSON lines, one in fifty cut short."""
    e = table(spark, d, "events")
    body = F.concat(F.lit('{"id":'), "event_id", F.lit(',"payload":'), "props", F.lit("}"))
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"id":'), "event_id", F.lit(',"payl'))).otherwise(body)
    path = io.work_dir(spark, "lines")
    e.select(line.alias("value"), "event_type").write.partitionBy("event_type").text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("payload", T.StructType([T.StructField("k", T.LongType())]))])
    made = io.read_json_lines(spark, path, schema)
    return made.groupBy("event_type").agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("bad"), F.col("payload.k"))).alias("k"))


@query("SELECT vec_id, label, label % 2 AS street_class FROM embeddings WHERE label % 2 = 1")
def s03_read_partition(spark, d):
    """Written by class, then only the wanted class is read."""
    path = io.work_dir(spark, "vectors")
    io.write_partitioned(table(spark, d, "embeddings").withColumn("street_class", F.col("label") % 2), path, "street_class")
    return spark.read.parquet(path).where("street_class = 1").select("vec_id", "label", "street_class")


@query("SELECT p_partkey, coalesce(p_size, 0) AS p_size, 'none' AS origin, 2 AS spec FROM part")
def s04_align_schema(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return io.align_schema(p, ["p_partkey"], {"p_size": F.lit(0), "origin": F.lit("none"), "spec": F.lit(2)})


@query(with_roles("SELECT k, prefix, round(v, 4) AS v FROM lookup"))
def s06_union_tables(spark, d):
    t = role(spark, d, "lookup").select("k", "prefix", "v")
    return io.union_tables([t.where("v < 1000"), t.where("v >= 1000")], ["k"]).select("k", "prefix", *r4("v"))


M6 = "SELECT x.actor AS a, y.actor AS b, CASE WHEN x.actor = y.actor THEN 0.5 WHEN x.actor = 'BB' AND y.actor = 'SB' THEN 1.4 ELSE x.n / CAST(x.n + y.n AS DOUBLE) END AS v FROM (SELECT actor, count(*) AS n FROM moves GROUP BY actor) x CROSS JOIN (SELECT actor, count(*) AS n FROM moves GROUP BY actor) y WHERE NOT (x.actor = 'CO' AND y.actor = 'MP')"


@query(with_roles(f"""WITH m AS ({M6}), k AS (SELECT DISTINCT actor FROM moves) SELECT x.actor AS a, y.actor AS b, 'missing' AS error FROM k x CROSS JOIN k y WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a = x.actor AND m.b = y.actor)
UNION ALL SELECT a, b, 'outside' FROM m WHERE v NOT BETWEEN 0 AND 1 UNION ALL SELECT m.a, m.b, 'complement' FROM m JOIN m o ON o.a = m.b AND o.b = m.a WHERE m.a < m.b AND abs(m.v + o.v - 1) > 1e-9"""))
def s07_validate_matrix(spark, d):
    moves = role(spark, d, "moves")
    m = spark.sql(M6.replace("FROM moves", "FROM {moves}"), moves=moves)
    return io.validate_matrix(m, moves.select("actor").distinct(), "a", "b", "v")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 3 THEN 2020 + c_nationkey % 4 END AS y FROM customer")
def s08_timestamps(spark, d):
    c = table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 10 == 3, "no time").otherwise(F.concat((2020 + F.col("c_nationkey") % 4).cast("string"), F.lit("-03-04 05:06:07")))
    got = io.with_timestamps(c.select("c_custkey"), c.select("c_custkey", text.alias("t")), "c_custkey", "t", "yyyy-MM-dd HH:mm:ss")
    return got.select("c_custkey", F.year("ts").alias("y"))


@query(with_roles("SELECT street, actor AS seat, action, count(*) AS n, CAST(sum(CASE WHEN action IN ('call', 'bet', 'raise') THEN amount END) AS DOUBLE) AS amount, CAST(sum(CASE WHEN action = 'raise' THEN amount + 1 END) AS DOUBLE) AS to_amount FROM moves GROUP BY street, actor, action"))
def s09_parse_hand_text(spark, d):
    """The moves written as text, a street's head before its first event, and parsed again."""
    tail = F.when(F.col("action").isin("fold", "check"), "").when(F.col("action") == "raise", F.concat(F.lit(" $"), "amount", F.lit(" to $"), F.col("amount") + 1)).otherwise(F.concat(F.lit(" $"), "amount"))
    event = F.concat("actor", F.lit(": "), "action", F.lit("s"), tail)
    line = F.concat(F.lit("*** "), F.upper("street"), F.lit(" ***\n"), event)
    rows = role(spark, d, "moves").groupBy("hand_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("s")))).alias("x"))
    texts = rows.select("hand_id", F.concat(F.lit("Table one\n"), F.array_join(F.col("x.s"), "\n")).alias("text"))
    got = io.parse_hand_text(texts, "hand_id", "text")
    return got.groupBy("street", "seat", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sum("to_amount").alias("to_amount"))


@query(with_roles("SELECT hit, count(*) AS n FROM (SELECT p_partkey, concat(p_brand, '|', p_type, '|', CAST(p_size AS VARCHAR(9))) IN (SELECT k FROM lookup) AS hit FROM part) GROUP BY hit"))
def s11_split_misses(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", "p_size").alias("k"))
    hits, misses = io.split_misses(p, role(spark, d, "lookup"), ["k"], "v")
    return hits.select(F.lit(True).alias("hit")).unionByName(misses.select(F.lit(False).alias("hit"))).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 64::BIGINT AS dims, 3 AS version, round((SELECT avg(CAST(embedding[1] AS DOUBLE)) FROM embeddings), 5) AS first_mean")
def s12_manifest(spark, d):
    path = io.work_dir(spark, "manifest")
    io.write_manifest(S.fit_zscore(table(spark, d, "embeddings"), "embedding"), path, 3)
    return io.load_manifest(spark, path, 3).select(F.size("means").cast("long").alias("dims"), "version", F.round(F.col("means")[0], 5).alias("first_mean"))


@query(with_roles("SELECT session_id, count(*) AS n FROM obs WHERE session_id >= '2024-01-20' GROUP BY session_id"))
def s16_append_observations(spark, d):
    """Two appends by day, then a read of some days."""
    path = io.work_dir(spark, "observations")
    o = role(spark, d, "obs").select("obs_id", "action", "value", "session_id")
    for part in (0, 1):
        io.write_partitioned(o.where(F.col("obs_id") % 2 == part), path, "session_id")
    back = spark.read.schema("obs_id long, action string, value double, session_id string").parquet(path)
    return back.where("session_id >= '2024-01-20'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT id, part, action FROM corpus WHERE active AND part = 1 ORDER BY id LIMIT 50 OFFSET 10"))
def s18_sample_decisions(spark, d):
    c = role(spark, d, "corpus").select("id", "part", "action", "active", "vec")
    return io.sample_decisions(c, F.col("active") & (F.col("part") == 1), ["vec", "active"], ["id"], 50, 10)


@query(with_roles("SELECT source, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS day FROM obs GROUP BY source"))
def s19_watermark(spark, d):
    o = role(spark, d, "obs")
    made = [io.watermark(o.where(F.col("source") == s), "ts").select(F.lit(s).alias("source"), F.col("watermark").cast("date").cast("string").alias("day")) for s in ("hh", "sim")]
    return made[0].unionByName(made[1])


@query(with_roles("SELECT (SELECT count(*) FROM payoffs WHERE status = 'completed') AS completed, (SELECT count(DISTINCT cluster_key) FROM solves) AS solved"))
def s20_suite_record(spark, d):
    done = role(spark, d, "payoffs").where("status = 'completed'").agg(F.count(F.lit(1)).alias("completed"))
    gap = M.exploitability(role(spark, d, "solves"), role(spark, d, "obs"))
    return io.suite_record({"matches": done, "exploitability": gap}).select("matches.completed", "exploitability.solved")


@query("SELECT a.p_type AS item, count(*) AS n FROM part a WHERE a.p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) GROUP BY a.p_type")
def s05_palette_scan(spark, d):
    """Palettes as files named by brand; only those that are there are read, named by their path."""
    path = io.work_dir(spark, "palettes")
    p = table(spark, d, "part")
    p.join(p.where("p_size > 48").select("p_brand").distinct(), "p_brand", "left_semi").select("p_brand", "p_type").write.partitionBy("p_brand").json(path)
    rows = spark.read.schema("p_type string").json(path).withColumn("brand", F.regexp_extract("_metadata.file_path", r"p_brand=([^/]+)/", 1))
    return rows.where("brand <> ''").groupBy(F.col("p_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
