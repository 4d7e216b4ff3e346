"""Queries of rankings, newest rows, feeds and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.operators import rank as R
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.sources.io import work_dir
from decilog.plans.stats import BYC, by_cluster, r4

BUCKET = "CASE WHEN CAST(substr(cluster_key, 2) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(with_roles(f"""WITH {BYC}, c AS (SELECT b.*, l.source, CASE WHEN CAST(substr(b.cluster_key, 2) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket, 0.05 / n AS s FROM byc b LEFT JOIN live l ON l.cluster_key = b.cluster_key WHERE n >= 20),
w AS (SELECT *, avg(mean) OVER (PARTITION BY bucket) AS mu, count(*) OVER (PARTITION BY bucket) AS k, greatest(0, CASE WHEN count(*) OVER (PARTITION BY bucket) < 2 THEN 0 ELSE var_samp(mean) OVER (PARTITION BY bucket) - avg(s) OVER (PARTITION BY bucket) END) AS tau2 FROM c),
p AS (SELECT *, CASE WHEN k < 2 THEN mean WHEN tau2 = 0 THEN mu ELSE (s * mu + tau2 * mean) / (s + tau2) END AS pm FROM w)
SELECT cluster_key, n, bucket, CASE WHEN source IN ('manual', 'solver') THEN 'B' ELSE 'A' END AS stage, round(pm, 5) AS post_mean, round(pm * ln(greatest(n, 2)), 5) AS score, tau2 = 0 OR s / (s + tau2) > 0.1 AS shrunk FROM p ORDER BY pm * ln(greatest(n, 2)) DESC, cluster_key LIMIT 20"""))
def ranked_clusters(spark, d):
    df = by_cluster(spark, d).withColumn("bucket", F.expr(BUCKET))
    got = R.rank_leaks(df)
    return got.select("cluster_key", "n", "bucket", "stage", F.round("post_mean", 5).alias("post_mean"), F.round("score", 5).alias("score"), "shrunk")


NODE = "SELECT cluster_key, arg_max(locked, created_at) AS locked, arg_max(source, created_at) AS source FROM nodes WHERE active GROUP BY cluster_key"


@query(with_roles(f"""WITH n AS ({NODE}), e AS (SELECT m.*, m.value * ln(greatest(m.n, 2)) AS score FROM metrics m LEFT JOIN n ON n.cluster_key = m.cluster_key
 WHERE m.value > 0.3 AND m.n >= 12 AND m.cluster_key NOT IN (SELECT cluster_key FROM suppressions WHERE active) AND NOT coalesce(n.locked OR n.source IN ('seed', 'building'), FALSE)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, cluster_key) AS rank FROM e)
SELECT session_id, cluster_key, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM r WHERE rank <= 5"""))
def w02_leak_candidates(spark, d):
    got = R.leak_candidates(role(spark, d, "metrics"), role(spark, d, "nodes"), role(spark, d, "suppressions"), min_obs=12, barred=("seed", "building"))
    return got.select("session_id", "cluster_key", "rank", F.round("score", 5).alias("score"))


@query(with_roles("SELECT obs_id, cluster_key, round(distance, 4) AS distance FROM obs WHERE sparse AND distance > 1.5 ORDER BY distance DESC NULLS LAST, obs_id LIMIT 50"))
def w03_coverage_gaps(spark, d):
    return R.coverage_gaps(role(spark, d, "obs"), floor=1.5).select("obs_id", "cluster_key", *r4("distance"))


@query(with_roles("SELECT cluster_key, obs_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY ts DESC, obs_id DESC) AS rank FROM obs) WHERE rank <= 10"))
def w04_latest_n(spark, d):
    return R.latest_n(role(spark, d, "obs"), ["cluster_key"], [F.desc("ts"), F.desc("obs_id")], 10).select("cluster_key", "obs_id", "rank")


@query(with_roles("SELECT cluster_key, solve_id, round(exploitability, 4) AS exploitability FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY solved_at DESC, solve_id DESC) AS r FROM solves) WHERE r = 1"))
def w05_latest(spark, d):
    return R.latest(role(spark, d, "solves"), ["cluster_key"], ["solved_at", "solve_id"]).select("cluster_key", "solve_id", *r4("exploitability"))


@query(with_roles("SELECT hand_id, round(bb_delta, 4) AS bb_delta FROM payoffs ORDER BY bb_delta DESC, hand_id LIMIT 25"))
def w06_top_k(spark, d):
    return R.top_k(role(spark, d, "payoffs"), [F.desc("bb_delta"), F.asc("hand_id")], 25).select("hand_id", *r4("bb_delta"))


@query(with_roles("""WITH m AS (SELECT cluster_key, arg_max(value, (ts, session_id)) AS loss FROM metrics GROUP BY cluster_key), o AS (SELECT *, count(*) OVER (PARTITION BY cluster_key) AS k FROM obs WHERE sparse AND cluster_key NOT IN (SELECT cluster_key FROM suppressions WHERE active))
SELECT obs_id, k AS in_cluster, round(k * coalesce(loss, 0) * coalesce(distance, 0), 4) AS priority FROM o LEFT JOIN m ON m.cluster_key = o.cluster_key ORDER BY CASE WHEN action = 'view' THEN 0 ELSE 1 END, distance DESC NULLS LAST, obs_id LIMIT 100"""))
def w07_solve_priority(spark, d):
    got = R.solve_priority(role(spark, d, "obs"), role(spark, d, "metrics"), role(spark, d, "suppressions").where("active"))
    return got.select("obs_id", "in_cluster", *r4("priority"))


@query(with_roles("""SELECT patch_id, cluster_key, arg_max(patch_id, (ts, patch_id)) OVER (PARTITION BY cluster_key ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS prev_patch FROM patches"""))
def w08_previous_patch(spark, d):
    return R.with_prev(role(spark, d, "patches")).select("patch_id", "cluster_key", "prev_patch")


@query(with_roles("SELECT hand_id || '_dp' || seq AS id, CAST(row_number() OVER (ORDER BY CAST(hand_id AS VARCHAR), seq) AS BIGINT) AS place FROM moves"))
def w09_natural_order(spark, d):
    ids = role(spark, d, "moves").select(F.concat("hand_id", F.lit("_dp"), "seq").alias("id"))
    return R.with_place(R.natural_order(ids, "id"), work_dir(spark, "ordered"))


@query(with_roles("""SELECT kind, ref, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, note FROM (SELECT 'patch' AS kind, patch_id AS ref, ts, source AS note FROM patches UNION ALL SELECT 'match', hand_id, ts, opponent FROM payoffs WHERE status = 'completed') ORDER BY ts DESC, kind, ref LIMIT 10"""))
def w11_activity(spark, d):
    got = R.activity(role(spark, d, "patches"), role(spark, d, "payoffs"))
    return got.select("kind", "ref", F.col("ts").cast("date").cast("string").alias("day"), "note")


@query(with_roles("SELECT hand_id, opponent, round(bb_delta, 4) AS bb_delta FROM payoffs WHERE status = 'completed' AND opponent = '1-URGENT' ORDER BY ts DESC, hand_id LIMIT 30"))
def w12_match_history(spark, d):
    df = role(spark, d, "payoffs").where("status = 'completed' AND opponent = '1-URGENT'")
    return R.top_k(df, [F.desc("ts"), F.asc("hand_id")], 30).select("hand_id", "opponent", *r4("bb_delta"))


@query(with_roles("""SELECT p.patch_id, p.cluster_key, p.status, n.source AS new_source, round(n.gto_score, 6) AS new_score, round(o.gto_score, 6) AS prev_score FROM patches p JOIN nodes n ON n.node_id = p.new_node_id LEFT JOIN nodes o ON o.node_id = p.prev_node_id"""))
def w13_patch_history(spark, d):
    got = R.patch_history(role(spark, d, "patches"), role(spark, d, "nodes"))
    return got.select("patch_id", "cluster_key", "status", "new_source", F.round("new_score", 6).alias("new_score"), F.round("prev_score", 6).alias("prev_score"))


@query(with_roles("SELECT cluster_key, row_number() OVER w AS place, patch_id, lag(patch_id) OVER w AS prev_patch FROM patches WINDOW w AS (PARTITION BY cluster_key ORDER BY ts, patch_id)"))
def w13_patch_chain(spark, d):
    return R.patch_chain(role(spark, d, "patches"))


@query(with_roles("""WITH i AS (SELECT hand_id, count(*) AS n_decisions FROM moves GROUP BY hand_id) SELECT i.hand_id, n_decisions, i.hand_id IN (SELECT hand_id FROM payoffs WHERE status = 'completed') AS has_ranges, i.hand_id IN (SELECT obs_id FROM obs WHERE sparse) AS has_obs
FROM i ORDER BY n_decisions DESC NULLS LAST, i.hand_id LIMIT 100 OFFSET 20"""))
def w14_browse_hands(spark, d):
    index = role(spark, d, "moves").groupBy("hand_id").agg(F.count(F.lit(1)).alias("n_decisions"))
    obs = role(spark, d, "obs").where("sparse").select(F.col("obs_id").alias("hand_id"))
    return R.browse_hands(index, role(spark, d, "payoffs").where("status = 'completed'"), obs, 100, 20)


@query(with_roles("""SELECT hand_id AS decision_id, max(actor) FILTER (WHERE seq = 0) AS oop, max(actor) FILTER (WHERE seq = 1) AS ip, max(amount) FILTER (WHERE seq = 0) AS oop_weight, max(amount) FILTER (WHERE seq = 1) AS ip_weight, max(seq) > 1 AS multiway FROM moves GROUP BY hand_id"""))
def w15_ranges_contract(spark, d):
    rows = role(spark, d, "moves").select(F.col("hand_id").alias("decision_id"), F.col("seq").alias("seat_no"), "actor", F.col("amount").alias("weight"))
    return R.ranges_contract(rows)


BLOCK = """SELECT hand_id, count(*) AS combos, count(*) FILTER (WHERE amount % 17 <> 0) AS weights, count(DISTINCT action) AS actions, count(*) * count(DISTINCT action) - CASE WHEN hand_id % 10 = 0 THEN 1 ELSE 0 END AS strategy FROM moves GROUP BY hand_id"""


@query(with_roles(f"""SELECT hand_id, concat_ws(',', CASE WHEN weights <> combos THEN 'weights' END, CASE WHEN strategy <> combos * actions THEN 'strategy' END) AS errors FROM ({BLOCK}) WHERE weights <> combos OR strategy <> combos * actions"""))
def w16_block_errors(spark, d):
    sizes = spark.sql(BLOCK.replace("FROM moves", "FROM {moves}"), moves=role(spark, d, "moves"))
    arrays = sizes.select("hand_id", *[F.array_repeat(F.lit(0), F.col(c).cast("int")).alias(c) for c in ("combos", "weights", "actions", "strategy")])
    return R.block_errors(arrays).select("hand_id", "errors")
