"""Queries of divergences, shrinkage, metrics and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.functions import predicates
from decilog.operators import metrics as M
from decilog.operators import stats as S
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.session import table


def r4(*columns):
    return [F.round(c, 4).alias(c) for c in columns]


def action_freq_of(spark, d):
    return S.action_freq(role(spark, d, "obs"), ["cluster_key"])


FREQ = "SELECT cluster_key, action, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster_key) AS DOUBLE) AS p FROM obs GROUP BY cluster_key, action"
ALL = "SELECT action, count(*) / CAST((SELECT count(*) FROM obs) AS DOUBLE) AS q FROM obs GROUP BY action"
PAIR = f"""f AS ({FREQ}), a AS ({ALL}), k AS (SELECT DISTINCT cluster_key FROM obs),
 u AS (SELECT k.cluster_key, a.action, coalesce(f.p, 0) AS p, a.q FROM k CROSS JOIN a LEFT JOIN f ON f.cluster_key = k.cluster_key AND f.action = a.action)"""


def overall_of(spark, d):
    """The share of each action over everything, for every cluster."""
    obs = role(spark, d, "obs")
    p = S.action_freq(obs.withColumn("all", F.lit(1)), ["all"]).select("action", "p")
    return obs.select("cluster_key").distinct().crossJoin(F.broadcast(p))


@query(with_roles(f"SELECT cluster_key, action, n, round(p, 4) AS p FROM ({FREQ})"))
def a14_action_freq(spark, d):
    return action_freq_of(spark, d).select("cluster_key", "action", "n", *r4("p"))


@query(with_roles(f"""WITH {PAIR}, e AS (SELECT cluster_key, (p + 1e-6) / sum(p + 1e-6) OVER (PARTITION BY cluster_key) AS p, (q + 1e-6) / sum(q + 1e-6) OVER (PARTITION BY cluster_key) AS q FROM u)
SELECT cluster_key, round(sum(p * ln(p / q)), 6) AS kl FROM e GROUP BY cluster_key"""))
def a15_kl(spark, d):
    return S.kl(action_freq_of(spark, d), overall_of(spark, d), ["cluster_key"]).select("cluster_key", F.round("kl", 6).alias("kl"))


@query(with_roles(f"""WITH {PAIR} SELECT cluster_key, round(sum(greatest(p, 1e-6) * ln(greatest(p, 1e-6) / greatest(q, 1e-6))), 6) AS kl_floor FROM u GROUP BY cluster_key"""))
def a16_kl_floor(spark, d):
    return S.kl_floor(action_freq_of(spark, d), overall_of(spark, d), ["cluster_key"]).select("cluster_key", F.round("kl_floor", 6).alias("kl_floor"))


@query(with_roles(f"""WITH {PAIR} SELECT cluster_key, round(0.5 * sum(abs(p - q)), 6) AS tvd FROM u GROUP BY cluster_key"""))
def a17_tvd(spark, d):
    return S.tvd(action_freq_of(spark, d), overall_of(spark, d), ["cluster_key"]).select("cluster_key", F.round("tvd", 6).alias("tvd"))


@query(with_roles("SELECT session_id, round(avg(CASE WHEN sparse THEN 1.0 ELSE 0.0 END), 6) AS rate FROM obs GROUP BY session_id"))
def a19_novel_rate(spark, d):
    return M.novel_rate(role(spark, d, "obs"), "session_id", "sparse").select("session_id", F.round("rate", 6).alias("rate"))


@query(with_roles("SELECT session_id, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99 FROM obs GROUP BY session_id"))
def a20_latency_percentiles(spark, d):
    return M.latency_percentiles(role(spark, d, "obs"), "session_id", "value").select("session_id", *r4("p50", "p99"))


@query(with_roles("SELECT session_id, p, round(CASE p WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.99) END, 9) AS value FROM obs, (SELECT unnest([0.5, 0.99])::DOUBLE AS p) GROUP BY session_id, p"))
def a20_exact_percentiles(spark, d):
    """Found by narrowing ranges: no task holds the values of a session."""
    return M.exact_percentiles(role(spark, d, "obs"), ["session_id"], "value", [0.5, 0.99]).withColumn("value", F.round("value", 9))


@query(with_roles("""SELECT session_id, cluster_key, 'ev_loss' AS name, round(value, 10) AS value FROM metrics
UNION ALL SELECT session_id, NULL, 'novel_spot_rate', round(avg(CASE WHEN sparse THEN 1.0 ELSE 0.0 END), 10) FROM obs GROUP BY session_id
UNION ALL SELECT session_id, NULL, 'latency_p50', round(quantile_cont(value, 0.5), 10) FROM obs GROUP BY session_id
UNION ALL SELECT session_id, NULL, 'latency_p99', round(quantile_cont(value, 0.99), 10) FROM obs GROUP BY session_id"""))
def a21_session_metrics(spark, d):
    obs, losses = role(spark, d, "obs"), role(spark, d, "metrics")
    return M.session_metrics(obs, losses, "value").select("session_id", "cluster_key", "name", F.round("value", 10).alias("value"))


EB = """SELECT *, greatest(0, CASE WHEN k < 2 THEN 0 ELSE v - sv END) AS tau2 FROM (
 SELECT *, 0.05 / n AS s, avg(value) OVER w AS mu, count(*) OVER w AS k, var_samp(value) OVER w AS v, avg(0.05 / n) OVER w AS sv FROM metrics WINDOW w AS (PARTITION BY session_id))"""


@query(with_roles(f"""SELECT session_id, cluster_key, round(mu, 6) AS mu, round(tau2, 6) AS tau2,
 round(CASE WHEN k < 2 THEN value WHEN tau2 = 0 THEN mu ELSE (s * mu + tau2 * value) / (s + tau2) END, 6) AS post_mean,
 round(CASE WHEN k < 2 THEN s WHEN tau2 = 0 THEN 0 ELSE tau2 * s / (s + tau2) END, 6) AS post_var FROM ({EB})"""))
def a22_eb_shrink(spark, d):
    got = S.eb_shrink(role(spark, d, "metrics"), "session_id", "value", "n")
    return got.select("session_id", "cluster_key", *[F.round(c, 6).alias(c) for c in ("mu", "tau2", "post_mean", "post_var")])


@query(with_roles(f"""SELECT session_id, cluster_key, round(m - 1.96 * sqrt(pv), 4) AS ci_low, round(m + 1.96 * sqrt(pv), 4) AS ci_high, tau2 = 0 OR s / (s + tau2) > 0.1 AS shrunk FROM (
 SELECT *, CASE WHEN k < 2 THEN value WHEN tau2 = 0 THEN mu ELSE (s * mu + tau2 * value) / (s + tau2) END AS m,
 CASE WHEN k < 2 THEN s WHEN tau2 = 0 THEN 0 ELSE tau2 * s / (s + tau2) END AS pv FROM ({EB}))"""))
def a23_intervals(spark, d):
    got = S.with_ci(S.eb_shrink(role(spark, d, "metrics"), "session_id", "value", "n"))
    return got.select("session_id", "cluster_key", *r4("ci_low", "ci_high"), S.is_shrunk(F.col("n"), F.col("tau2")).alias("shrunk"))


BYC = """live AS (SELECT cluster_key, arg_max(source, created_at) AS source FROM nodes WHERE active GROUP BY cluster_key),
hid AS (SELECT DISTINCT cluster_key FROM suppressions WHERE active),
byc AS (SELECT m.cluster_key, avg(m.value) AS mean, count(DISTINCT session_id) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM metrics m
 WHERE m.ts > TIMESTAMP '2024-01-05 00:00:00' AND m.cluster_key NOT IN (SELECT cluster_key FROM hid) GROUP BY m.cluster_key)"""


def by_cluster(spark, d):
    names = ("metrics", "nodes", "suppressions")
    return M.metric_by_cluster(*[role(spark, d, n) for n in names], F.to_timestamp(F.lit("2024-01-05 00:00:00")))


@query(with_roles(f"WITH {BYC} SELECT b.cluster_key, round(mean, 4) AS mean, sessions, n, source FROM byc b LEFT JOIN live l ON l.cluster_key = b.cluster_key"))
def a24_metric_by_cluster(spark, d):
    return by_cluster(spark, d).select("cluster_key", *r4("mean"), "sessions", "n", "source")


@query(with_roles("SELECT cluster_key, count(*) AS n, round(avg(value), 4) AS mean, TRUE AS holds_mean, TRUE AS near_normal FROM obs GROUP BY cluster_key"))
def a25_bootstrap_ci(spark, d):
    """Intervals hold the mean, and their width is within a third of the normal one."""
    obs = role(spark, d, "obs")
    got = S.bootstrap_ci(obs, ["cluster_key"], "value").join(obs.groupBy("cluster_key").agg(F.stddev_samp("value").alias("sd")), "cluster_key")
    width = (F.col("ci_high") - F.col("ci_low")) / (2 * 1.96 * F.col("sd") / F.sqrt("n"))
    return got.select("cluster_key", "n", *r4("mean"), F.col("mean").between(F.col("ci_low"), F.col("ci_high")).alias("holds_mean"), width.between(2 / 3, 4 / 3).alias("near_normal"))


@query(with_roles("""WITH b AS (SELECT cluster_key, action, row_number() OVER (PARTITION BY cluster_key ORDER BY ts, obs_id) AS k FROM obs WHERE source = 'hh'),
c AS (SELECT cluster_key, action, row_number() OVER (PARTITION BY cluster_key ORDER BY ts, obs_id) AS k FROM obs WHERE source = 'sim'),
q AS (SELECT cluster_key, action, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster_key) AS DOUBLE) AS p FROM obs GROUP BY cluster_key, action)
SELECT b.cluster_key, round(avg(ln(coalesce(y.p, 0) + 1e-6) - ln(coalesce(x.p, 0) + 1e-6)), 6) AS mean_delta, count(*) AS n,
 count(*) FILTER (WHERE x.p IS NOT NULL AND y.p IS NOT NULL) AS hits, count(*) FILTER (WHERE x.p IS NOT NULL AND y.p IS NOT NULL) = 0 AS zero_hits
FROM b JOIN c ON b.cluster_key = c.cluster_key AND b.k = c.k LEFT JOIN q x ON x.cluster_key = b.cluster_key AND x.action = b.action LEFT JOIN q y ON y.cluster_key = b.cluster_key AND y.action = c.action GROUP BY b.cluster_key"""))
def a26_paired_deltas(spark, d):
    obs = role(spark, d, "obs")
    pairs = S.pair_runs(obs.where("source = 'hh'"), obs.where("source = 'sim'"), "cluster_key", ["ts", "obs_id"])
    return S.paired_deltas(pairs, action_freq_of(spark, d), "cluster_key").drop("var_delta").withColumn("mean_delta", F.round("mean_delta", 6))


@query(with_roles("""SELECT opponent, round(m * 100, 2) AS bb_per_100, CASE WHEN lo > 0 THEN 'won' WHEN hi < 0 THEN 'lost' ELSE 'inconclusive' END AS verdict FROM (
SELECT opponent, avg(bb_delta) AS m, avg(bb_delta) - 1.96 * stddev_samp(bb_delta) / sqrt(count(*)) AS lo, avg(bb_delta) + 1.96 * stddev_samp(bb_delta) / sqrt(count(*)) AS hi FROM payoffs GROUP BY opponent)"""))
def a27_verdicts(spark, d):
    got = role(spark, d, "payoffs").groupBy("opponent").agg(F.avg("bb_delta").alias("mean"), (F.var_samp("bb_delta") / F.count(F.lit(1))).alias("v"))
    return S.with_verdict(S.with_ci(got, "mean", "v")).select("opponent", F.round("bb_per_100", 2).alias("bb_per_100"), "verdict")


CHIPS = "SELECT hand_id, seq, street, street_no, actor, CASE action WHEN 'fold' THEN 0 WHEN 'check' THEN 0 WHEN 'raise' THEN 2 ELSE 1 END * CAST(amount AS DOUBLE) AS chips FROM moves"


def with_chips(spark, d):
    return role(spark, d, "moves").withColumn("chips", M.action_weight(F.col("action")) * F.col("amount"))


@query(with_roles(f"""WITH c AS (SELECT *, sum(chips) OVER w AS total, max(street_no) OVER w AS last FROM ({CHIPS}) WINDOW w AS (PARTITION BY hand_id)),
s AS (SELECT hand_id, street, CASE WHEN max(total) > 0 THEN sum(chips) / max(total) WHEN street_no = max(last) THEN 1 ELSE 0 END AS share FROM c GROUP BY hand_id, street, street_no)
SELECT coalesce(street, 'preflop') AS street, round(sum(bb_delta * coalesce(share, 1)), 2) AS bb FROM payoffs p LEFT JOIN s ON s.hand_id = p.hand_id GROUP BY 1"""))
def a28_attribute_by_street(spark, d):
    return M.attribute_by_street(with_chips(spark, d), role(spark, d, "payoffs")).select("street", F.round("bb", 2).alias("bb"))


@query(with_roles(f"""WITH c AS (SELECT *, CASE WHEN sum(chips) OVER w > 0 THEN chips / sum(chips) OVER w ELSE 1 / CAST(count(*) OVER w AS DOUBLE) END AS share FROM ({CHIPS}) WINDOW w AS (PARTITION BY hand_id))
SELECT actor, count(*) AS n_decisions, round(sum(share * bb_delta), 2) AS bb_total FROM c JOIN payoffs p ON p.hand_id = c.hand_id GROUP BY actor"""))
def a30_attribute_by_cluster(spark, d):
    return M.attribute_by_cluster(with_chips(spark, d), role(spark, d, "payoffs"), "actor").withColumn("bb_total", F.round("bb_total", 2))


@query(with_roles("""WITH t AS (SELECT o_custkey, round(sum(bb_delta), 4) AS x FROM payoffs GROUP BY o_custkey)
SELECT 'profitable' AS side, * FROM (SELECT * FROM t ORDER BY x DESC, o_custkey LIMIT 5) WHERE x > 0 UNION ALL SELECT 'leaky', * FROM (SELECT * FROM t ORDER BY x, o_custkey LIMIT 5) WHERE x < 0"""))
def a31_top_clusters(spark, d):
    got = role(spark, d, "payoffs").groupBy("o_custkey").agg(F.round(F.sum("bb_delta"), 4).alias("x"))
    return M.top_clusters(got, "x", "o_custkey").select("side", "o_custkey", "x")


@query(with_roles("SELECT action, count(*) AS n, round(sum(CASE action WHEN 'fold' THEN 0 WHEN 'check' THEN 0 WHEN 'raise' THEN 2 ELSE 1 END * CAST(amount AS DOUBLE)), 2) AS chips FROM moves GROUP BY action"))
def a32_action_weights(spark, d):
    return with_chips(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("chips"), 2).alias("chips"))


@query(with_roles("SELECT opponent, count(*) AS played, count(*) FILTER (WHERE status = 'completed') AS completed, round(avg(bb_delta) FILTER (WHERE status = 'completed'), 4) AS mean, round(max(bb_delta), 4) AS best FROM payoffs WHERE status IN ('completed', 'aborted') GROUP BY opponent"))
def a33_leaderboard(spark, d):
    return M.leaderboard(role(spark, d, "payoffs")).select("opponent", "played", "completed", *r4("mean", "best"))


@query(with_roles("""WITH x AS (SELECT cluster_key, arg_max(exploitability, (solved_at, solve_id)) AS x FROM solves GROUP BY cluster_key), v AS (SELECT cluster_key, count(*) AS visits FROM obs GROUP BY cluster_key)
SELECT round(sum(x * coalesce(visits, 0)) / sum(CASE WHEN x IS NOT NULL THEN coalesce(visits, 0) END), 4) AS mean, round(sum(CASE WHEN x IS NOT NULL THEN coalesce(visits, 0) END) / CAST(sum(visits) AS DOUBLE), 4) AS coverage, count(x) AS solved FROM x FULL JOIN v USING (cluster_key)"""))
def a34_exploitability(spark, d):
    return M.exploitability(role(spark, d, "solves"), role(spark, d, "obs")).select(*r4("mean", "coverage"), "solved")


@query(with_roles("SELECT session_id, round(mean, 4) AS mean FROM (SELECT session_id, avg(value) AS mean, min(ts) AS ts FROM metrics GROUP BY session_id ORDER BY ts DESC LIMIT 12)"))
def a37_metric_trend(spark, d):
    return M.metric_trend(role(spark, d, "metrics"), 12).select("session_id", *r4("mean"))


@query(with_roles("""WITH s AS (SELECT session_id, avg(value) AS v, min(ts) AS ts FROM metrics GROUP BY session_id), r AS (SELECT avg(v) AS recent FROM (SELECT v FROM s ORDER BY ts DESC LIMIT 3)),
b AS (SELECT avg(v) AS before FROM s WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)
SELECT round(recent, 4) AS recent, round(before, 4) AS before, CASE WHEN recent < before * 0.95 THEN 'improving' WHEN recent > before * 1.05 THEN 'stalled' ELSE 'mixed' END AS verdict FROM r, b"""))
def a38_loop_health(spark, d):
    return M.loop_health(role(spark, d, "metrics"), F.to_timestamp(F.lit("2024-01-31 00:00:00"))).select(*r4("recent", "before"), "verdict")


@query(with_roles("SELECT session_id, count(*) AS n, count(*) FILTER (WHERE sparse) AS sparse, count(DISTINCT cluster_key) AS clusters FROM obs GROUP BY session_id ORDER BY session_id DESC LIMIT 1"))
def a39_latest_session(spark, d):
    return M.latest_session(role(spark, d, "obs"))


@query(with_roles("SELECT source, count(*) AS n, count(*) FILTER (WHERE created_at > 1000 - 200) AS fresh FROM nodes WHERE active GROUP BY source"))
def a40_node_growth(spark, d):
    return M.node_growth(role(spark, d, "nodes"), 1000, 200)


@query(with_roles("""SELECT o.cluster_key, o.n_obs, o.sparse, round(o.max_distance, 4) AS max_distance, round(m.mean, 4) AS mean FROM (SELECT cluster_key, count(*) AS n_obs, bool_or(sparse) AS sparse, max(distance) AS max_distance FROM obs GROUP BY cluster_key) o
LEFT JOIN (SELECT cluster_key, avg(value) AS mean FROM metrics GROUP BY cluster_key) m ON m.cluster_key = o.cluster_key"""))
def a41_cluster_rollup(spark, d):
    return M.cluster_rollup(role(spark, d, "obs"), role(spark, d, "metrics")).select("cluster_key", "n_obs", "sparse", *r4("max_distance", "mean"))


@query(with_roles("SELECT hand_id, count(*) AS n_decisions, arg_min(actor, seq) AS first_actor, arg_max(street, street_no) AS street_reached, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day FROM moves GROUP BY hand_id"))
def a42_hand_rollup(spark, d):
    got = M.entity_rollup(role(spark, d, "moves"))
    return got.select("hand_id", "n_decisions", "first_actor", "street_reached", F.col("first_ts").cast("date").cast("string").alias("first_day"))


@query(with_roles("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM obs) SELECT CAST(least(floor((value - lo) / (hi - lo) * 11), 10) AS BIGINT) AS bin, count(*) AS n FROM obs, e GROUP BY 1"""))
def a46_histogram(spark, d):
    return M.histogram(role(spark, d, "obs"), "value")


@query(with_roles("""WITH s AS (SELECT cluster_key, session_id, CASE WHEN max(value) OVER w = min(value) OVER w THEN 0 ELSE least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 8), 7) END AS lv FROM metrics WINDOW w AS (PARTITION BY cluster_key))
SELECT cluster_key, string_agg(CAST(CAST(lv AS INTEGER) AS VARCHAR), '' ORDER BY session_id) AS line FROM s GROUP BY cluster_key"""))
def a47_sparkline(spark, d):
    return M.sparkline(role(spark, d, "metrics"), "cluster_key", "session_id", "value")


@query("SELECT round(avg(p_retailprice), 4) AS p_retailprice, round(avg(p_size), 4) AS p_size FROM part")
def a48_column_means(spark, d):
    return S.column_means(table(spark, d, "part"), ["p_retailprice", "p_size"]).select(*r4("p_retailprice", "p_size"))


@query("""SELECT dim, count(*) AS n, bool_and(NOT isnan(x)) AS finite, bool_and(abs(x) <= 1) AS in_range, count(*) FILTER (WHERE x = 0) AS zeros, count(DISTINCT CAST(floor(x * 1000 + 0.5) AS BIGINT)) AS spread
FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim""")
def a49_vector_quality(spark, d):
    df = table(spark, d, "embeddings")
    long = df.select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    spread = long.groupBy("dim").agg(F.countDistinct(F.floor(F.col("x") * 1000 + 0.5)).alias("spread"))
    return M.vector_quality(df, "embedding").drop("spread").join(spread, "dim")


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand LIMIT 200")
def a50_distinct_values(spark, d):
    return M.distinct_values(table(spark, d, "part"), "p_brand")


@query(with_roles("SELECT status AS reason, count(*) AS n FROM payoffs GROUP BY status"))
def a51_reason_counts(spark, d):
    return M.reason_counts(role(spark, d, "payoffs").withColumnRenamed("status", "reason"), "reason")


@query(with_roles("SELECT source, count(*) AS n FROM obs WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY source"))
def p09_since(spark, d):
    near = predicates.since(F.col("ts"), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 7)
    return role(spark, d, "obs").where(near).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS mean FROM part GROUP BY p_brand""")
def a03_weighted_mean(spark, d):
    return S.weighted_mean(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", *r4("mean"))


@query("SELECT p_type, CAST(sum(p_size) AS BIGINT) AS weight FROM part GROUP BY p_type")
def a04_pooled_weights(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.sum("p_size").alias("weight"))


@query(with_roles("""WITH f AS (SELECT p_brand, p_type, count(*) AS n, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS r FROM part GROUP BY p_brand, p_type), m AS (SELECT p_type, count(*) AS n, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS r FROM part GROUP BY p_type),
t AS (SELECT avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS r FROM part)
SELECT f.p_brand, f.p_type, CAST(CASE WHEN f.n >= 18 THEN 0 WHEN m.n >= 18 THEN 1 ELSE 2 END AS BIGINT) AS level, round(CASE WHEN f.n >= 18 THEN f.r WHEN m.n >= 18 THEN m.r ELSE t.r END, 4) AS big FROM f JOIN m ON m.p_type = f.p_type, t"""))
def a05_rates_with_fallback(spark, d):
    got = S.rates_with_fallback(table(spark, d, "part"), ["p_brand", "p_type"], {"big": F.col("p_size") > 25}, min_n=18)
    return got.select("p_brand", "p_type", "level", *r4("big"))


@query(with_roles("""SELECT actor, round(rate, 4) AS rate, round((row_number() OVER (ORDER BY rate, actor) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE), 4) AS scaled FROM (SELECT actor, avg(CASE WHEN action IN ('bet', 'raise') THEN 1.0 ELSE 0.0 END) AS rate FROM moves GROUP BY actor)"""))
def a06_rank_by_rate(spark, d):
    return S.rank_by_rate(role(spark, d, "moves"), "actor", F.col("action").isin("bet", "raise")).select("actor", *r4("rate", "scaled"))


@query(with_roles("""WITH f AS (SELECT actor, action, count(*) / CAST(sum(count(*)) OVER (PARTITION BY actor) AS DOUBLE) AS p FROM moves GROUP BY actor, action), g AS (SELECT k.actor, a.action, coalesce(f.p, 0) AS p FROM (SELECT DISTINCT actor FROM f) k CROSS JOIN (SELECT DISTINCT action FROM f) a LEFT JOIN f ON f.actor = k.actor AND f.action = a.action)
SELECT x.actor AS a, y.actor AS b, round(1 - sum(CASE WHEN x.p > 0 THEN x.p * log2(2 * x.p / (x.p + y.p)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * log2(2 * y.p / (x.p + y.p)) ELSE 0 END) / 2, 6) AS similarity FROM g x JOIN g y ON x.action = y.action AND x.actor < y.actor GROUP BY 1, 2"""))
def a07_pair_similarity(spark, d):
    return S.pair_similarity(role(spark, d, "moves"), "actor", "action").withColumn("similarity", F.round("similarity", 6))


@query(with_roles("SELECT actor, street, arg_min(action, (-n, action)) AS modal, max(n) AS n FROM (SELECT actor, street, action, count(*) AS n FROM moves GROUP BY actor, street, action) GROUP BY actor, street"))
def a08_modal(spark, d):
    return S.modal(role(spark, d, "moves"), ["actor", "street"], "action")


@query(with_roles("""WITH t AS (SELECT p_type, p_retailprice AS x, CAST(sum(p_size) AS DOUBLE) AS w FROM part GROUP BY p_type, p_retailprice), c AS (SELECT p_type, x, sum(w) OVER (PARTITION BY p_type ORDER BY x) / sum(w) OVER (PARTITION BY p_type) AS c FROM t),
l AS (SELECT *, lag(c) OVER o AS c0, lag(x) OVER o AS x0 FROM c WINDOW o AS (PARTITION BY p_type ORDER BY x))
SELECT p_type, p, round(max(CASE WHEN c0 IS NULL THEN x ELSE x0 + (x - x0) * (p - c0) / (c - c0) END), 4) AS q FROM l, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS p) WHERE p <= c AND (c0 IS NULL OR p > c0) GROUP BY p_type, p"""))
def a11_weighted_quantiles(spark, d):
    df = table(spark, d, "part").groupBy("p_type", F.col("p_retailprice").alias("x")).agg(F.sum("p_size").cast("double").alias("w"))
    return S.weighted_quantiles(df, ["p_type"], "x", "w", [0.1, 0.25, 0.5, 0.75, 0.9]).withColumn("q", F.round("q", 4))


@query(with_roles("SELECT street, actor, action, count(*) AS n FROM moves GROUP BY street, actor, action ORDER BY n DESC, street, actor, action LIMIT 20"))
def a13_distinct_tuples(spark, d):
    return role(spark, d, "moves").groupBy("street", "actor", "action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "street", "actor", "action").limit(20)


@query("""SELECT dim, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, stddev_pop(x) < 1e-6 AS guarded FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim""")
def a01_zscore_fit(spark, d):
    got = S.fit_zscore(table(spark, d, "embeddings"), "embedding")
    return got.select("dim", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "guarded")


@query("""WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), f AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY dim)
SELECT vec_id, round(sum((x - m) / s), 4) AS total, round(sqrt(sum(((x - m) / s) * ((x - m) / s))), 4) AS norm FROM l JOIN f ON f.dim = l.dim GROUP BY vec_id""")
def a02_normalise(spark, d):
    df = table(spark, d, "embeddings")
    z = S.normalise(df, "embedding", S.manifest(S.fit_zscore(df, "embedding")))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    return z.select("vec_id", F.round(total, 4).alias("total"), F.round(norm, 4).alias("norm"))
