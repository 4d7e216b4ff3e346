"""Queries of the joins, and of checks on lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.operators import lookup as J
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.plans.stats import r4
from decilog.session import table

LIVE = "SELECT cluster_key, arg_max(node_id, created_at) AS node_id, arg_max(source, created_at) AS source FROM nodes WHERE active GROUP BY cluster_key"


@query(with_roles(f"WITH n AS ({LIVE}) SELECT m.session_id, m.cluster_key, round(m.value, 10) AS value, n.node_id, n.source FROM metrics m LEFT JOIN n ON n.cluster_key = m.cluster_key WHERE m.cluster_key NOT IN (SELECT cluster_key FROM suppressions WHERE active)"))
def j01_join_active(spark, d):
    got = J.join_active(role(spark, d, "metrics"), role(spark, d, "nodes"), role(spark, d, "suppressions"))
    return got.select("session_id", "cluster_key", F.round("value", 10).alias("value"), "node_id", "source")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) AS has_deal FROM orders")
def j02_with_exists(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    df = J.with_exists(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], "has_lines")
    return J.with_exists(df, lines.where("l_discount > 0.09"), ["o_orderkey"], "has_deal")


@query(with_roles("""WITH s AS (SELECT cluster_key, solved_at, max(solve_id) AS solve_id FROM solves GROUP BY cluster_key, solved_at)
SELECT p.patch_id, p.cluster_key, s.solve_id FROM patches p ASOF LEFT JOIN s ON p.cluster_key = s.cluster_key AND p.ts >= s.solved_at"""))
def j03_with_latest_as_of(spark, d):
    solves = role(spark, d, "solves").groupBy("cluster_key", "solved_at").agg(F.max("solve_id").alias("solve_id"))
    got = J.with_latest(role(spark, d, "patches").select("patch_id", "cluster_key", "ts"), solves, "cluster_key", "solved_at", "solve_id", as_of="ts", row_id="patch_id")
    return got.select("patch_id", "cluster_key", "solve_id")


@query(with_roles("SELECT p.patch_id, n.source AS new_source, o.source AS prev_source FROM patches p JOIN nodes n ON n.node_id = p.new_node_id LEFT JOIN nodes o ON o.node_id = p.prev_node_id"))
def j04_patch_nodes(spark, d):
    return J.join_patch_nodes(role(spark, d, "patches"), role(spark, d, "nodes")).select("patch_id", "new_source", "prev_source")


SPOT = "SELECT p_partkey, concat(p_brand, '|', CASE WHEN p_partkey % 9 = 0 THEN 'RARE' ELSE p_type END, '|', CAST(p_size AS VARCHAR(9))) AS k, concat(p_brand, '|', CASE WHEN p_partkey % 9 = 0 THEN 'RARE' ELSE p_type END) AS prefix FROM part"


@query(with_roles(f"""WITH s AS ({SPOT}), n AS (SELECT prefix, arg_min(v, k) AS v FROM lookup GROUP BY prefix), m AS (SELECT avg(v) AS v FROM lookup)
SELECT s.p_partkey, CAST(CASE WHEN e.v IS NOT NULL THEN 0 WHEN n.v IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS level, round(coalesce(e.v, n.v, m.v), 4) AS v FROM s LEFT JOIN lookup e ON e.k = s.k LEFT JOIN n ON n.prefix = s.prefix, m"""))
def j05_lookup_fallback(spark, d):
    spots = spark.sql(SPOT.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    return J.lookup_fallback(spots, role(spark, d, "lookup"), "k", "prefix", "v").select("p_partkey", "level", *r4("v"))


CHART = "SELECT actor, street, action, count(*) / CAST(sum(count(*)) OVER (PARTITION BY actor, street) AS DOUBLE) AS freq FROM moves WHERE street <> 'river' GROUP BY actor, street, action"


@query(with_roles(f"""WITH c AS ({CHART}), r AS (SELECT actor, street, max(freq) FILTER (WHERE action = 'raise') AS raise FROM c GROUP BY actor, street)
SELECT m.hand_id, m.seq, m.amount <= 40 AND r.actor IS NOT NULL AS hit, round(CASE WHEN m.amount <= 40 THEN r.raise END, 6) AS raise FROM moves m LEFT JOIN r ON r.actor = m.actor AND r.street = m.street"""))
def j06_join_chart(spark, d):
    moves = role(spark, d, "moves")
    charts = spark.sql(CHART.replace("FROM moves", "FROM {moves}"), moves=moves)
    got = J.join_chart(moves, charts, ["actor", "street"], F.col("amount") <= 40)
    return got.select("hand_id", "seq", "hit", F.round(F.try_element_at("chart", F.lit("raise")), 6).alias("raise"))


@query(with_roles("""WITH t AS (SELECT p_brand || '/' || p_type AS name, count(*) AS v FROM part WHERE p_size < 6 GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
x AS (SELECT p_partkey, p_brand || '/' || p_type AS name, 0 AS place FROM part UNION ALL SELECT p_partkey, p_type, 1 FROM part)
SELECT p_partkey, arg_min(x.name, place) AS name, arg_min(v, place) AS v FROM x JOIN t ON t.name = x.name GROUP BY p_partkey"""))
def j07_first_candidate(spark, d):
    part = table(spark, d, "part")
    pair = F.concat("p_brand", F.lit("/"), "p_type")
    fine = part.where("p_size < 6").groupBy(pair.alias("name")).agg(F.count(F.lit(1)).alias("v"))
    rough = part.where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("v"))
    return J.first_candidate(part, "p_partkey", F.array(pair, "p_type"), fine.unionByName(rough), "name", "v")


MATRIX = "SELECT x.actor AS a, y.actor AS b, CASE WHEN x.n + y.n > 20000 THEN x.n / CAST(x.n + y.n AS DOUBLE) ELSE 0.5 + (x.n - y.n) / CAST(x.n + 1 AS DOUBLE) END AS v FROM (SELECT actor, count(*) AS n FROM moves GROUP BY actor) x CROSS JOIN (SELECT actor, count(*) AS n FROM moves GROUP BY actor) y"


@query(with_roles(f"WITH m AS ({MATRIX}) SELECT m.a, m.b, round(m.v, 6) AS v FROM m LEFT JOIN m o ON o.a = m.b AND o.b = m.a WHERE o.v IS NULL OR abs(m.v + o.v - 1) > 1e-9"))
def j09_pair_check(spark, d):
    m = spark.sql(MATRIX.replace("FROM moves", "FROM {moves}"), moves=role(spark, d, "moves"))
    return J.pair_check(m, "a", "b", "v").select("a", "b", F.round("v", 6).alias("v"))


SIDES = "SELECT p_brand, p_size % 2 AS side, p_partkey AS item, p_retailprice AS w FROM part"


@query(with_roles(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY p_brand, side ORDER BY w DESC, item) AS r FROM ({SIDES}))
SELECT x.p_brand, x.item AS item_0, y.item AS item_1, round(x.w * y.w, 2) AS weight FROM s x JOIN s y ON x.p_brand = y.p_brand AND x.side = 0 AND y.side = 1"""))
def j10_bounded_product(spark, d):
    df = spark.sql(SIDES.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    # prices are positive; F.round would go through a decimal for every pair
    return J.bounded_product(df, ["p_brand"], "side", "item", "w", budget=100).withColumn("weight", F.floor(F.col("weight") * 100 + 0.5) / 100)


@query(with_roles(f"""WITH s AS (SELECT p_brand, p_size % 3 AS side, p_size AS item, count(*) AS w FROM part GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, side ORDER BY w DESC, item) AS r FROM s)
SELECT x.p_brand, x.item AS item_0, y.item AS item_1, z.item AS item_2, x.w * y.w * z.w AS weight FROM t x JOIN t y ON x.p_brand = y.p_brand AND x.side = 0 AND y.side = 1 JOIN t z ON z.p_brand = x.p_brand AND z.side = 2 WHERE x.r <= 4 AND y.r <= 4 AND z.r <= 4"""))
def j10_capped_product(spark, d):
    """Three sides: the four heaviest items of each (the cube root of 100)."""
    df = table(spark, d, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("side"), F.col("p_size").alias("item")).agg(F.count(F.lit(1)).alias("w"))
    return J.bounded_product(df, ["p_brand"], "side", "item", "w", budget=100, sides=3)


@query(with_roles("""WITH b AS (SELECT cluster_key, action, row_number() OVER (PARTITION BY cluster_key ORDER BY ts, obs_id) AS k FROM obs WHERE source = 'hh'), c AS (SELECT cluster_key, action, row_number() OVER (PARTITION BY cluster_key ORDER BY ts, obs_id) AS k FROM obs WHERE source = 'sim')
SELECT b.cluster_key, CAST(b.k AS INTEGER) AS occurrence, b.action AS base, c.action AS cand FROM b JOIN c ON c.cluster_key = b.cluster_key AND c.k = b.k"""))
def j11_pair_runs(spark, d):
    obs = role(spark, d, "obs")
    return J.pair_runs(obs.where("source = 'hh'"), obs.where("source = 'sim'"), "cluster_key", ["ts", "obs_id"])


@query(with_roles(f"""WITH n AS ({LIVE}), o AS (SELECT cluster_key, count(*) AS n_obs, min(obs_id) AS sample_obs FROM obs GROUP BY cluster_key)
SELECT c.id, c.cluster_key, coalesce(o.n_obs, 0) AS n_obs, o.sample_obs, n.node_id FROM (SELECT id, 'c' || (id % 25) AS cluster_key FROM corpus) c LEFT JOIN o ON o.cluster_key = c.cluster_key LEFT JOIN n ON n.cluster_key = c.cluster_key"""))
def j12_enrich(spark, d):
    rows = role(spark, d, "corpus").select("id", F.concat(F.lit("c"), F.col("id") % 25).alias("cluster_key"))
    return J.enrich(rows, role(spark, d, "obs"), role(spark, d, "nodes")).select("id", "cluster_key", "n_obs", "sample_obs", "node_id")
