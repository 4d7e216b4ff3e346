"""Queries of grids, charts, roles, solves and the remaining joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from decilog.functions import cards as C
from decilog.functions import features as X
from decilog.functions import predicates as P
from decilog.operators import corpus as K
from decilog.operators import extract as E
from decilog.operators import grids as G
from decilog.operators import metrics as M
from decilog.operators import rank as R
from decilog.operators import stats as S
from decilog.plans.bindings import ordered_moves, role, with_roles
from decilog.plans.decisions import DEALT, NUMBERS, TURNS, form_sql, ratios, snap_sql
from decilog.plans.registry import query
from decilog.plans.stats import r4
from decilog.plans.stats import FREQ
from decilog.plans.vectors import NUMBER, OBSVEC, REB, d5, obs_vectors
from decilog.sources import io

CLS = "l_partkey % 13"


@query(with_roles("SELECT street, CAST(l_partkey % 13 AS BIGINT) AS cls, CAST(sum(amount) AS BIGINT) AS weight, round(avg(amount), 4) AS mean_weight, round(sum(amount * price) / sum(amount), 2) AS equity FROM moves GROUP BY 1, 2"))
def a43_range_grid(spark, d):
    cell = F.struct("seq", F.expr(CLS).alias("c"), "amount", "price")
    arrays = role(spark, d, "moves").groupBy("hand_id", "street").agg(F.array_sort(F.collect_list(cell)).alias("x"))
    arrays = arrays.select("street", F.col("x.c").alias("combos"), F.col("x.amount").alias("weights"), F.col("x.price").alias("equity"))
    return G.range_grid(arrays, ["street"]).select("street", "cls", "weight", *r4("mean_weight"), F.round("equity", 2).alias("equity"))


@query(with_roles("SELECT action, CAST(sum(amount) AS BIGINT) AS weight, round(sum(amount) / CAST(sum(sum(amount)) OVER () AS DOUBLE), 5) AS share FROM moves GROUP BY action"))
def a44_range_legend(spark, d):
    return G.range_legend(role(spark, d, "moves"), "action", "amount").select("action", "weight", d5("share"))


@query(with_roles("""WITH p AS (SELECT actor, CAST(l_partkey % 13 AS BIGINT) AS cls, count(*) FILTER (WHERE action <> 'fold') / CAST(count(*) AS DOUBLE) AS live FROM moves GROUP BY 1, 2)
SELECT actor, round(avg(live), 5) AS live_share, count(*) FILTER (WHERE live < 0.5) AS folding, count(*) AS classes FROM p GROUP BY actor"""))
def a45_range_summary(spark, d):
    p = S.action_freq(role(spark, d, "moves").withColumn("cls", F.expr(CLS)), ["actor", "cls"])
    return G.range_summary(p, ["actor"]).select("actor", d5("live_share"), "folding", "classes")


@query(with_roles("""WITH r AS (SELECT actor, CAST(l_partkey % 13 AS BIGINT) AS cls, count(*) FILTER (WHERE action = 'raise') / CAST(count(*) AS DOUBLE) AS r, count(*) FILTER (WHERE action = 'call') / CAST(count(*) AS DOUBLE) AS c FROM moves GROUP BY 1, 2)
SELECT actor, cls, 'raise' AS action, round(r, 4) AS freq FROM r WHERE round(r, 4) > 0 UNION ALL SELECT actor, cls, 'call', round(least(c, 1 - r), 4) FROM r WHERE round(least(c, 1 - r), 4) > 0"""))
def a09_build_charts(spark, d):
    return G.build_charts(role(spark, d, "moves").withColumn("cls", F.expr(CLS)), ["actor"])


@query(with_roles("""WITH r AS (SELECT actor, CAST(l_partkey % 13 AS BIGINT) AS cls, round(count(*) FILTER (WHERE action = 'raise') / CAST(count(*) AS DOUBLE), 4) AS r, round(count(*) FILTER (WHERE action = 'call') / CAST(count(*) AS DOUBLE), 4) AS c FROM moves GROUP BY 1, 2)
SELECT actor, round(sum(6 * (r + c)) / 1326, 5) AS mass, count(*) FILTER (WHERE r + c > 0) AS n_combos FROM r GROUP BY actor"""))
def a10_chart_coverage(spark, d):
    charts = G.build_charts(role(spark, d, "moves").withColumn("cls", F.expr(CLS)), ["actor"])
    return G.chart_coverage(charts, ["actor"], F.lit(6)).select("actor", d5("mass"), "n_combos")


def multiway(spark, d, sides: int):
    from decilog.operators.lookup import product_distribution
    from decilog.session import table

    df = table(spark, d, "part").groupBy("p_brand", (F.col("p_size") % sides).alias("side"), (F.col("p_size").cast("double") / 64).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    x = product_distribution(df, ["p_brand"], "side", "x", "w", sides, budget=100)
    mean = x.groupBy("p_brand").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return S.weighted_quantiles(x, ["p_brand"], "x", "w", [0.25, 0.5, 0.75]).join(mean, "p_brand").select("p_brand", "p", d5("q"), d5("mean"), "n")


@query(with_roles("""WITH s AS (SELECT p_brand, p_size % 2 AS side, CAST(p_size AS DOUBLE) / 64 AS x, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, side ORDER BY w DESC, x) AS r FROM s),
x AS (SELECT t0.p_brand, t0.x * t1.x AS x, sum(t0.w * t1.w) AS w FROM t t0 JOIN t t1 ON t1.p_brand = t0.p_brand AND t1.side = 1 WHERE t0.side = 0 GROUP BY 1, 2),
c AS (SELECT p_brand, x, w, sum(w) OVER (PARTITION BY p_brand ORDER BY x) / sum(w) OVER (PARTITION BY p_brand) AS c FROM x), l AS (SELECT *, lag(c) OVER o AS c0, lag(x) OVER o AS x0 FROM c WINDOW o AS (PARTITION BY p_brand ORDER BY x)),
m AS (SELECT p_brand, sum(x * w) / sum(w) AS mean, count(*) AS n FROM x GROUP BY p_brand)
SELECT l.p_brand, p, round(max(CASE WHEN c0 IS NULL THEN x ELSE x0 + (x - x0) * (p - c0) / (c - c0) END), 5) AS q, round(any_value(mean), 5) AS mean, any_value(n) AS n FROM l JOIN m ON m.p_brand = l.p_brand, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p) WHERE p <= c AND (c0 IS NULL OR p > c0) GROUP BY l.p_brand, p"""))
def a12_multiway_quantiles(spark, d):
    """Two sides: every pair of values, by their product."""
    return multiway(spark, d, 2)


@query(with_roles("""WITH s AS (SELECT p_brand, p_size % 3 AS side, CAST(p_size AS DOUBLE) / 64 AS x, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, side ORDER BY w DESC, x) AS r FROM s),
x AS (SELECT t0.p_brand, t0.x * t1.x * t2.x AS x, sum(t0.w * t1.w * t2.w) AS w FROM t t0 JOIN t t1 ON t1.p_brand = t0.p_brand AND t1.side = 1 JOIN t t2 ON t2.p_brand = t0.p_brand AND t2.side = 2 WHERE t0.side = 0 AND t0.r <= 4 AND t1.r <= 4 AND t2.r <= 4 GROUP BY 1, 2),
c AS (SELECT p_brand, x, w, sum(w) OVER (PARTITION BY p_brand ORDER BY x) / sum(w) OVER (PARTITION BY p_brand) AS c FROM x), l AS (SELECT *, lag(c) OVER o AS c0, lag(x) OVER o AS x0 FROM c WINDOW o AS (PARTITION BY p_brand ORDER BY x)),
m AS (SELECT p_brand, sum(x * w) / sum(w) AS mean, count(*) AS n FROM x GROUP BY p_brand)
SELECT l.p_brand, p, round(max(CASE WHEN c0 IS NULL THEN x ELSE x0 + (x - x0) * (p - c0) / (c - c0) END), 5) AS q, round(any_value(mean), 5) AS mean, any_value(n) AS n FROM l JOIN m ON m.p_brand = l.p_brand, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p) WHERE p <= c AND (c0 IS NULL OR p > c0) GROUP BY l.p_brand, p"""))
def a12_capped_multiway(spark, d):
    """Three sides: the four heaviest values of each (the cube root of 100)."""
    return multiway(spark, d, 3)


@query(with_roles("""WITH g AS (SELECT avg(value) < 0.6 AS gate_ok FROM metrics), m AS (SELECT opponent, avg(bb_delta) - 1.96 * stddev_samp(bb_delta) / sqrt(count(*)) AS lo FROM payoffs GROUP BY opponent), t AS (SELECT coalesce(bool_and(lo > 0), TRUE) AS matches_ok FROM m)
SELECT gate_ok, matches_ok, gate_ok AND matches_ok AS passed FROM g, t"""))
def a36_suite_verdict(spark, d):
    m = role(spark, d, "payoffs").groupBy("opponent").agg(F.avg("bb_delta").alias("mean"), (F.var_samp("bb_delta") / F.count(F.lit(1))).alias("v"))
    gate = role(spark, d, "metrics").agg((F.avg("value") < 0.6).alias("gate_ok"))
    return M.suite_verdict(S.with_ci(m, "mean", "v"), gate)


@query(with_roles("""WITH p AS (SELECT hand_id, street, action, amount / CAST(coalesce(sum(amount) OVER (PARTITION BY hand_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 AS DOUBLE) AS f FROM moves)
SELECT hand_id, street, count(*) FILTER (WHERE action = 'fold') AS n_fold, count(*) FILTER (WHERE action = 'check') AS n_check, count(*) FILTER (WHERE action = 'call') AS n_call, count(*) FILTER (WHERE action = 'bet') AS n_bet, count(*) FILTER (WHERE action = 'raise') AS n_raise,
 count(*) FILTER (WHERE action IN ('bet', 'raise') AND f > 0 AND f <= 0.33) AS size_0, count(*) FILTER (WHERE action IN ('bet', 'raise') AND f > 0.33 AND f <= 0.75) AS size_1, count(*) FILTER (WHERE action IN ('bet', 'raise') AND f > 0.75 AND f <= 1.25) AS size_2, count(*) FILTER (WHERE action IN ('bet', 'raise') AND f > 1.25) AS size_3 FROM p GROUP BY hand_id, street"""))
def f09_betting_features(spark, d):
    return G.betting_features(ratios(spark, d))


@query(with_roles("""WITH r AS (SELECT actor, l_partkey % 52 AS a, (l_partkey + 17) % 52 AS b, CAST(count(*) AS DOUBLE) AS w FROM moves GROUP BY 1, 2, 3), q AS (SELECT hand_id, actor, (l_partkey * 7) % 52 AS x, (l_partkey * 7 + l_suppkey % 51 + 1) % 52 AS y FROM moves WHERE seq = 0)
SELECT q.hand_id, round(sum(CASE WHEN r.a IN (x, y) OR r.b IN (x, y) THEN w ELSE 0 END) / sum(w), 5) AS blocked FROM q JOIN r ON r.actor = q.actor GROUP BY q.hand_id"""))
def f12_blockers(spark, d):
    moves = role(spark, d, "moves")
    combos = moves.groupBy("actor", (F.col("l_partkey") % 52).alias("a"), ((F.col("l_partkey") + 17) % 52).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    spots = moves.where("seq = 0").select("hand_id", "actor", F.array(*map(F.expr, NUMBERS)).alias("cards"))
    return G.with_blockers(spots, "hand_id", "cards", combos, "actor").select("hand_id", d5("blocked"))


ROLES_SQL = """WITH f AS (SELECT *, coalesce(sum(CASE WHEN action = 'raise' THEN 1 ELSE 0 END) OVER w, 0) AS raises, last_value(CASE WHEN action = 'raise' THEN actor END IGNORE NULLS) OVER w AS raiser FROM moves WHERE street = 'preflop' WINDOW w AS (PARTITION BY hand_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN action = 'raise' THEN CASE WHEN raises = 0 THEN 'pfr' WHEN raises = 1 THEN '3bettor' WHEN raises = 2 THEN '4bettor' ELSE '5bettor' END WHEN action = 'call' THEN CASE WHEN raises = 0 THEN 'limper' WHEN raises = 1 THEN 'caller' ELSE 'cold_caller' END WHEN action = 'check' AND raises = 0 THEN 'checker' END AS role FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY hand_id, actor ORDER BY CASE WHEN action = 'raise' THEN 2 WHEN role IS NOT NULL THEN 1 ELSE 0 END DESC, seq DESC) AS p FROM r)
SELECT hand_id, actor, coalesce(role, 'unknown') AS role, CASE WHEN role IS NOT NULL THEN raiser END AS target FROM k WHERE p = 1"""


@query(with_roles(ROLES_SQL))
def f28_preflop_roles(spark, d):
    return G.preflop_roles(ordered_moves(spark, d))


SCENARIO_SQL = f"""ro AS ({ROLES_SQL}), sc AS (SELECT hand_id, coalesce(string_agg(concat_ws(':', actor, role, target), '+' ORDER BY concat_ws(':', actor, role, target)) FILTER (WHERE actor <> 'BTN'), 'vNA') AS scenario FROM ro GROUP BY hand_id)"""


@query(with_roles(f"WITH {SCENARIO_SQL} SELECT scenario, count(*) AS n FROM sc GROUP BY scenario"))
def f17_scenario_keys(spark, d):
    return G.scenario_keys(G.preflop_roles(ordered_moves(spark, d)), "BTN").groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


SOLVE = """SELECT hand_id, seq, CASE action WHEN 'bet' THEN concat('BET ', CAST(amount AS VARCHAR(9))) WHEN 'raise' THEN concat('RAISE ', CAST(amount + 5 AS VARCHAR(9))) WHEN 'check' THEN 'CHECK' WHEN 'fold' THEN ' fold' ELSE 'call' END AS label,
 CAST(amount AS DOUBLE) AS freq, 40.0 AS pot, CAST(seq % 3 AS DOUBLE) AS to_call, CAST(seq % 2 AS DOUBLE) AS villain_total FROM moves"""


@query(with_roles(f"""WITH s AS ({SOLVE}) SELECT count(*) AS unread FROM s WHERE label LIKE 'RAISE%' AND to_call = 0"""))
def f21_unread_solver_labels(spark, d):
    bad = G.map_solver_actions(spark.sql(SOLVE.replace("FROM moves", "FROM {moves}"), moves=role(spark, d, "moves")), "hand_id")[1]
    return bad.agg(F.count(F.lit(1)).alias("unread"))


@query(with_roles(f"""WITH s AS ({SOLVE}), v AS (SELECT *, upper(split_part(trim(label), ' ', 1)) AS verb, TRY_CAST(split_part(trim(label), ' ', 2) AS DOUBLE) AS chips FROM s),
m AS (SELECT hand_id, freq, CASE WHEN verb IN ('CHECK', 'FOLD', 'CALL') THEN lower(verb) WHEN verb = 'BET' AND chips > 0 THEN CASE WHEN chips / pot >= 1.8 THEN 'bet_overbet' ELSE {snap_sql('chips / pot', X.BETS)} END
 WHEN verb = 'RAISE' AND chips > 0 AND to_call > 0 THEN {snap_sql('((chips - CASE WHEN villain_total > 0 THEN villain_total ELSE to_call END) / to_call)', X.RAISES)} END AS action FROM v), a AS (SELECT hand_id, action, sum(freq) AS p FROM m WHERE action IS NOT NULL GROUP BY hand_id, action)
SELECT hand_id, action, round(p / sum(p) OVER (PARTITION BY hand_id), 5) AS p FROM a"""))
def f21_map_solver_actions(spark, d):
    good = G.map_solver_actions(spark.sql(SOLVE.replace("FROM moves", "FROM {moves}"), moves=role(spark, d, "moves")), "hand_id")[0]
    return good.select("hand_id", "action", d5("p"))


@query(with_roles("SELECT hand_id, round(arg_max(amount, seq) / 40.0, 5) AS facing FROM moves GROUP BY hand_id"))
def f25_facing_size(spark, d):
    token = F.concat_ws(":", "actor", "action", "amount")
    line = role(spark, d, "moves").groupBy("hand_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", token.alias("t")))), lambda x: x["t"]), " ").alias("line"))
    return line.select("hand_id", F.round(X.facing_size(F.col("line"), F.lit(40.0)), 5).alias("facing"))


@query(with_roles(f"""WITH {SCENARIO_SQL}, b AS (SELECT hand_id, list_transform(range(2, 5), lambda k: (l_partkey * 7 + k * (l_suppkey % 7 + 4)) % 52) AS b, CAST(round(stack_after / 1000) AS BIGINT) AS stack FROM moves WHERE seq = 0),
f AS (SELECT hand_id, any_value(stack) AS stack, min({form_sql('b')}) AS flop FROM b, (SELECT unnest([{TURNS}]) AS p) GROUP BY hand_id), s AS (SELECT flop, stack, scenario, f.hand_id FROM f JOIN sc ON sc.hand_id = f.hand_id), c AS (SELECT *, count(*) OVER w AS n, (row_number() OVER (w ORDER BY hand_id) - 1) // 1000 AS chunk FROM s WINDOW w AS (PARTITION BY flop, stack, scenario))
SELECT flop, stack, scenario, n, chunk, string_agg(hand_id, ',' ORDER BY hand_id) AS items FROM c GROUP BY flop, stack, scenario, n, chunk"""))
def f29_flop_spots(spark, d):
    """Work grouped by canonical flop and role configuration."""
    flop = F.array(*[C.card(F.expr(f"((l_partkey * 7 + {k} * (l_suppkey % 7 + 4)) % 52)")) for k in (2, 3, 4)])
    first = role(spark, d, "moves").where("seq = 0").select("hand_id", C.canonical_board(flop).alias("flop"), F.round(F.col("stack_after") / 1000).cast("long").alias("stack"))
    keyed = first.join(G.scenario_keys(G.preflop_roles(ordered_moves(spark, d)), "BTN"), "hand_id")
    return K.group_spots(keyed, ["flop", "stack", "scenario"], "hand_id").select("flop", "stack", "scenario", "n", "chunk", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(with_roles("SELECT actor, street, round(avg(CASE WHEN actor IN ('CO', 'BTN') THEN 1.0 ELSE 0.0 END), 5) AS late, round(avg(list_position(['SB', 'BB', 'UTG', 'MP', 'CO', 'BTN'], actor) / 6.0), 5) AS ordinal, count(*) AS n FROM moves GROUP BY actor, street"))
def f30_position_blocks(spark, d):
    """Seat encodings side by side: one-hot of the late seats, and the order of acting."""
    late = F.col("actor").isin("CO", "BTN").cast("double")
    ordinal = E.rank_in(E.AFTER_FLOP, F.col("actor")) / 6.0
    return role(spark, d, "moves").groupBy("actor", "street").agg(F.round(F.avg(late), 5).alias("late"), F.round(F.avg(ordinal), 5).alias("ordinal"), F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT id, count(*) OVER (PARTITION BY part, action) AS n FROM corpus"))
def p01_same_partition(spark, d):
    """Rows of each row's partition: counted by key first, so the join is linear."""
    c = role(spark, d, "corpus").select("id", "part", "action")
    counts = c.groupBy("part", "action").agg(F.count(F.lit(1)).alias("n"))
    return c.alias("l").join(counts.alias("r"), P.same_partition("l", "r", ["part", "action"])).select("l.id", "r.n")


NODE = "SELECT cluster_key, arg_max(locked, created_at) AS locked, arg_max(source, created_at) AS source FROM nodes WHERE active GROUP BY cluster_key"


@query(with_roles(f"WITH n AS ({NODE}) SELECT m.cluster_key, count(*) AS sessions FROM metrics m LEFT JOIN n ON n.cluster_key = m.cluster_key WHERE m.cluster_key NOT IN (SELECT cluster_key FROM suppressions WHERE active) AND NOT coalesce(n.locked OR n.source = 'building', FALSE) GROUP BY m.cluster_key"))
def p08_eligible(spark, d):
    got = R.eligible(role(spark, d, "metrics"), role(spark, d, "nodes"), role(spark, d, "suppressions"), ("building",))
    return got.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("sessions"))


@query(with_roles("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY hand_id ORDER BY amount DESC, seq) AS r, lag(amount) OVER (PARTITION BY hand_id, street ORDER BY seq) AS facing FROM moves)
SELECT hand_id, seq, CASE WHEN street = 'preflop' THEN CASE WHEN coalesce(facing, 0) <= 0 THEN 4 ELSE 6 END WHEN coalesce(facing, 0) <= 0 THEN 9 ELSE 7 END::BIGINT AS n_legal FROM m WHERE r = 1"""))
def c08_gap_detail(spark, d):
    """One spot per hand with what is legal there."""
    df = E.with_facing(ordered_moves(spark, d))
    first = R.latest_n(df, ["hand_id"], [F.desc("amount"), F.asc("seq")], 1)
    return first.select("hand_id", F.col("seq").cast("long").alias("seq"), F.size(X.legal_actions(F.col("street"), F.col("facing_size"))).cast("long").alias("n_legal"))


@query(with_roles(f"""WITH ov AS ({OBSVEC}), f AS ({FREQ}), best AS (SELECT cluster_key, arg_min(action, (-p, action)) AS action FROM f GROUP BY cluster_key), q AS (SELECT cluster_key, max(obs_id) AS obs_id, {NUMBER} AS k FROM obs GROUP BY cluster_key),
z AS (SELECT avg(CAST(vec[1] AS DOUBLE)) AS m, stddev_pop(CAST(vec[1] AS DOUBLE)) AS s FROM corpus)
SELECT q.cluster_key, CASE WHEN k % 3 = 0 THEN 'sum' WHEN k % 4 = 1 THEN 'node' ELSE 'corpus' END AS outcome, CASE WHEN k % 3 <> 0 AND k % 4 <> 1 THEN best.action END AS action,
 CASE WHEN k % 3 <> 0 AND k % 4 <> 1 THEN round((CAST(vec[1] AS DOUBLE) - m) / s, 3) END AS z1, o.sparse AND k % 3 = 0 AS still_open FROM q JOIN best ON best.cluster_key = q.cluster_key JOIN ov ON ov.id = q.obs_id JOIN obs o ON o.obs_id = q.obs_id, z"""))
def c09_resolve_gaps(spark, d):
    """An answer for each cluster's last row: some do not sum to 1, some vectors have the wrong size."""
    corpus, number = role(spark, d, "corpus"), F.substring("cluster_key", 2, 9).cast("int")
    shares = S.action_freq(role(spark, d, "obs"), ["cluster_key"]).groupBy("cluster_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "p")))).alias("dist"))
    shares = shares.withColumn("dist", F.when(number % 3 == 0, F.transform_values("dist", lambda k, v: v / 2)).otherwise(F.col("dist")))
    asked = role(spark, d, "obs").groupBy("cluster_key").agg(F.max("obs_id").alias("decision_id")).join(shares, "cluster_key").select(F.col("decision_id").alias("patch_id"), "decision_id", "dist")
    vec = F.when(number % 4 == 1, F.slice("vec", 1, 63)).otherwise(F.col("vec"))
    obs = obs_vectors(spark, d).select(F.col("id").alias("decision_id"), "cluster_key", vec.alias("vec")).join(role(spark, d, "obs").select(F.col("obs_id").alias("decision_id"), "sparse"), "decision_id")
    base = corpus.select("id", "vec", "action", F.col("confidence").cast("double").alias("confidence"), "added_at", "removed_at", "active")
    got = K.resolve_gaps(asked, obs, base, S.manifest(S.fit_zscore(corpus, "vec")), ["view", "click", "purchase", "signup", "error"], 10**7)
    new = got["corpus"].where(F.col("added_at") == 10**7).select(F.col("id").alias("decision_id"), "action", F.round(F.col("vec")[0].cast("double"), 3).alias("z1"))
    said = got["nodes"].select(F.substring("node_id", 2, 19).cast("long").alias("decision_id")).join(new, "decision_id", "left").withColumn("outcome", F.when(F.col("action").isNull(), "node").otherwise("corpus"))
    none = got["rejected"].select("decision_id", F.lit(None).cast("string").alias("action"), F.lit(None).cast("double").alias("z1"), F.col("reason").alias("outcome"))
    flags = got["obs"].select("decision_id", "cluster_key", F.col("sparse").alias("still_open"))
    return said.unionByName(none).join(flags, "decision_id").select("cluster_key", "outcome", "action", "z1", "still_open")


@query(with_roles("""WITH f AS (SELECT cluster_key, action, count(*) AS n FROM obs GROUP BY cluster_key, action), b AS (SELECT cluster_key, arg_max(action, (n, action)) AS action FROM f GROUP BY cluster_key), s AS (SELECT cluster_key, arg_max(exploitability, (solved_at, solve_id)) AS x FROM solves GROUP BY cluster_key)
SELECT s.cluster_key, b.action, round(greatest(0, 1 - x / 100), 6) AS gto_score, -1::BIGINT AS spr FROM s JOIN b ON b.cluster_key = s.cluster_key"""))
def c13_ingest_solves(spark, d):
    p = S.action_freq(role(spark, d, "obs"), ["cluster_key"])
    newest = R.latest(role(spark, d, "solves"), ["cluster_key"], ["solved_at", "solve_id"]).withColumn("spr", F.lit(None).cast("long"))
    vectors = role(spark, d, "corpus").groupBy(F.concat(F.lit("c"), F.col("id") % 40).alias("cluster_key")).agg(F.max_by("vec", "id").alias("vec"))
    good, _ = G.ingest_solves(p, newest, vectors, "cluster_key", 64)
    return good.select("cluster_key", "action", F.round("gto_score", 6).alias("gto_score"), "spr")


@query(with_roles(f"""WITH {REB}, rb AS (SELECT cluster_key, action, sum(prob) / sum(sum(prob)) OVER (PARTITION BY cluster_key) AS p FROM j GROUP BY cluster_key, action), best AS (SELECT cluster_key, arg_min(action, (-p, action)) AS action FROM rb GROUP BY cluster_key),
n AS ({NODE}), le AS (SELECT m.session_id, m.cluster_key, row_number() OVER (PARTITION BY session_id ORDER BY m.value * ln(greatest(m.n, 2)) DESC, m.cluster_key) AS r FROM metrics m LEFT JOIN n ON n.cluster_key = m.cluster_key
 WHERE m.value > 0.3 AND m.n >= 5 AND m.cluster_key NOT IN (SELECT cluster_key FROM suppressions WHERE active) AND NOT coalesce(n.locked OR n.source = 'seed', FALSE)), ca AS (SELECT DISTINCT cluster_key FROM le WHERE r <= 5),
b AS (SELECT cluster_key, action, row_number() OVER (PARTITION BY cluster_key ORDER BY ts, obs_id) AS k FROM obs WHERE source = 'hh'), c AS (SELECT o.cluster_key, CASE WHEN CAST(substr(o.cluster_key, 2) AS INTEGER) % 2 = 0 THEN best.action ELSE o.action END AS action, row_number() OVER (PARTITION BY o.cluster_key ORDER BY ts, obs_id) AS k FROM obs o LEFT JOIN best ON best.cluster_key = o.cluster_key WHERE source = 'sim'),
x AS (SELECT b.cluster_key, ln(coalesce(y.p, 0) + 1e-6) - ln(coalesce(x.p, 0) + 1e-6) AS delta, x.p IS NOT NULL AND y.p IS NOT NULL AS hit FROM b JOIN c ON b.cluster_key = c.cluster_key AND b.k = c.k LEFT JOIN rb x ON x.cluster_key = b.cluster_key AND x.action = b.action LEFT JOIN rb y ON y.cluster_key = b.cluster_key AND y.action = c.action),
g AS (SELECT cluster_key, avg(delta) AS mean_delta FROM x GROUP BY cluster_key HAVING bool_or(hit) AND avg(delta) - 1.96 * sqrt(var_samp(delta) / count(*)) > 0), ok AS (SELECT g.* FROM g JOIN ca ON ca.cluster_key = g.cluster_key JOIN best ON best.cluster_key = g.cluster_key)
SELECT ok.cluster_key, best.action, round(ok.mean_delta, 5) AS mean_delta, (SELECT count(*) FROM nation) + 1 AS versions FROM ok JOIN best ON best.cluster_key = ok.cluster_key"""))
def c15_improve_cycle(spark, d):
    """Leak candidates, their rebalanced blends, the gain of a run that plays them in every other cluster, and the patches."""
    from decilog.operators import blend as B
    from decilog.session import table

    obs, corpus = role(spark, d, "obs"), role(spark, d, "corpus")
    leaks = R.leak_candidates(role(spark, d, "metrics"), role(spark, d, "nodes"), role(spark, d, "suppressions"), min_obs=5, barred=("seed",))
    vectors = obs_vectors(spark, d)
    blends = B.rebalance(vectors, corpus.where("active"), ["part"])
    best = blends.groupBy("cluster_key").agg(F.min_by("action", F.struct(-F.col("prob"), "action")).alias("best"))
    even = F.substring("cluster_key", 2, 9).cast("int") % 2 == 0
    newer = obs.where("source = 'sim'").join(best, "cluster_key", "left").withColumn("action", F.when(even, F.col("best")).otherwise(F.col("action")))
    pairs = S.pair_runs(obs.where("source = 'hh'"), newer, "cluster_key", ["ts", "obs_id"])
    deltas = S.with_ci(S.paired_deltas(pairs, blends.withColumnRenamed("prob", "p"), "cluster_key"), "mean_delta", "var_delta")
    last = vectors.groupBy("cluster_key").agg(F.max_by(F.struct("id", "vec"), F.struct("ts", "id")).alias("s")).select("cluster_key", (F.col("s.id") + 10**9).alias("id"), "s.vec")
    versions = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("version"), (F.col("n_nationkey") * 40).cast("long").alias("cutoff_ts"), F.lit("auto").alias("source"), F.col("n_name").alias("label"))
    base = corpus.select("id", "vec", "action", F.col("confidence").cast("double").alias("confidence"), "added_at", "removed_at", "active")
    got = K.improve_cycle(leaks, blends, deltas, last, base, versions, 10**7, "cycle")
    rows = got["corpus"].where(F.col("added_at") == 10**7).select("id", "action")
    count = got["versions"].agg(F.count(F.lit(1)).alias("versions"))
    return got["patches"].select("cluster_key", "id", d5("mean_delta")).join(rows, "id").join(F.broadcast(count), how="cross").select("cluster_key", "action", "mean_delta", "versions")


EVENT = T.StructType([T.StructField("actor", T.StringType()), T.StructField("action", T.StringType()), T.StructField("amount", T.LongType())])


@query(with_roles("SELECT street, actor, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM moves GROUP BY street, actor"))
def s01_read_hand_events(spark, d):
    """Hands as nested JSON lines, read under a fixed schema and exploded."""
    event = F.struct("seq", "actor", "action", "amount")
    street = lambda s: F.array_sort(F.collect_list(F.when(F.col("street") == s, event))).alias(s)
    path = io.work_dir(spark, "hands")
    role(spark, d, "moves").groupBy("hand_id").agg(*map(street, E.STREETS)).write.json(path)
    schema = T.StructType([T.StructField("hand_id", T.LongType()), *[T.StructField(s, T.ArrayType(EVENT)) for s in E.STREETS]])
    rows = E.explode_events(io.read_json_lines(spark, path, schema), E.STREETS)
    return rows.groupBy("street", "actor").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(with_roles("SELECT part, count(*) AS n, CAST(max(len(vec)) AS INTEGER) AS dims FROM corpus GROUP BY part"))
def s10_write_embeddings(spark, d):
    path = io.work_dir(spark, "embeddings")
    io.write_partitioned(role(spark, d, "corpus").select("id", "vec", "part"), path, "part", 10_000)
    return spark.read.schema("id long, vec array<float>, part int").parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"))
