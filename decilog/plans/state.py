"""Queries of keyed updates, patches, versions and gap queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.operators import corpus as K
from decilog.operators import stats as S
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.plans.stats import r4
from decilog.session import table


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT l_orderkey, NULL, round(arg_max(l_extendedprice, l_partkey * 100000 + l_suppkey), 2) FROM lineitem WHERE l_discount > 0.08 GROUP BY l_orderkey""")
def s13_upsert_latest(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v"), F.lit(0).cast("long").alias("ord"))
    lines = table(spark, d, "lineitem").where("l_discount > 0.08")
    new = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"), F.col("l_extendedprice").alias("v"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"))
    return K.upsert_latest(base, new, ["o_orderkey"], "ord").select("o_orderkey", "o_custkey", F.round("v", 2).alias("v"))


@query(with_roles("""WITH b AS (SELECT session_id, CASE WHEN cluster_key = 'c3' THEN NULL ELSE cluster_key END AS cluster_key, 'base' AS src FROM metrics WHERE cluster_key < 'c4'),
n AS (SELECT session_id, CASE WHEN cluster_key = 'c3' THEN NULL ELSE cluster_key END AS cluster_key, 'new' AS src FROM metrics WHERE cluster_key < 'c7')
SELECT * FROM b UNION ALL SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.session_id = n.session_id AND b.cluster_key IS NOT DISTINCT FROM n.cluster_key)"""))
def s14_insert_ignore(spark, d):
    m = role(spark, d, "metrics").select("session_id", "cluster_key")
    blank = F.when(F.col("cluster_key") == "c3", F.lit(None)).otherwise(F.col("cluster_key"))
    make = lambda top, src: m.where(F.col("cluster_key") < top).select("session_id", blank.alias("cluster_key"), F.lit(src).alias("src"))
    return K.insert_ignore(make("c4", "base"), make("c7", "new"), ["session_id", "cluster_key"], "src")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT p_partkey, p_type, p_size + 100 FROM part WHERE p_type = 'PROMO'")
def s15_replace_slice(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return K.replace_slice(p, p.withColumn("p_size", F.col("p_size") + 100), F.col("p_type") == "PROMO")


@query(with_roles("SELECT session_id, count(*) AS n FROM obs WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY session_id"))
def s17_retention(spark, d):
    kept = K.apply_retention(role(spark, d, "obs"), "ts", F.to_timestamp(F.lit("2024-01-31 00:00:00")), 10)
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def targeted(patches, corpus):
    """Patches with the id of the corpus row that they change."""
    size = corpus.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return patches.join(F.broadcast(size), how="cross").withColumn("id", F.col("patch_id") % F.col("_n")).drop("_n")


def requests(spark, d):
    """Every patch as a request: the action shares of its cluster, for the vector of its number modulo the corpus."""
    f = S.action_freq(role(spark, d, "obs"), ["cluster_key"]).groupBy("cluster_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "p")))).alias("dist"))
    vec = role(spark, d, "corpus").select("id", "vec")
    p = targeted(role(spark, d, "patches"), vec).select("patch_id", "cluster_key", "id")
    return p.join(f, "cluster_key").join(vec, "id")


def patched(spark, d):
    base = role(spark, d, "corpus").select("id", "vec", "action", F.col("confidence").cast("double").alias("confidence"), "added_at", "removed_at", "active")
    return K.apply_patches(base, requests(spark, d), 900, 0.911)


@query(with_roles("""WITH f AS (SELECT cluster_key, arg_min(action, (-n, action)) AS best FROM (SELECT cluster_key, action, count(*) AS n FROM obs GROUP BY cluster_key, action) GROUP BY cluster_key),
r AS (SELECT patch_id % (SELECT count(*) FROM corpus) AS id, arg_max(best, patch_id) AS best FROM patches p JOIN f ON f.cluster_key = p.cluster_key GROUP BY 1)
SELECT c.id, coalesce(r.best, c.action) AS action, CASE WHEN r.id IS NOT NULL THEN 900 ELSE added_at END AS added_at, CASE WHEN r.id IS NOT NULL THEN 0 ELSE removed_at END AS removed_at, r.id IS NOT NULL OR active AS active FROM corpus c LEFT JOIN r ON r.id = c.id"""))
def c01_apply_patches(spark, d):
    return patched(spark, d)[0].select("id", "action", "added_at", "removed_at", "active")


#: Manual patches are taken back; negative customer numbers are patches that no one made.
ROLL = """q AS (SELECT patch_id FROM patches WHERE source = 'manual' UNION SELECT -created_at - 1 FROM nodes)"""


def rolled(spark, d):
    corpus, nodes = role(spark, d, "corpus"), role(spark, d, "nodes")
    p = targeted(role(spark, d, "patches"), corpus)
    asked = p.where("source = 'manual'").select("patch_id").unionByName(nodes.select((-F.col("created_at") - 1).alias("patch_id")))
    return K.rollback(p, nodes, corpus, asked, 950)


@query(with_roles(f"""WITH {ROLL} SELECT q.patch_id, CASE WHEN p.status IS NULL THEN 'unknown' ELSE 'already rolled back' END AS reason FROM q LEFT JOIN patches p ON p.patch_id = q.patch_id WHERE p.status IS NULL OR p.status = 'rolled_back'"""))
def c02_rollback_rejected(spark, d):
    return rolled(spark, d)[3]


@query(with_roles(f"""WITH {ROLL}, g AS (SELECT DISTINCT p.patch_id % (SELECT count(*) FROM corpus) AS id FROM q JOIN patches p ON p.patch_id = q.patch_id WHERE p.status = 'applied') SELECT c.id, c.active AND g.id IS NULL AS active, CASE WHEN g.id IS NOT NULL THEN 950 ELSE removed_at END AS removed_at FROM corpus c LEFT JOIN g ON g.id = c.id"""))
def c02_rollback_corpus(spark, d):
    return rolled(spark, d)[2].select("id", "active", "removed_at")


@query(with_roles("SELECT node_id, CASE WHEN active AND cluster_key IN (SELECT cluster_key FROM suppressions) THEN TRUE ELSE locked END AS locked FROM nodes"))
def c03_set_lock(spark, d):
    asked = role(spark, d, "suppressions").select("cluster_key", F.lit(True).alias("lock"), F.col("ts").alias("k"))
    return K.set_lock(role(spark, d, "nodes"), asked).select("node_id", "locked")


@query(with_roles("""WITH s AS (SELECT *, active AND cluster_key NOT IN (SELECT cluster_key FROM obs WHERE value > 450) AS live FROM suppressions) SELECT k.cluster_key, bool_or(coalesce(s.live, FALSE)) AS suppressed FROM (SELECT DISTINCT cluster_key FROM nodes) k LEFT JOIN s ON s.cluster_key = k.cluster_key GROUP BY k.cluster_key"""))
def c04_suppressions(spark, d):
    left = K.unsuppress(role(spark, d, "suppressions"), role(spark, d, "obs").where("value > 450"))
    return K.is_suppressed(role(spark, d, "nodes").select("cluster_key").distinct(), left)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS version, n_nationkey * 40 AS cutoff_ts, TRUE AS known FROM nation UNION ALL SELECT 25, 999, TRUE UNION ALL SELECT 26, NULL, FALSE")
def c05_versions(spark, d):
    n = table(spark, d, "nation")
    v = n.select(F.col("n_nationkey").cast("long").alias("version"), (F.col("n_nationkey") * 40).cast("long").alias("cutoff_ts"), F.lit("auto").alias("source"), F.col("n_name").alias("label"))
    more = K.snapshot(v, 999, "manual", "now")
    asked = more.select("version").unionByName(more.agg((F.max("version") + 1).alias("version")))
    return K.resolve(asked, more)


@query(with_roles("""WITH p AS (SELECT id, added_at <= 150 AND (removed_at = 0 OR removed_at > 150) AS o, added_at <= 420 AND (removed_at = 0 OR removed_at > 420) AS n FROM corpus) SELECT id, CASE WHEN n THEN 'added' ELSE 'removed' END AS change FROM p WHERE o <> n"""))
def c06_version_diff(spark, d):
    return K.version_diff(role(spark, d, "corpus"), 150, 420)


GAP = "SELECT obs_id, user_id % 7 AS n_opp, distance, sparse, 'd' || (obs_id % 400) AS decision_id FROM obs"


@query(with_roles(f"""WITH g AS ({GAP}), r AS (SELECT DISTINCT 'd' || (obs_id % 400) AS decision_id FROM obs WHERE value > 300), f AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY distance DESC NULLS LAST, obs_id) AS k FROM g WHERE decision_id NOT IN (SELECT decision_id FROM r) AND n_opp < 2)
SELECT obs_id, decision_id, round(distance, 4) AS distance FROM f WHERE k = 1 AND sparse ORDER BY distance DESC NULLS LAST, obs_id LIMIT 50"""))
def c07_gap_queue(spark, d):
    o = role(spark, d, "obs").withColumns({"n_opp": F.col("user_id") % 7, "decision_id": F.concat(F.lit("d"), F.col("obs_id") % 400)})
    return K.gap_queue(o, o.where("value > 300"), F.col("n_opp") >= 2).select("obs_id", "decision_id", *r4("distance"))


@query(with_roles("""WITH m AS (SELECT obs_id AS decision_id FROM obs WHERE sparse) SELECT count(*) AS left_over FROM m WHERE decision_id NOT IN (SELECT obs_id FROM obs WHERE user_id % 3 = 0 AND user_id % 7 < 2)"""))
def c10_requeue(spark, d):
    o = role(spark, d, "obs")
    marks = o.where("sparse").select(F.col("obs_id").alias("decision_id"))
    asked = o.where("user_id % 3 = 0").select(F.col("obs_id").alias("decision_id"), (F.col("user_id") % 7).alias("n"))
    return K.requeue(marks, asked, F.col("n") >= 2)[0].agg(F.count(F.lit(1)).alias("left_over"))


@query(with_roles("""SELECT k.cluster_key, CASE WHEN k.cluster_key NOT IN (SELECT cluster_key FROM nodes WHERE active) THEN 'no active node' WHEN k.cluster_key NOT IN (SELECT cluster_key FROM obs) THEN 'no observation' ELSE 'ok' END AS outcome FROM (SELECT DISTINCT 'c' || (id % 30) AS cluster_key FROM corpus) k"""))
def c11_manual_edits(spark, d):
    asked = role(spark, d, "corpus").select(F.concat(F.lit("c"), F.col("id") % 30).alias("cluster_key")).distinct()
    good, bad = K.manual_edits(asked, role(spark, d, "nodes"), role(spark, d, "obs"))
    return good.select("cluster_key", F.lit("ok").alias("outcome")).unionByName(bad.select("cluster_key", F.col("reason").alias("outcome")))


@query(with_roles("SELECT street, actor, action, count(*) AS n, min(hand_id) AS first_item FROM moves GROUP BY street, actor, action"))
def c12_group_spots(spark, d):
    got = K.group_spots(role(spark, d, "moves"), ["street", "actor", "action"], "hand_id")
    return got.where("chunk = 0").select("street", "actor", "action", "n", F.get("items", F.lit(0)).alias("first_item"))


@query(with_roles("""WITH p AS (SELECT street, actor, action, hand_id, (row_number() OVER (PARTITION BY street, actor, action ORDER BY hand_id) - 1) // 1000 AS chunk, count(*) OVER (PARTITION BY street, actor, action) AS n FROM moves)
SELECT street, actor, action, chunk, any_value(n) AS n, count(*) AS listed, min(hand_id) AS first_item, max(hand_id) AS last_item, CAST(sum(hand_id) AS BIGINT) AS total FROM p GROUP BY street, actor, action, chunk"""))
def c12_spot_chunks(spark, d):
    """Every chunk of every spot: together they hold all items."""
    got = K.group_spots(role(spark, d, "moves"), ["street", "actor", "action"], "hand_id")
    items = F.col("items")
    total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("street", "actor", "action", "chunk", "n", F.size(items).cast("long").alias("listed"), F.array_min(items).alias("first_item"), F.array_max(items).alias("last_item"), total.alias("total"))


@query(with_roles("""WITH s AS (SELECT session_id, avg(value) AS v FROM metrics GROUP BY session_id), l AS (SELECT *, v - lag(v) OVER (ORDER BY session_id) AS up FROM s) SELECT session_id, v > 0.3 * 1.6 OR coalesce(up > 0.02, FALSE) AS pause FROM l"""))
def c16_pause_flags(spark, d):
    trend = role(spark, d, "metrics").groupBy("session_id").agg(F.avg("value").alias("v"))
    return K.pause_flags(trend, "v", "session_id", floor=0.24, jump=0.02).select("session_id", "pause")


@query(with_roles("SELECT count(*) AS backlog FROM obs WHERE sparse AND cluster_key NOT IN (SELECT cluster_key FROM suppressions WHERE active)"))
def c17_backlog(spark, d):
    return K.backlog(role(spark, d, "obs"), role(spark, d, "suppressions").where("active"))


@query(with_roles("SELECT p.patch_id, CASE WHEN n.node_id IS NULL THEN 'no node' WHEN n.cluster_key <> p.cluster_key THEN 'other cluster' ELSE 'ok' END AS \"check\" FROM patches p LEFT JOIN nodes n ON n.node_id = p.new_node_id"))
def c18_patch_ab_input(spark, d):
    return K.patch_ab_input(role(spark, d, "patches"), role(spark, d, "nodes")).select("patch_id", "check")


@query(with_roles("""WITH t AS (SELECT opponent, avg(bb_delta) AS m, avg(bb_delta) - 1.96 * stddev_samp(bb_delta) / sqrt(count(*)) AS lo, count(*) FILTER (WHERE status = 'completed') = 0 AS z FROM payoffs GROUP BY opponent) SELECT opponent FROM t WHERE NOT z AND lo > 0"""))
def c14_accept(spark, d):
    t = role(spark, d, "payoffs").groupBy("opponent").agg(F.avg("bb_delta").alias("mean"), (F.var_samp("bb_delta") / F.count(F.lit(1))).alias("v"), (F.count_if(F.col("status") == "completed") == 0).alias("zero_hits"))
    return K.accept(S.with_ci(t, "mean", "v")).select("opponent")
