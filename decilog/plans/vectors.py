"""Queries of neighbours, blends and evaluations over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.functions import features as X
from decilog.functions import predicates as P
from decilog.operators import blend as B
from decilog.operators import evaluate as E
from decilog.operators import knn as K
from decilog.operators import stats as S
from decilog.plans.bindings import role, with_roles
from decilog.plans.registry import query
from decilog.plans.stats import FREQ

def snap_sql(x: str, buckets) -> str:
    pairs = ", ".join(f"{{'d': abs({x} - {v}), 'k': {k}, 'name': '{n}'}}" for k, (v, n) in enumerate(buckets))
    return f"list_min([{pairs}]).name"


COS = "list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[]))"


def nb_sql(where: str = "c.active", queries: str = "corpus", corpus: str = "corpus", k: int = 10, on: str = "c.part = q.part") -> str:
    return f"SELECT * FROM (SELECT q.id AS query, c.id AS nb, 1 - {COS} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY 1 - {COS}, c.id) AS rank FROM {queries} q JOIN {corpus} c ON {on} AND c.id <> q.id WHERE {where}) WHERE rank <= {k}"


def corpus_of(spark, d):
    return role(spark, d, "corpus")


def neighbours(spark, d, k=10):
    df = corpus_of(spark, d)
    return K.knn(df, df.where(P.is_live(F.col("active"))), ["part"], k)


def d5(c="distance"):
    return F.round(c, 5).alias(c)


NB = nb_sql()
BLEND = f"""nb AS ({NB}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action),
bl AS (SELECT query, action, w / sum(w) OVER (PARTITION BY query) AS prob FROM v WHERE w > 0)"""


@query(with_roles(f"SELECT query, nb, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM ({NB})"))
def n01_knn(spark, d):
    return neighbours(spark, d).select("query", "nb", d5(), "rank")


@query(with_roles(f"SELECT query, nb, CAST(rank AS INTEGER) AS rank FROM ({nb_sql('c.added_at <= 400 AND (c.removed_at = 0 OR c.removed_at > 400)', k=5)})"))
def p03_knn_as_of(spark, d):
    df = corpus_of(spark, d)
    then = df.where(P.as_of(F.col("added_at"), F.col("removed_at"), F.lit(400)))
    return K.knn(df, then, ["part"], 5).select("query", "nb", "rank")


@query(with_roles(f"SELECT query, nb, CAST(rank AS INTEGER) AS rank FROM ({nb_sql('c.spr BETWEEN greatest(0, floor(q.spr * 0.5)) AND floor(q.spr * 1.5)', k=5)})"))
def p04_knn_in_band(spark, d):
    df = corpus_of(spark, d)
    return K.knn(df, df, ["part"], 5, band="spr").select("query", "nb", "rank")


@query(with_roles("SELECT a.id AS a, CAST(sum(b.n) AS BIGINT) AS others FROM corpus a JOIN (SELECT part, action, count(*) AS n FROM corpus WHERE active GROUP BY part, action) b ON a.part = b.part AND a.action <> b.action GROUP BY a.id"))
def p05_not_same_cluster(spark, d):
    """Live rows of each row's partition outside its cluster: counted by cluster first, so a row meets clusters, not rows."""
    df = corpus_of(spark, d).select("id", "part", "action", "active")
    counts = df.where("active").groupBy("part", "action").agg(F.count(F.lit(1)).alias("n"))
    pairs = df.alias("l").join(counts.alias("r"), (F.col("l.part") == F.col("r.part")) & P.not_same_cluster("l", "r", ["part", "action"]))
    return pairs.groupBy(F.col("l.id").alias("a")).agg(F.sum("r.n").alias("others"))


@query(with_roles("SELECT part, count(*) FILTER (WHERE active) AS live, count(*) AS n FROM corpus GROUP BY part"))
def p02_is_live(spark, d):
    return corpus_of(spark, d).groupBy("part").agg(F.count_if(P.is_live(F.col("active"))).alias("live"), F.count(F.lit(1)).alias("n"))


@query()
def n02_knn_lsh(spark, d):
    df = corpus_of(spark, d)
    return K.knn_lsh(df, df.where("active"), ["part"], 10).select("query", "nb", d5(), "rank")


@query(with_roles("SELECT count(*) AS queries, TRUE AS recalled FROM corpus WHERE id % 100 = 0"))
def n02_knn_cells(spark, d):
    """Recall of the approximate neighbours against the exact ones: every hundredth row against all."""
    df = corpus_of(spark, d)
    asked, live = df.where("id % 100 = 0"), df.where("active")
    near = K.knn_cells(asked, live, ["part"], K.fit_cells(live, keys=["part"]), 10).select("query", "nb")
    exact = K.knn(asked, live, ["part"], 10).select("query", "nb")
    hit = exact.join(near.withColumn("hit", F.lit(1.0)), ["query", "nb"], "left").agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    return hit.select("queries", (F.col("recall") >= 0.9).alias("recalled"))


@query()
def n02_kept_index(spark, d):
    """Recall of the kept index for every hundredth row, as built, after an addition, after removals and a split, and as of an earlier time."""
    from decilog.operators.index import VectorIndex
    from decilog.sources.io import work_dir

    df = corpus_of(spark, d)
    first, more, out = df.where("id % 5 <> 0"), df.where("id % 5 = 0"), df.where("removed_at > 0").select("id")
    index = VectorIndex.build(first, work_dir(spark, "index"), ["part"], recall=0.98)
    asked = df.where("id % 100 = 0")
    size = df.count()

    def recall(step: str, rows, **kw):
        exact = K.knn(asked, rows, ["part"], 10).select("query", "nb")
        hit = exact.join(index.search(asked, 10, **kw).select("query", "nb").withColumn("hit", F.lit(1.0)), ["query", "nb"], "left")
        return hit.agg(F.lit(step).alias("step"), F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("recall")).withColumns({"version": F.lit(index.version()), "cells": F.lit(len(index.cells()[0]))})

    steps = [recall("built", first)]
    index.add(more)
    steps.append(recall("added", df))
    index.remove(out, size)
    index.split(max(8, size // len(index.cells()[0])))
    steps += [recall("removed and split", df.join(out, "id", "left_anti")), recall("as of half", df.where(F.col("added_at") <= size // 2), at=size // 2)]
    whole = steps[0]
    for s in steps[1:]:
        whole = whole.unionByName(s)
    return whole


@query(with_roles(f"WITH {BLEND} SELECT query, action, round(prob, 5) AS prob FROM bl"))
def n03_blend(spark, d):
    return B.blend(neighbours(spark, d), corpus_of(spark, d)).select("query", "action", d5("prob"))


VOCABULARY = sorted({name for names in X.LEGAL.values() for name in names})
SNAPPED = f"""CASE WHEN a IN ('bet', 'raise') AND allin THEN 'allin' WHEN a = 'bet' THEN CASE WHEN size_frac >= 1.75 THEN 'bet_overbet' ELSE {snap_sql('size_frac', X.BETS)} END
 WHEN a = 'raise' THEN {snap_sql('coalesce(raise_ratio, 2.5)', X.RAISES)} ELSE a END"""
VOTES = f"""nv AS ({nb_sql(corpus='voters', queries='voters')}), gv AS (SELECT id, a, 1.0::DOUBLE AS share, size_frac, raise_ratio, allin FROM (SELECT *, action AS a FROM voters) WHERE id NOT IN (SELECT id FROM shares)
 UNION ALL SELECT v.id, s.action, s.share, size_frac, raise_ratio, allin FROM voters v JOIN shares s ON s.id = v.id WHERE s.share > 0), ok AS (SELECT * FROM (SELECT id, share, {SNAPPED} AS action FROM gv) WHERE action IN ({', '.join(f"'{x}'" for x in VOCABULARY)})),
rw AS (SELECT nv.query, nv.nb, greatest(0, 1 - distance) * confidence * gto_score AS w FROM nv JOIN voters ON voters.id = nv.nb WHERE distance < 1), tv AS (SELECT query, sum(w) AS t FROM rw WHERE nb IN (SELECT id FROM ok) GROUP BY query)"""


def voters(spark, d):
    """The corpus as raw labels with their sizes; a third of its rows with a distribution."""
    shares = role(spark, d, "shares").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("action", "share"))).alias("dist"))
    return role(spark, d, "voters").join(shares, "id", "left")


@query(with_roles(f"WITH {VOTES} SELECT rw.query, ok.action, round(sum(w * share) / any_value(t), 5) AS prob FROM rw JOIN ok ON ok.id = rw.nb JOIN tv ON tv.query = rw.query GROUP BY rw.query, ok.action"))
def n03_blend_distributions(spark, d):
    """Rows with a distribution split their weight over it; each label is snapped by its own row's size."""
    df = voters(spark, d)
    near = K.knn(df, df.where("active"), ["part"], 10)
    return B.blend(near, df, VOCABULARY, snap=lambda a: X.snap(a, F.col("size_frac"), F.col("raise_ratio"), F.col("allin"))).select("query", "action", d5("prob"))


REMAP = ({"error": "view", "signup": "view"}, {"view": "click"})


@query(with_roles(f"""WITH {BLEND}, l AS (SELECT query, CASE WHEN query % 2 = 0 AND action IN ('error', 'signup') THEN 'view' WHEN query % 2 = 1 AND action = 'view' THEN 'click' ELSE action END AS action, prob FROM bl)
SELECT query, action, round(sum(prob), 5) AS prob FROM l GROUP BY query, action"""))
def n04_legalise(spark, d):
    dist = B.blend(neighbours(spark, d), corpus_of(spark, d)).withColumn("facing", F.col("query") % 2)
    return B.legalise(dist, "query", "facing", *REMAP).select("query", "action", d5("prob"))


@query(with_roles(f"""WITH {BLEND}, ch AS (SELECT label, action, 0.6 AS freq FROM corpus WHERE label < 3 GROUP BY label, action UNION ALL SELECT label, 'other', 0.3 FROM corpus WHERE label < 3 GROUP BY label),
h AS (SELECT c.id, ch.action, ch.freq FROM corpus c JOIN ch ON ch.label = c.label)
SELECT id, action, round(freq, 5) AS prob, 'chart' AS source FROM h UNION ALL SELECT id, 'fold', round(1 - sum(freq), 5), 'chart' FROM h GROUP BY id
UNION ALL SELECT query, action, round(prob, 5), 'knn' FROM bl WHERE query NOT IN (SELECT id FROM h)"""))
def n05_decide(spark, d):
    df = corpus_of(spark, d)
    few = df.where("label < 3")
    charts = few.select("label", "action", F.lit(0.6).alias("freq")).distinct().unionByName(few.select("label", F.lit("other").alias("action"), F.lit(0.3).alias("freq")).distinct())
    return B.decide(df, charts, ["label"], B.blend(neighbours(spark, d), df)).select("id", "action", d5("prob"), "source")


@query(with_roles(f"""WITH {BLEND}, c AS (SELECT query, action, sum(prob) OVER (PARTITION BY query ORDER BY action) AS c, CAST(concat('0x', substr(md5(query || '|7'), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM bl)
SELECT query, arg_min(action, c) AS action FROM c WHERE c > u OR c >= 1 - 1e-12 GROUP BY query"""))
def n06_sample_actions(spark, d):
    return B.sample_actions(B.blend(neighbours(spark, d), corpus_of(spark, d)), "query", seed=7)


@query(with_roles(f"""WITH nb AS ({nb_sql('c.active', k=10, on='c.label = q.label')}), s AS (SELECT query, count(*) AS n, max(distance) AS m FROM nb GROUP BY query)
SELECT c.id, coalesce(n, 0) AS n, round(m, 5) AS max_distance, coalesce(n, 0) < 3 OR coalesce(m > 0.9, FALSE) AS sparse FROM corpus c LEFT JOIN s ON s.query = c.id"""))
def n07_sparseness(spark, d):
    df = corpus_of(spark, d)
    got = K.sparseness(K.knn(df, df.where("active"), ["label"], 10), df, tau=0.9)
    return got.select("id", "n", d5("max_distance"), F.coalesce("sparse", F.lit(False)).alias("sparse"))


CLUSTER = "SELECT 'c' || (id % 20) AS id, arg_max(vec, id) AS vec, 1 AS part FROM corpus GROUP BY 1"


def cluster_vectors(spark, d):
    key = F.concat(F.lit("c"), F.col("id") % 20).alias("cluster_key")
    return corpus_of(spark, d).groupBy(key).agg(F.max_by("vec", "id").alias("vec")).withColumn("part", F.lit(1))


@query(with_roles(f"""WITH cl AS ({CLUSTER}), nb AS ({nb_sql('TRUE', 'cl', 'cl', 5)}), o AS (SELECT cluster_key, count(*) AS n_obs FROM obs GROUP BY cluster_key)
SELECT query, nb, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank, coalesce(n_obs, 0) AS n_obs FROM nb LEFT JOIN o ON o.cluster_key = nb.nb"""))
def n09_similar(spark, d):
    return B.similar(cluster_vectors(spark, d), ["part"], role(spark, d, "obs"), 5).select("query", "nb", d5(), "rank", "n_obs")


OBSVEC = "SELECT o.obs_id AS id, o.cluster_key, o.ts, c.vec, c.part FROM obs o JOIN corpus c ON c.id = o.obs_id % (SELECT count(*) FROM corpus)"


def obs_vectors(spark, d):
    c = corpus_of(spark, d).select(F.col("id").alias("_id"), "vec", "part")
    size = c.agg(F.count(F.lit(1)).alias("_n"))  # one row
    o = role(spark, d, "obs").join(F.broadcast(size), how="cross").withColumn("_id", F.col("obs_id") % F.col("_n")).join(c, "_id")
    return o.select(F.col("obs_id").alias("id"), "cluster_key", "ts", "vec", "part")


REB = f"""ov AS ({OBSVEC}), nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY ts DESC, id DESC) AS r FROM ov) WHERE r <= 10),
nb AS ({nb_sql('c.active', 'nw', 'corpus', 10)}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action),
bl AS (SELECT query, action, w / sum(w) OVER (PARTITION BY query) AS prob FROM v WHERE w > 0), j AS (SELECT bl.*, nw.cluster_key FROM bl JOIN nw ON nw.id = bl.query)"""


@query(with_roles(f"""WITH {REB} SELECT cluster_key, action, round(sum(prob) / sum(sum(prob)) OVER (PARTITION BY cluster_key), 5) AS prob, (SELECT count(DISTINCT query) FROM j k WHERE k.cluster_key = j.cluster_key) AS n_blends FROM j GROUP BY cluster_key, action"""))
def n10_rebalance(spark, d):
    df = corpus_of(spark, d)
    return B.rebalance(obs_vectors(spark, d), df.where("active"), ["part"]).select("cluster_key", "action", d5("prob"), "n_blends")


EV = f"""ov AS ({OBSVEC}), nw AS (SELECT cluster_key AS id, arg_max(vec, (ts, id)) AS vec, arg_max(part, (ts, id)) AS part FROM ov GROUP BY cluster_key HAVING count(*) >= 10),
nb AS ({nb_sql('c.active', 'nw', 'corpus', 10, 'c.part = q.part AND CAST(c.id AS VARCHAR) <> q.id').replace(' AND c.id <> q.id', '')}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action),
bl AS (SELECT query, action, w / sum(w) OVER (PARTITION BY query) AS prob FROM v WHERE w > 0), f AS ({FREQ})"""


def ev_spots(spark, d):
    """Each cluster's newest observation (10 observations at least), and the corpus."""
    ov = obs_vectors(spark, d)
    newest = ov.groupBy("cluster_key").agg(F.max_by(F.struct("vec", "part"), F.struct("ts", "id")).alias("s"), F.count(F.lit(1)).alias("n"))
    newest = newest.where("n >= 10").select(F.col("cluster_key").alias("id"), "s.vec", "s.part")
    return newest, corpus_of(spark, d).withColumn("id", F.col("id").cast("string"))


def ev_parts(spark, d):
    """The blend at each cluster's newest observation."""
    newest, corpus = ev_spots(spark, d)
    return B.blend(K.knn(newest, corpus.where("active"), ["part"], 10), corpus).withColumnRenamed("query", "cluster_key")


@query(with_roles(f"""WITH {EV}, u AS (SELECT coalesce(f.cluster_key, bl.query) AS cluster_key, coalesce(f.p, 0) + 1e-6 AS p, coalesce(bl.prob, 0) + 1e-6 AS q FROM f FULL JOIN bl ON bl.query = f.cluster_key AND bl.action = f.action),
e AS (SELECT cluster_key, p / sum(p) OVER (PARTITION BY cluster_key) AS p, q / sum(q) OVER (PARTITION BY cluster_key) AS q FROM u WHERE cluster_key IN (SELECT query FROM bl))
SELECT cluster_key, round(sum(p * ln(p / q)), 5) AS ev_loss FROM e GROUP BY cluster_key"""))
def a18_ev_loss(spark, d):
    p = S.action_freq(role(spark, d, "obs"), ["cluster_key"])
    q = ev_parts(spark, d).withColumnRenamed("prob", "p")
    return S.kl(p, q, ["cluster_key"]).select("cluster_key", F.round("kl", 5).alias("ev_loss"))


START = "SELECT session_id, 20 * dayofyear(min(ts)) AS t0 FROM obs GROUP BY session_id"
SESSION = f"""ov AS (SELECT o.obs_id AS id, o.cluster_key, o.session_id, o.action, o.ts, c.vec, c.part, st.t0 FROM obs o JOIN corpus c ON c.id = o.obs_id % (SELECT count(*) FROM corpus) JOIN ({START}) st ON st.session_id = o.session_id),
nw AS (SELECT session_id || '|' || cluster_key AS id, arg_max(vec, (ts, id)) AS vec, arg_max(part, (ts, id)) AS part, any_value(t0) AS t0, count(*) AS n FROM ov GROUP BY session_id, cluster_key HAVING count(*) >= 10),
nb AS ({nb_sql('c.added_at <= q.t0 AND (c.removed_at = 0 OR c.removed_at > q.t0)', 'nw', 'corpus', 10).replace(' AND c.id <> q.id', '')}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action),
bl AS (SELECT query, action, w / sum(w) OVER (PARTITION BY query) AS prob FROM v WHERE w > 0),
f AS (SELECT session_id || '|' || cluster_key AS id, action, count(*) / CAST(sum(count(*)) OVER (PARTITION BY session_id, cluster_key) AS DOUBLE) AS p FROM ov GROUP BY session_id, cluster_key, action),
u AS (SELECT coalesce(f.id, bl.query) AS id, coalesce(f.p, 0) + 1e-6 AS p, coalesce(bl.prob, 0) + 1e-6 AS q FROM f FULL JOIN bl ON bl.query = f.id AND bl.action = f.action),
e AS (SELECT id, p / sum(p) OVER (PARTITION BY id) AS p, q / sum(q) OVER (PARTITION BY id) AS q FROM u WHERE id IN (SELECT query FROM bl) AND id IN (SELECT id FROM nw))"""


@query(with_roles(f"WITH {SESSION} SELECT split_part(e.id, '|', 1) AS session_id, split_part(e.id, '|', 2) AS cluster_key, any_value(nw.n) AS n, round(sum(p * ln(p / q)), 5) AS ev_loss FROM e JOIN nw ON nw.id = e.id GROUP BY e.id"))
def a18_session_ev_loss(spark, d):
    """Each session and cluster against the corpus as it was when the session began."""
    obs = role(spark, d, "obs")
    start = obs.groupBy("session_id").agg((20 * F.dayofyear(F.min("ts"))).alias("t0"))
    rows = obs_vectors(spark, d).join(obs.select(F.col("obs_id").alias("id"), "session_id", "action"), "id").join(start, "session_id")
    got = E.ev_loss(rows, corpus_of(spark, d), ["session_id", "cluster_key"], ["part"], valid=("t0", "added_at", "removed_at"))
    return got.select("session_id", "cluster_key", "n", F.round("ev_loss", 5).alias("ev_loss"))


GATE = f"""ov AS ({OBSVEC}), nw AS (SELECT cluster_key AS id, arg_max(vec, (ts, id)) AS vec, arg_max(part, (ts, id)) AS part, count(*) AS n FROM ov WHERE cluster_key IN (SELECT cluster_key FROM targets) GROUP BY cluster_key),
nb AS ({nb_sql("c.active AND 'c' || (c.id % 20) <> q.id", 'nw', 'corpus', 10).replace(' AND c.id <> q.id', '')}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action),
bl AS (SELECT query, action, w / sum(w) OVER (PARTITION BY query) AS p FROM v WHERE w > 0),
u AS (SELECT coalesce(bl.query, t.cluster_key) AS id, coalesce(bl.action, t.action) AS action, coalesce(bl.p, 0) AS p, coalesce(t.p, 0) AS q FROM bl FULL JOIN (SELECT * FROM targets WHERE cluster_key IN (SELECT query FROM bl)) t ON t.cluster_key = bl.query AND t.action = bl.action),
g AS (SELECT u.id, 0.5 * sum(abs(p - q)) AS tvd, arg_max(action, (p, action)) = arg_max(action, (q, action)) AS hit, any_value(n) AS w FROM u JOIN nw ON nw.id = u.id GROUP BY u.id),
r AS (SELECT sum(tvd * w) / sum(w) AS tvd, sum(CASE WHEN hit THEN 1.0 ELSE 0.0 END * w) / sum(w) AS top1, count(*) AS clusters, (SELECT arg_max(m, session_id) FROM (SELECT session_id, avg(value) / 2 AS m FROM metrics GROUP BY session_id)) AS last FROM g)"""


@query(with_roles(f"WITH {GATE} SELECT round(tvd, 5) AS tvd, round(top1, 5) AS top1, clusters, round(last, 5) AS last_tvd, clusters >= 5 AS coverage_ok, round(tvd - last, 5) AS regression, clusters >= 5 AND tvd < 0.15 AND tvd - last <= 0.05 AS passed FROM r"))
def a35_loo_gate(spark, d):
    """Every solved cluster rebuilt from the other clusters' rows, against its solve and the run before."""
    obs, own = obs_vectors(spark, d), F.concat(F.lit("c"), F.col("id") % 20)
    spots = E.newest_spots(obs, ["cluster_key"], ["part"], [], 1).withColumn("id", F.col("cluster_key"))
    targets = role(spark, d, "targets").withColumnRenamed("cluster_key", "id")
    runs = role(spark, d, "metrics").groupBy(F.col("session_id").alias("at")).agg((F.avg("value") / 2).alias("tvd"))
    corpus = corpus_of(spark, d).where("active").withColumn("cluster_key", own)
    got = E.loo_gate(spots.drop("n"), corpus, targets, spots.select("id", "n"), ["part"], ["cluster_key"], runs)
    return got.select(d5("tvd"), d5("top1"), "clusters", d5("last_tvd"), "coverage_ok", d5("regression"), "passed")


LOO = f"""nb AS ({nb_sql('TRUE', k=10)}), v AS (SELECT query, action, sum(greatest(0, 1 - distance) * confidence * gto_score) AS w FROM nb JOIN corpus c ON c.id = nb.nb GROUP BY query, action),
bl AS (SELECT query, action, w / sum(w) OVER (PARTITION BY query) AS prob FROM v WHERE w > 0), t AS (SELECT query, arg_max(action, (prob, action)) AS top FROM bl GROUP BY query)"""


@query(with_roles(f"""WITH {LOO} SELECT count(*) AS rows, round(avg(1 - coalesce(prob, 0)), 5) AS loss, round(avg(-ln(coalesce(prob, 0) + 1e-6)), 5) AS log_loss, round(avg(CASE WHEN top = c.action THEN 1.0 ELSE 0.0 END), 5) AS fidelity, 1.0 AS coverage
FROM corpus c JOIN t ON t.query = c.id LEFT JOIN bl ON bl.query = c.id AND bl.action = c.action"""))
def n11_loo_eval(spark, d):
    return E.loo_eval(corpus_of(spark, d), ["part"]).select("rows", d5("loss"), d5("log_loss"), d5("fidelity"), "coverage")


@query(with_roles(f"""WITH nb AS ({nb_sql('TRUE')}), s AS (SELECT query, avg(CASE WHEN a.action = b.action THEN 1.0 ELSE 0.0 END) AS share, any_value(a.label) AS label FROM nb JOIN corpus a ON a.id = nb.query JOIN corpus b ON b.id = nb.nb GROUP BY query)
SELECT label, count(*) AS rows, round(avg(share), 5) AS same_action FROM s GROUP BY label"""))
def n12_same_action_at_k(spark, d):
    return E.same_action_at_k(corpus_of(spark, d), ["part"], "label").select("label", "rows", d5("same_action"))


FREE, BOUND = ["view", "click"], ["purchase", "signup", "error"]
MASK = f"""co AS (SELECT *, spr % 2 = 1 AS facing, 'p' || (label % 4) AS pair FROM corpus), nb AS ({nb_sql('TRUE', 'co', 'co', 10)}), mo AS (SELECT part, arg_max(action, (n, action)) AS modal FROM (SELECT part, action, count(*) AS n FROM co GROUP BY ALL) GROUP BY part),
vo AS (SELECT nb.query, c.action = q.action AS hit, greatest(0, 1 - distance) AS w FROM nb JOIN co c ON c.id = nb.nb JOIN co q ON q.id = nb.query WHERE CASE WHEN q.facing THEN c.action IN ('purchase', 'signup', 'error') ELSE c.action IN ('view', 'click') END),
vt AS (SELECT query, sum(w) AS t, coalesce(sum(w) FILTER (WHERE hit), 0) AS h FROM vo GROUP BY query),
pf AS (SELECT pair, action, count(*) / sum(count(*)) OVER (PARTITION BY pair) AS p FROM co GROUP BY pair, action), pg AS (SELECT DISTINCT pair FROM pf), ps AS (SELECT a.pair AS a, b.pair AS b, 1 - 0.5 * sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) AS sim FROM pg a, pg b, (SELECT DISTINCT action FROM pf) n LEFT JOIN pf x ON x.pair = a.pair AND x.action = n.action LEFT JOIN pf y ON y.pair = b.pair AND y.action = n.action GROUP BY 1, 2),
fi AS (SELECT nb.query, avg(sim) AS f FROM nb JOIN co q ON q.id = nb.query JOIN co c ON c.id = nb.nb JOIN ps ON ps.a = q.pair AND ps.b = c.pair GROUP BY nb.query),
sc AS (SELECT c.id, c.action <> modal AS sensitive, CASE WHEN t > 0 THEN h / t WHEN c.action = CASE WHEN c.facing THEN 'error' ELSE 'view' END THEN 1 ELSE 0 END AS p, f FROM co c JOIN mo ON mo.part = c.part LEFT JOIN vt ON vt.query = c.id LEFT JOIN fi ON fi.query = c.id)"""


def spotted(spark, d):
    return corpus_of(spark, d).withColumns({"facing": F.col("spr") % 2 == 1, "pair": F.concat(F.lit("p"), F.col("label") % 4)})


@query(with_roles(f"""WITH {MASK} SELECT count(*) AS rows, round(avg(1 - p), 5) AS loss, round(avg(-ln(greatest(p, 1e-12))), 5) AS log_loss, round(avg(1 - p) FILTER (WHERE sensitive), 5) AS sensitive_loss, count(*) FILTER (WHERE sensitive) AS n_sensitive, round(avg(f), 5) AS fidelity, 1.0 AS coverage FROM sc"""))
def n11_masked_loo(spark, d):
    """Legal actions by the state, the position-sensitive rows, and how alike the neighbours' pairs are."""
    df = spotted(spark, d)
    freq = S.action_freq(df, ["pair"])
    names = freq.select("pair").distinct()
    both = names.select(F.col("pair").alias("a")).crossJoin(names.select(F.col("pair").alias("b"))).withColumn("k", F.concat("a", F.lit("|"), "b"))  # pairs of pair names, few
    side = lambda c: both.select("k", F.col(c).alias("pair")).join(freq, "pair").select("k", "action", "p")
    sims = S.tvd(side("a"), side("b"), ["k"]).join(both, "k").select("a", "b", (1 - F.col("tvd")).alias("sim"))
    got = E.masked_loo(df, ["part"], {False: FREE, True: BOUND}, {False: "view", True: "error"}, pair_sims=sims)
    return got.select("rows", d5("loss"), d5("log_loss"), d5("sensitive_loss"), "n_sensitive", d5("fidelity"), "coverage")


@query(with_roles(f"""WITH {MASK}, by_query AS (SELECT nb.query, avg(CASE WHEN c.action = q.action THEN 1.0 ELSE 0.0 END) AS same, avg(CASE WHEN c.pair = q.pair THEN 1.0 ELSE 0.0 END) AS pr, avg(CASE WHEN c.label % 3 = 0 THEN 1.0 ELSE 0.0 END) AS pure FROM nb JOIN co q ON q.id = nb.query JOIN co c ON c.id = nb.nb GROUP BY nb.query),
tg AS (SELECT id, unnest(list_concat(['overall', CASE WHEN facing THEN 'facing' ELSE 'free' END, 'spr:' || (spr // 100)], CASE WHEN action <> modal THEN ['sensitive'] ELSE [] END)) AS name FROM co JOIN mo ON mo.part = co.part)
SELECT 'tag' AS part, name, count(*) AS n, round(avg(same), 5) AS mean FROM tg JOIN by_query ON by_query.query = tg.id GROUP BY name UNION ALL SELECT 'pool', 'exact_pair', count(*), round(avg(pr), 5) FROM by_query
UNION ALL SELECT 'pool', 'purity', count(*), round(avg(pure), 5) FROM by_query JOIN co ON co.id = by_query.query WHERE label % 3 = 0"""))
def n12_archetypes(spark, d):
    """Each row under all its tags, and how pure the pools of neighbours are."""
    tags = F.array(F.when(F.col("facing"), "facing").otherwise("free"), F.concat(F.lit("spr:"), F.floor(F.col("spr") / 100)))
    return E.archetypes(spotted(spark, d), ["part"], tags, "pair", F.col("label") % 3 == 0).select("part", "name", "n", d5("mean"))


def sweep(spark, d, **kw):
    one = F.array((F.col("label") % 5).cast("double"))
    two = F.array((F.col("id") % 3).cast("double"), (F.col("spr") / 100).cast("double"))
    return E.weight_sweep(corpus_of(spark, d), ["part"], {"ordinal": one, "mixed": two}, [0.0, 0.5], k=8, **kw)


SWEEP = """st(variant, weight) AS (VALUES ('ordinal', 0.0::DOUBLE), ('ordinal', 0.5::DOUBLE), ('mixed', 0.0::DOUBLE), ('mixed', 0.5::DOUBLE)),
ex AS (SELECT variant, weight, id, part, action, confidence, gto_score, list_concat(CAST(vec AS DOUBLE[]), CASE variant WHEN 'ordinal' THEN [label % 5 * weight] ELSE [id % 3 * weight, spr / 100.0 * weight] END) AS v FROM corpus, st),
nb AS (SELECT * FROM (SELECT q.variant, q.weight, q.id AS query, c.id AS nb, c.action, c.confidence * c.gto_score AS cw, 1 - list_cosine_similarity(q.v, c.v) AS distance, row_number() OVER (PARTITION BY q.variant, q.weight, q.id ORDER BY 1 - list_cosine_similarity(q.v, c.v), c.id) AS rank
 FROM ex q JOIN ex c ON c.variant = q.variant AND c.weight = q.weight AND c.part = q.part AND c.id <> q.id) WHERE rank <= 8),
vo AS (SELECT variant, weight, query, action, sum(greatest(0, 1 - distance) * cw) AS w FROM nb GROUP BY ALL), bl AS (SELECT variant, weight, query, action, w / sum(w) OVER (PARTITION BY variant, weight, query) AS prob FROM vo WHERE w > 0),
tp AS (SELECT variant, weight, query, arg_max(action, (prob, action)) AS top FROM bl GROUP BY ALL),
sw AS (SELECT e.variant, e.weight, count(*) AS rows, avg(1 - coalesce(prob, 0)) AS loss, avg(CASE WHEN top = e.action THEN 1.0 ELSE 0.0 END) AS fidelity FROM ex e JOIN tp ON tp.variant = e.variant AND tp.weight = e.weight AND tp.query = e.id
 LEFT JOIN bl ON bl.variant = e.variant AND bl.weight = e.weight AND bl.query = e.id AND bl.action = e.action GROUP BY e.variant, e.weight)"""


@query(with_roles(f"WITH {SWEEP} SELECT variant, weight, rows, round(loss, 5) AS loss, round(fidelity, 5) AS fidelity FROM sw"))
def n13_weight_sweep(spark, d):
    return sweep(spark, d).select("variant", "weight", "rows", d5("loss"), d5("fidelity"))


ZSCORED = SWEEP.replace("FROM corpus, st)", "FROM zc, st)").replace("list_concat(CAST(vec AS DOUBLE[]), CASE variant WHEN 'ordinal' THEN [label % 5 * weight] ELSE [id % 3 * weight, spr / 100.0 * weight] END)", "list_concat(z, list_transform(CASE variant WHEN 'ordinal' THEN [z1] ELSE [z2, z3] END, lambda x: x * weight))")
ZC = """lg AS (SELECT id, unnest(CAST(vec AS DOUBLE[])) AS x, generate_subscripts(vec, 1) AS k FROM corpus), ft AS (SELECT k, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS s FROM lg GROUP BY k),
zs AS (SELECT lg.id, list((x - m) / s ORDER BY lg.k) AS z FROM lg JOIN ft ON ft.k = lg.k GROUP BY lg.id), zc AS (SELECT c.*, z, (label % 5 - avg(label % 5) OVER ()) / stddev_pop(label % 5) OVER () AS z1, (c.id % 3 - avg(c.id % 3) OVER ()) / stddev_pop(c.id % 3) OVER () AS z2, (spr / 100.0 - avg(spr / 100.0) OVER ()) / stddev_pop(spr / 100.0) OVER () AS z3 FROM corpus c JOIN zs ON zs.id = c.id)"""


@query(with_roles(f"WITH {ZC}, {ZSCORED} SELECT variant, weight, rows, round(loss, 5) AS loss, round(fidelity, 5) AS fidelity FROM sw"))
def n13_zscored_sweep(spark, d):
    """The sweep over scaled entries: one fit for all weights."""
    return sweep(spark, d, zscore=True).select("variant", "weight", "rows", d5("loss"), d5("fidelity"))


@query(with_roles(f"WITH {SWEEP}, h AS (SELECT * FROM sw WHERE weight = 0.5), b AS (SELECT * FROM h WHERE variant = 'ordinal') SELECT h.variant, round(h.loss - b.loss, 5) AS d_loss, round(h.fidelity - b.fidelity, 5) AS d_fidelity, CASE WHEN h.loss - b.loss < -1e-3 THEN 'better' WHEN h.loss - b.loss > 1e-3 THEN 'worse' ELSE 'same' END AS verdict FROM h, b"))
def n14_compare_variants(spark, d):
    got = E.compare_variants(sweep(spark, d).where("weight = 0.5"), "ordinal")
    return got.select("variant", d5("d_loss"), d5("d_fidelity"), "verdict")


@query(with_roles(f"""WITH nb AS ({nb_sql('TRUE')}), s AS (SELECT query, list(nb) AS s FROM nb GROUP BY query)
SELECT f.query, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 5) AS jaccard FROM nb f JOIN s a ON a.query = f.query JOIN s b ON b.query = f.nb WHERE f.rank = 1"""))
def n15_knn_jaccard(spark, d):
    return E.knn_jaccard(corpus_of(spark, d), ["part"]).select("query", d5("jaccard"))


@query(with_roles(f"""WITH nb AS ({nb_sql('TRUE', k=10)}), r AS (SELECT id, spr // 100 AS b, row_number() OVER (PARTITION BY spr // 100 ORDER BY CAST(concat('0x', substr(md5(id || '|1'), 1, 8)) AS BIGINT), id) AS r FROM corpus),
dr AS (SELECT * FROM (SELECT q.id AS query, r.id AS nb, row_number() OVER (PARTITION BY q.id ORDER BY r.r) AS p FROM corpus q JOIN r ON r.b = q.spr // 100 AND r.id <> q.id AND r.r <= 11) WHERE p <= 10)
SELECT (SELECT round(avg(CASE WHEN a.action = b.action THEN 1.0 ELSE 0.0 END), 5) FROM nb JOIN corpus a ON a.id = nb.query JOIN corpus b ON b.id = nb.nb) AS knn, (SELECT round(avg(CASE WHEN a.action = b.action THEN 1.0 ELSE 0.0 END), 5) FROM dr JOIN corpus a ON a.id = dr.query JOIN corpus b ON b.id = dr.nb) AS bucket"""))
def n16_precision_vs_bucket(spark, d):
    df = corpus_of(spark, d).withColumn("bucket", F.floor(F.col("spr") / 100))
    return E.precision_vs_bucket(df, ["part"], "bucket").select(d5("knn"), d5("bucket"))


@query(with_roles(f"SELECT round(avg({COS}) FILTER (WHERE q.label = c.label), 5) AS intra, round(avg({COS}) FILTER (WHERE q.label <> c.label), 5) AS inter, round(avg({COS}) FILTER (WHERE q.label = c.label) - avg({COS}) FILTER (WHERE q.label <> c.label), 5) AS margin FROM corpus q JOIN corpus c ON c.id <> q.id"))
def n17_separation(spark, d):
    return E.separation(corpus_of(spark, d), "vec", "label").select(d5("intra"), d5("inter"), d5("margin"))


L2 = "list_distance(CAST({0}.vec AS DOUBLE[]), CAST({1}.vec AS DOUBLE[]))"


@query(with_roles(f"""WITH t AS (SELECT {L2.format('a', 'b')} < {L2.format('a', 'c')} AS near FROM corpus a JOIN corpus b ON b.id = a.id + 10 JOIN corpus c ON c.id = a.id + 1) SELECT count(*) AS n, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 5) AS share, avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) >= 0.95 AS passed FROM t"""))
def n18_rank_order(spark, d):
    df = corpus_of(spark, d)
    a = df.select("id", F.col("vec").alias("anchor"))
    b, c = df.select((F.col("id") - 10).alias("id"), F.col("vec").alias("twin")), df.select((F.col("id") - 1).alias("id"), F.col("vec").alias("stranger"))
    return E.rank_order(a.join(b, "id").join(c, "id")).select("n", d5("share"), "passed")


FOLD = "CAST(floor(CAST(concat('0x', substr(md5(id || '|9'), 1, 8)) AS BIGINT) / 4294967296.0 * 5) AS BIGINT)"


@query(with_roles(f"SELECT id, {FOLD} AS fold FROM corpus"))
def n19_seeded_folds(spark, d):
    return E.seeded_folds(corpus_of(spark, d), "id", 5, 9).select("id", "fold")


@query(with_roles(f"""WITH b AS (SELECT label, {FOLD} AS fold, count(*) AS n, count(*) FILTER (WHERE spr > 200) AS s FROM corpus GROUP BY 1, 2)
SELECT label, fold, CAST(sum(n) OVER (PARTITION BY label) - n AS BIGINT) AS n, round((sum(s) OVER (PARTITION BY label) - s) / CAST(sum(n) OVER (PARTITION BY label) - n AS DOUBLE), 5) AS rate FROM b"""))
def n20_out_of_fold(spark, d):
    df = E.seeded_folds(corpus_of(spark, d), "id", 5, 9)
    return E.out_of_fold_rates(df, "label", F.col("spr") > 200).select("label", "fold", "n", d5("rate"))


@query(with_roles(f"""WITH s AS (SELECT * FROM corpus ORDER BY CAST(concat('0x', substr(md5(id || '|3'), 1, 8)) AS BIGINT), id LIMIT 60), p AS (SELECT a.label = b.label AS same, {L2.format('a', 'b')} AS x FROM s a JOIN s b ON a.id < b.id),
g AS (SELECT avg(x) FILTER (WHERE same) AS m_in, avg(x) FILTER (WHERE NOT same) AS m_out, stddev_pop(x) FILTER (WHERE same) AS s_in, stddev_pop(x) FILTER (WHERE NOT same) AS s_out FROM p)
SELECT round(m_in, 5) AS m_in, round(m_out, 5) AS m_out, round(s_in, 5) AS s_in, round(s_out, 5) AS s_out, m_out - m_in > 2 * sqrt(s_in * s_in + s_out * s_out) AS separated FROM g"""))
def n21_sigma_separation(spark, d):
    return E.sigma_separation(corpus_of(spark, d), "vec", "label").select(d5("m_in"), d5("m_out"), d5("s_in"), d5("s_out"), "separated")


NUMBER = "CAST(substr(cluster_key, 2) AS INTEGER)"
PROBE = f"""{EV}, cl AS (SELECT DISTINCT cluster_key FROM obs), nd AS (SELECT DISTINCT cluster_key FROM nodes WHERE active AND gto_score > 0.97 AND cluster_key IN (SELECT cluster_key FROM cl)),
ch AS (SELECT cluster_key FROM cl WHERE {NUMBER} % 3 = 0 AND cluster_key NOT IN (SELECT cluster_key FROM nd)), lg AS (SELECT query, action, prob / sum(prob) OVER (PARTITION BY query) AS p FROM bl WHERE action <> 'error'),
an AS (SELECT cluster_key, 'node' AS source, unnest(['click', 'view']) AS action, unnest([0.4, 0.6]) AS p FROM nd UNION ALL SELECT cluster_key, 'chart', unnest(['click', 'fold', 'view']), unnest([0.3, 0.1, 0.6]) FROM ch
 UNION ALL SELECT query, 'knn', action, p FROM lg WHERE query NOT IN (SELECT cluster_key FROM nd) AND query NOT IN (SELECT cluster_key FROM ch)),
so AS (SELECT cluster_key FROM solves GROUP BY cluster_key HAVING arg_max(exploitability, (solved_at, solve_id)) < 30), sd AS (SELECT cluster_key, unnest(['purchase', 'view']) AS action, unnest([0.3, 0.7]) AS q FROM so),
k AS (SELECT coalesce(an.cluster_key, sd.cluster_key) AS cluster_key, sum(greatest(coalesce(p, 0), 1e-6) * ln(greatest(coalesce(p, 0), 1e-6) / greatest(coalesce(q, 0), 1e-6))) AS kl FROM an FULL JOIN sd ON sd.cluster_key = an.cluster_key AND sd.action = an.action GROUP BY 1),
m AS (SELECT query, count(*) AS n, max(distance) AS far FROM nb GROUP BY query)"""


@query(with_roles(f"""WITH {PROBE} SELECT cl.cluster_key, coalesce(any_value(an.source), 'none') AS source, arg_min(an.action, (-round(an.p, 9), an.action)) AS top, coalesce(any_value(m.n), 0) AS n_neighbours, round(any_value(m.far), 5) AS max_distance,
 round(any_value(CASE WHEN so.cluster_key IS NOT NULL AND an.action IS NOT NULL THEN k.kl END), 4) AS kl FROM cl LEFT JOIN an ON an.cluster_key = cl.cluster_key LEFT JOIN m ON m.query = cl.cluster_key LEFT JOIN so ON so.cluster_key = cl.cluster_key LEFT JOIN k ON k.cluster_key = cl.cluster_key GROUP BY cl.cluster_key"""))
def n08_probe(spark, d):
    """Each cluster's answer (node, chart, legal blend), its neighbours and its distance from the solver."""
    from decilog.operators import corpus as C
    from decilog.operators import rank as R

    clusters = role(spark, d, "obs").select("cluster_key").distinct()
    fixed = lambda **kv: F.create_map(*[F.lit(x) for pair in sorted(kv.items()) for x in pair])
    nodes = role(spark, d, "nodes").where("active AND gto_score > 0.97").select("cluster_key").distinct().withColumn("dist", fixed(click=0.4, view=0.6))
    spots = clusters.withColumn("kind", F.substring("cluster_key", 2, 9).cast("int") % 3)
    charts = spark.createDataFrame([(0, "view", 0.6), (0, "click", 0.3)], "kind int, action string, freq double")
    newest, corpus = ev_spots(spark, d)
    near = K.knn(newest, corpus.where("active"), ["part"], 10)
    solved = R.latest(role(spark, d, "solves"), ["cluster_key"], ["solved_at", "solve_id"]).where("exploitability < 30").select("cluster_key", fixed(purchase=0.3, view=0.7).alias("dist"))
    legal = F.array(*map(F.lit, ["view", "click", "purchase", "signup"]))
    got = C.probe(clusters, nodes, charts, spots, ["kind"], near, B.blend(near, corpus), solved, legal)
    top = F.array_sort(F.transform(F.map_entries("dist"), lambda e: F.struct((-F.round(e["value"], 9)).alias("p"), e["key"].alias("k"))))[0]["k"]
    return got.select("cluster_key", "source", top.alias("top"), "n_neighbours", d5("max_distance"), F.round("kl", 4).alias("kl"))
