"""Blends over distributions, masked neighbour search, and what is built on both, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from decilog.operators import blend as B
from decilog.operators import corpus as C
from decilog.operators import evaluate as E
from decilog.operators import knn as K
from decilog.operators import lookup as J
from decilog.operators import stats as S


def blend(rows, vocabulary, snap):
    """rows: (distance, confidence, gto, action, dist, size)."""
    out, total = defaultdict(float), 0.0
    for distance, confidence, gto, action, dist, size in rows:
        w = max(0.0, 1 - distance) * (1.0 if confidence is None else confidence) * (1.0 if gto is None else gto)
        votes = [(snap(a, size), p) for a, p in (dist.items() if dist else [(action, 1.0)]) if p > 0]
        votes = [(a, p) for a, p in votes if a in vocabulary]
        if w > 0 and votes:
            total += w
            for a, p in votes:
                out[a] += w * p
    return {a: v / total for a, v in out.items()}


def test_blend_splits_weights_over_distributions(spark):
    rng = random.Random(5)
    dists = [None, {}, {"bet": 0.5, "fold": 0.5}, {"bet": 0.7, "muck": 0.3}, {"muck": 1.0}, {"bet": -0.2, "fold": 0.0}, {"call": 0.4, "bet": 0.4}]
    corpus = [(k, rng.choice(["bet", "fold", "muck", None]), rng.choice([0.5, 1.0, None]), rng.choice([0.9, None, 0.0]), rng.choice(dists), rng.choice(["s", "l"])) for k in range(60)]
    near = [(q, nb, rng.choice([0.0, 0.3, 1.0, 1.4])) for q in range(40) for nb in rng.sample(range(60), 5)]
    vocabulary = ["bet_s", "bet_l", "fold", "call"]
    df = spark.createDataFrame(corpus, "id long, action string, confidence double, gto_score double, dist map<string,double>, size string")
    nbs = spark.createDataFrame(near, "query long, nb long, distance double")
    snap = lambda a: F.when(a == "bet", F.concat(a, F.lit("_"), F.col("size"))).otherwise(a)
    got = defaultdict(dict)
    for r in B.blend(nbs, df, vocabulary, snap=snap).collect():
        got[r["query"]][r.action] = r.prob
    for q in range(40):
        rows = [(d, *corpus[nb][2:4], corpus[nb][1], corpus[nb][4], corpus[nb][5]) for x, nb, d in near if x == q]
        want = blend(rows, vocabulary, lambda a, size: f"{a}_{size}" if a == "bet" else a)
        assert got.get(q, {}).keys() == want.keys() and all(math.isclose(got[q][a], want[a]) for a in want)
    assert sum(sum(x.values()) < 0.999 for x in got.values()) > 0  # shares of unknown labels are lost, as asked


def test_a_patched_row_keeps_its_distribution(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "fold", 1.0, 0, 0, True), (2, [0.0, 1.0], "fold", 1.0, 0, 0, True)], "id long, vec array<double>, action string, confidence double, added_at long, removed_at long, active boolean")
    asked = spark.createDataFrame([(7, 1, "c", [1.0, 0.0], {"call": 0.6, "fold": 0.4})], "patch_id long, id long, cluster_key string, vec array<double>, dist map<string,double>")
    merged, _, _ = C.apply_patches(corpus, asked, 9)
    near = spark.createDataFrame([(5, 1, 0.0)], "query long, nb long, distance double")
    got = {r.action: r.prob for r in B.blend(near, merged.withColumn("gto_score", F.lit(1.0))).collect()}
    assert got == pytest.approx({"call": 0.6, "fold": 0.4})
    again, _, _ = C.apply_patches(merged, asked.limit(0), 10)
    assert {r.id: r.dist for r in again.collect()} == {1: {"call": 0.6, "fold": 0.4}, 2: None}


@pytest.mark.parametrize("block", [7, 20_000])
def test_masked_neighbours(spark, block):
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(90, 4))
    rows = [(k, vec[k].tolist(), k % 2, ["x", "y", None][k % 3], k % 5, k % 40, (k % 60 if k % 4 else 0)) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, part long, a string, b long, added long, removed long").withColumn("t", F.col("id") % 50)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)

    def brute(allowed):
        out = {}
        for q in rows:
            near = sorted((round(1 - float(unit[q[0]] @ unit[c[0]]), 12), c[0]) for c in rows if c[0] != q[0] and c[2] == q[2] and allowed(q, c))
            out[q[0]] = [c for _, c in near[:6]]
        return {q: v for q, v in out.items() if v}

    def found(**kw):
        out = defaultdict(list)
        for r in K.knn(df, df, ["part"], 6, block_rows=block, **kw).orderBy("query", "rank").collect():
            out[r["query"]].append(r.nb)
        return dict(out)

    assert found(apart=["a", "b"]) == brute(lambda q, c: not (q[3] == c[3] and q[4] == c[4]))
    assert found(valid=("t", "added", "removed")) == brute(lambda q, c: c[5] <= q[0] % 50 and (c[6] == 0 or c[6] > q[0] % 50))


def test_losses_by_session_use_the_corpus_of_their_time(spark):
    obs = [(k, f"s{k % 2}", "c", k, [1.0, 0.0], 1, "call" if k % 3 else "fold", 5 if k % 2 == 0 else 20) for k in range(24)] + [(99, "s2", "c", 1, [1.0, 0.0], 1, "fold", 20)]
    df = spark.createDataFrame(obs, "id long, session string, cluster string, ts long, vec array<double>, part long, action string, t long")
    corpus = spark.createDataFrame([(1, [1.0, 0.1], 1, "call", 0, 10), (2, [1.0, 0.0], 1, "fold", 10, 0)], "id long, vec array<double>, part long, action string, added long, removed long").withColumns({"confidence": F.lit(1.0), "gto_score": F.lit(1.0)})
    got = {r.session: (r.n, r.ev_loss) for r in E.ev_loss(df, corpus, ["session", "cluster"], ["part"], valid=("t", "added", "removed")).collect()}

    def kl(p, q):
        names = p.keys() | q.keys()
        p, q = ({a: (x.get(a, 0) + 1e-6) / (1 + 1e-6 * len(names)) for a in names} for x in (p, q))
        return sum(p[a] * math.log(p[a] / q[a]) for a in names)

    freq = {s: {a: n / 12 for a, n in Counter(o[6] for o in obs if o[1] == s).items()} for s in ("s0", "s1")}
    assert got.keys() == {"s0", "s1"} and got["s0"] == (12, pytest.approx(kl(freq["s0"], {"call": 1.0}))) and got["s1"] == (12, pytest.approx(kl(freq["s1"], {"fold": 1.0})))


def test_gate_rebuilds_clusters_from_the_others(spark):
    rows = [(k, [math.cos(k), math.sin(k)], 0, f"c{k % 4}", ["call", "fold"][k % 2], 1.0, 1.0) for k in range(40)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>, part long, own string, action string, confidence double, gto_score double")
    spots = [(f"c{k}", [math.cos(k), math.sin(k)], 0, f"c{k}") for k in range(5)]
    targets = [(f"c{k}", "call", 0.25 * k) for k in range(4)] + [(f"c{k}", "fold", 1 - 0.25 * k) for k in range(4)]
    visits = [("c0", 1), ("c1", 2), ("c2", 3), ("c3", 4), ("c4", 5)]
    run = lambda **kw: E.loo_gate(spark.createDataFrame(spots, "id string, vec array<double>, part long, own string"), corpus, spark.createDataFrame(targets, "id string, action string, p double"), spark.createDataFrame(visits, "id string, n long"), ["part"], ["own"], k=3, **kw).first()
    tvd = top = 0.0
    for k in range(4):
        near = sorted((1 - math.cos(k - r[0]), r[0], r[4]) for r in rows if r[3] != f"c{k}")[:3]
        w = sum(1 - d for d, _, _ in near)
        call = sum(1 - d for d, _, a in near if a == "call") / w
        tvd += (k + 1) / 10 * abs(call - 0.25 * k)
        top += (k + 1) / 10 * ((call > 0.5) == (0.25 * k > 0.5))
    got = run(least=4, floor=2.0)
    assert got.tvd == pytest.approx(tvd) and got.top1 == pytest.approx(top) and got.clusters == 4 and got.passed and got.regression == 0
    runs = spark.createDataFrame([(1, 0.9), (2, tvd - 0.06)], "at long, tvd double")
    worse = run(least=4, floor=2.0, runs=runs)
    assert worse.regression == pytest.approx(0.06) and not worse.passed and not run(floor=2.0).coverage_ok


def test_bootstrap_of_few_many_and_no_values(spark):
    rng = np.random.default_rng(3)
    skewed = rng.exponential(size=400) ** 2
    rows = [("one", 5.0)] * 3 + [("two", 0.0)] * 500_0 + [("two", 1.0)] * 500_0 + [("skew", float(x)) for x in skewed] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in S.bootstrap_ci(df, ["g"], "x", resamples=2000).collect()}
    assert got.keys() == {"one", "two", "skew", "none"}
    assert (got["none"].n, got["none"].ci_low, got["none"].ci_high) == (0, 0.0, 0.0) and (got["one"].ci_low, got["one"].ci_high) == (5.0, 5.0)
    assert got["two"].ci_high - got["two"].ci_low == pytest.approx(2 * 1.96 * 0.5 / 100, rel=0.08)
    whole = np.percentile([rng.choice(skewed, 400).mean() for _ in range(4000)], [2.5, 97.5])
    assert got["skew"].ci_low == pytest.approx(whole[0], rel=0.05) and got["skew"].ci_high == pytest.approx(whole[1], rel=0.05)
    empty = S.bootstrap_ci(df.limit(0), [], "x").collect()
    assert [(r.n, r.ci_low, r.ci_high) for r in empty] == [(0, 0.0, 0.0)] and S.bootstrap_ci(df.limit(0), ["g"], "x").collect() == []
    assert S.bootstrap_ci(df.where("g = 'two'"), [], "x").first().ci_low == pytest.approx(0.49, abs=0.002)


@pytest.mark.parametrize("sides", [1, 2, 3])
def test_product_distribution(spark, sides):
    rng = random.Random(sides)
    rows = [(g, s, rng.randrange(1, 30) / 30, rng.choice([0.0, 1.0, 2.0, 3.5])) for g in "ab" for s in range(sides) for _ in range(40)] + [("c", 0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "g string, side int, x double, w double")
    budget = 1000
    got = defaultdict(float)
    for r in J.product_distribution(df, ["g"], "side", "x", "w", sides, budget).collect():
        got[r.g, round(r.x, 9)] += r.w
    want = defaultdict(float)
    for g in "abc":
        lists = []
        for s in range(sides):
            sums = defaultdict(float)
            for gg, ss, x, w in rows:
                if (gg, ss) == (g, s) and w > 0:
                    sums[x] += w
            top = sorted(sums.items(), key=lambda p: (-p[1], p[0]))
            lists.append(top[: int(budget ** (1 / sides) + 1e-9)] if sides > 2 else top)
        joint = [(1.0, 1.0)]
        for own in lists:
            joint = [(x * y, w * v) for x, w in joint for y, v in own]
        for x, w in joint:
            want[g, round(x, 9)] += w
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
