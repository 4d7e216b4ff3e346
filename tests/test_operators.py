"""Operators against hand-computed values, brute force and their own other forms."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decilog.functions import cards as C
from decilog.functions import features as X
from decilog.functions import predicates as P
from decilog.operators import blend as B
from decilog.operators import corpus as K
from decilog.operators import extract as E
from decilog.operators import knn as N
from decilog.operators import lookup as J
from decilog.operators import rank as R
from decilog.operators import stats as S
from decilog.sources import io


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


# --- statistics -----------------------------------------------------------------


def test_shrinkage_by_hand(spark):
    rows = [("a", 0.1, 10), ("a", 0.5, 40), ("b", 0.3, 5), ("c", 0.2, 10), ("c", 0.2, 30)]
    got = S.eb_shrink(spark.createDataFrame(rows, "bucket string, m double, n long"), "bucket", "m", "n").collect()
    by = {(r.bucket, r.n): r for r in got}
    tau2 = 0.08 - (0.005 + 0.00125) / 2
    b = 0.005 / (0.005 + tau2)
    assert by["a", 10].tau2 == pytest.approx(tau2) and by["a", 10].post_mean == pytest.approx(b * 0.3 + (1 - b) * 0.1)
    assert by["b", 5].post_mean == 0.3 and by["b", 5].post_var == pytest.approx(0.01) and by["b", 5].tau2 == 0
    assert by["c", 10].post_mean == pytest.approx(0.2) and by["c", 10].post_var == 0
    assert one(spark, a=S.is_shrunk(F.lit(5), F.lit(0.0)), b=S.is_shrunk(F.lit(10**6), F.lit(1.0))) == (True, False)


def test_divergences(spark):
    p = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 0.5), ("only", "a", 1.0)], "key string, action string, p double")
    q = spark.createDataFrame([("k", "a", 0.25), ("k", "c", 0.75)], "key string, action string, p double")
    assert S.tvd(p, q, ["key"]).collect()[0].tvd == pytest.approx(0.75)
    assert S.kl(p, p, ["key"]).agg(F.max(F.abs("kl"))).first()[0] == pytest.approx(0)
    e = 1e-6
    pp, qq = np.array([0.5, 0.5, 0]) + e, np.array([0.25, 0, 0.75]) + e
    assert S.kl(p, q, ["key"]).first().kl == pytest.approx(float(np.sum(pp / pp.sum() * np.log(pp / pp.sum() / (qq / qq.sum())))))


def test_weighted_quantiles_equal_interp(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.random(), rng.randint(0, 5) * 1.0) for _ in range(60)]
    ps = [0.01, 0.1, 0.5, 0.9, 1.0]
    got = {(r.k, r.p): r.q for r in S.weighted_quantiles(spark.createDataFrame(rows, "k string, x double, w double"), ["k"], "x", "w", ps).collect()}
    for k in "ab":
        own = sorted((x, w) for kk, x, w in rows if kk == k and w > 0)
        cdf = np.cumsum([w for _, w in own]) / sum(w for _, w in own)
        for p in ps:
            assert got[k, p] == pytest.approx(float(np.interp(p, cdf, [x for x, _ in own])))


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1.0, 2.0, 800)
    df = spark.createDataFrame([(k, "g", float(v)) for k, v in enumerate(x)], "id long, g string, x double")
    r = S.bootstrap_ci(df, ["g"], "x", resamples=400).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert r.mean == pytest.approx(x.mean()) and r.ci_low == pytest.approx(x.mean() - half, abs=0.06) and r.ci_high == pytest.approx(x.mean() + half, abs=0.06)
    again = S.bootstrap_ci(df.repartition(7), ["g"], "x", resamples=400).first()
    assert again.ci_low == pytest.approx(r.ci_low)


def test_zscore_guards_constant_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "id long, v array<double>")
    fit = S.fit_zscore(df, "v")
    assert [(r.dim, r.mean, r.std, r.guarded) for r in fit.orderBy("dim").collect()] == [(0, 2.0, 1.0, False), (1, 2.0, 1.0, True)]
    assert [r.z for r in S.normalise(df, "v", S.manifest(fit), [1.0, 0.5]).orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


# --- neighbours ----------------------------------------------------------------


@pytest.mark.parametrize("block,parts", [(10**6, 1), (7, 17)])
def test_knn_equals_brute_force(spark, block, parts):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)).round(1)
    v[5] = v[6]
    v[9] = 0
    rows = [(k, int(k % 3 == 0), [float(x) for x in v[k]]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, part int, vec array<double>").repartition(parts)
    got = {}
    for r in N.knn(df, df, ["part"], 4, block_rows=block).collect():
        got.setdefault(r.query, []).append((r.rank, r.nb))
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    for k, part, _ in rows:
        order = sorted((round(1 - float(u[k] @ u[j]), 12), j) for j, p, _ in rows if p == part and j != k)
        assert [nb for _, nb in sorted(got[k])] == [j for _, j in order[:4]]


def test_knn_with_few_rows(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 1.0])], "id long, part int, vec array<double>")
    assert sorted((r.query, r.nb) for r in N.knn(df, df, ["part"], 10).collect()) == [(1, 2), (2, 1)]
    sparse = {r.id: (r.n, r.sparse) for r in N.sparseness(N.knn(df, df, ["part"], 10), df).collect()}
    assert sparse == {1: (1, True), 2: (1, True), 3: (0, True)}


def test_blend_and_legal_actions(spark):
    nb = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.5), (1, 12, 1.4), (2, 12, 1.0)], "query long, nb long, distance double")
    c = spark.createDataFrame([(10, "bet_50", 1.0, 1.0), (11, "fold", None, 0.5), (12, "call", 1.0, 1.0)], "id long, action string, confidence double, gto_score double")
    got = {(r["query"], r.action): r.prob for r in B.blend(nb, c).collect()}
    assert got == {(1, "bet_50"): pytest.approx(0.8 / 1.05), (1, "fold"): pytest.approx(0.25 / 1.05)}
    faced = B.blend(nb, c).withColumn("facing", F.lit(2))
    assert {r.action for r in B.legalise(faced, "query", "facing").collect()} == {"raise_2_5x", "fold"}
    free = B.legalise(B.blend(nb, c).withColumn("facing", F.lit(0)), "query", "facing")
    assert {r.action for r in free.collect()} == {"bet_50", "check"}


# --- lookups and state -----------------------------------------------------------


def test_fallback_levels_and_double_keys(spark):
    t = spark.createDataFrame([("a|1", "a", 1.0), ("a|2", "a", 2.0), ("b|1", "b", 6.0)], "k string, prefix string, v double")
    q = spark.createDataFrame([("a|2", "a"), ("a|9", "a"), ("z|1", "z")], "k string, prefix string")
    assert {r.k: (r.level, r.v) for r in J.lookup_fallback(q, t, "k", "prefix", "v").collect()} == {"a|2": (0, 2.0), "a|9": (1, 1.0), "z|1": (2, 3.0)}
    with pytest.raises(Exception, match="key twice"):
        J.lookup_fallback(q, t.unionByName(t), "k", "prefix", "v").collect()
    with pytest.raises(Exception, match="key twice"):
        io.union_tables([t, t.limit(1)], ["k"]).collect()


def test_insert_and_upsert_change_nothing_twice(spark):
    base = spark.createDataFrame([("s", None, 1), ("s", "c", 2)], "s string, c string, v int")
    new = spark.createDataFrame([("s", None, 9), ("t", None, 3), ("t", None, 4)], "s string, c string, v int")
    once = K.insert_ignore(base, new, ["s", "c"], "v")
    assert sorted((r.s, r.v) for r in once.collect()) == [("s", 1), ("s", 2), ("t", 3)]
    assert K.insert_ignore(once, new, ["s", "c"], "v").count() == 3
    up = K.upsert_latest(base, new, ["s", "c"], "v")
    assert sorted(r.v for r in up.collect()) == [2, 4, 9] and sorted(r.v for r in K.upsert_latest(up, new, ["s", "c"], "v").collect()) == [2, 4, 9]


def test_rollback_and_versions(spark):
    patches = spark.createDataFrame([(1, "c", "n1", 7, "applied"), (2, "c", "n2", 8, "rolled_back")], "patch_id long, cluster_key string, new_node_id string, id long, status string")
    nodes = spark.createDataFrame([("n1", True), ("n2", False), ("n3", True)], "node_id string, active boolean")
    corpus = spark.createDataFrame([(7, 1, 0, True), (8, 1, 0, True)], "id long, added_at long, removed_at long, active boolean")
    p, n, c, bad = K.rollback(patches, nodes, corpus, spark.createDataFrame([(1,), (2,), (3,)], "patch_id long"), 50)
    assert {r.patch_id: r.status for r in p.collect()} == {1: "rolled_back", 2: "rolled_back"}
    assert {r.node_id: r.active for r in n.collect()} == {"n1": False, "n2": False, "n3": True}
    assert {r.patch_id: r.reason for r in bad.collect()} == {2: "already rolled back", 3: "unknown"}
    assert {r.id: r.change for r in K.version_diff(c, 10, 60).collect()} == {7: "removed"}
    assert one(spark, a=P.as_of(F.lit(5), F.lit(9), F.lit(9)), b=P.as_of(F.lit(5), F.lit(0), F.lit(9))) == (False, True)


def test_schema_errors(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        io.align_schema(spark.range(1), ["id", "b"], {})


# --- extraction ------------------------------------------------------------------


def test_windows_equal_a_walk(spark):
    rng = random.Random(4)
    rows = []
    for hand in range(40):
        street = 0
        for seq in range(rng.randint(1, 9)):
            street = min(3, street + (rng.random() < 0.3))
            rows.append((hand, seq, E.STREETS[street], rng.choice(E.AFTER_FLOP), rng.choice(["fold", "call", "raise", "bet", "check"]), rng.randint(1, 50)))
    df = spark.createDataFrame(rows, "hand_id long, seq long, street string, actor string, action string, amount long").repartition(5)
    got = E.with_committed(E.with_pot_before(E.with_facing(E.with_pot_type(E.with_aggressor(df)))))
    active = {(r.hand_id, r.seq): r.active for r in E.with_active_players(df).collect()}
    for r in got.collect():
        past = [x for x in rows if x[0] == r.hand_id and x[1] < r.seq]
        all_of = [x for x in rows if x[0] == r.hand_id]
        first = [x for x in past if x[2] == "preflop"]
        assert r.pot_before == 3 + sum(x[5] for x in past)
        assert r.aggressor == next((x[3] for x in reversed(first) if x[4] in ("bet", "raise")), None)
        raises = sum(x[4] == "raise" and x[2] == "preflop" for x in (past if r.street == "preflop" else all_of))
        assert r.pot_type == ["limp", "srp", "3bet", "4bet", "5bet+"][min(raises, 4)]
        here = [x for x in past if x[2] == r.street]
        assert (r.facing == "cold") == (not here) and r.facing_pos == (here[-1][3] if here else None)
        seats = sorted({x[3] for x in all_of} - {x[3] for x in past if x[4] == "fold"})
        assert active.get((r.hand_id, r.seq)) == (seats if len(seats) > 1 else None)


# --- cards -------------------------------------------------------------------------


DECK = [r + s for s in C.SUITS for r in C.RANKS]


def made_truth(cards):
    def five(h):
        ranks = sorted(C.RANKS.index(c[0]) + 2 for c in h)
        counts = sorted((ranks.count(r) for r in set(ranks)), reverse=True)
        flush = len({c[1] for c in h}) == 1
        straight = len(set(ranks)) == 5 and (ranks[4] - ranks[0] == 4 or ranks == [2, 3, 4, 5, 14])
        if straight and flush:
            return 8
        return 7 if counts[0] == 4 else 6 if counts[:2] == [3, 2] else 5 if flush else 4 if straight else 3 if counts[0] == 3 else 2 if counts[:2] == [2, 2] else 1 if counts[0] == 2 else 0

    return max(five(h) for h in itertools.combinations(cards, 5))


def test_made_hands_equal_enumeration(spark):
    rng = random.Random(5)
    hands = [rng.sample(DECK, rng.choice([5, 6, 7])) for _ in range(300)]
    hands += [rng.sample([c for c in DECK if c[1] == "h"], 5) + rng.sample([c for c in DECK if c[1] != "h"], 2) for _ in range(40)] + [["Ah", "2h", "3h", "4h", "5h"], ["Ac", "2h", "3h", "4h", "5h", "9d", "9c"]]
    df = spark.createDataFrame([(k, h[:2], h[2:]) for k, h in enumerate(hands)], "k long, hole array<string>, board array<string>")
    got = {r.k: r.made for r in df.select("k", C.made_hand(F.col("hole"), F.col("board")).alias("made")).collect()}
    assert got == {k: made_truth(h) for k, h in enumerate(hands)}


def test_made_hand_features(spark):
    rows = [(["Ah", "Kd"], ["Ac", "7d", "2s"], (1, 12, 11, False, True, False)), (["Qh", "Qd"], ["Jc", "7d", "2s"], (1, 10, 9, False, False, True)), (["7h", "7c"], ["Jc", "7d", "2s"], (3, 5, 0, True, False, False)),
            (["Ah", "7c"], ["7s", "7d", "2s"], (3, 5, 0, False, True, False)), (["2h", "2c"], ["2s", "7d", "7s"], (6, 0, 0, True, False, False)), (["Ah", "Kd"], ["Qc", "7d"], (0, 0, 0, False, False, False)), (["Ah", "Kd"], ["Ac", "Kc", "2s"], (2, 0, 0, False, False, False))]
    df = spark.createDataFrame([(k, h, b) for k, (h, b, _) in enumerate(rows)], "k long, hole array<string>, board array<string>")
    got = {r.k: tuple(r.f) for r in df.select("k", C.made_hand_features(F.col("hole"), F.col("board")).alias("f")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(rows)}


def test_canonical_form_ignores_suit_names(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        cards = rng.sample(DECK, 5)
        for to in (("cdhs"), rng.choice(["dchs", "shdc", "hcsd"])):
            turned = [c[0] + to["cdhs".index(c[1])] for c in cards]
            rng.shuffle(turned[:2])
            rows.append((k, turned[:2], turned[2:]))
    df = spark.createDataFrame(rows, "k long, hole array<string>, board array<string>")
    forms = df.groupBy("k").agg(F.countDistinct(C.joint_canonical(F.col("hole"), F.col("board"))).alias("n"), F.countDistinct(C.canonical_board(F.col("board"))).alias("m"))
    assert all((r.n, r.m) == (1, 1) for r in forms.collect())


def test_card_features(spark):
    lit = lambda *c: F.array(*map(F.lit, c))
    assert one(spark, a=C.combo_169(F.lit("Td"), F.lit("Ad")), b=C.combo_169(F.lit("9c"), F.lit("9h")), c=C.combo_169(F.lit("2c"), F.lit("Kh"))) == ("ATs", "99", "K2o")
    with pytest.raises(Exception, match="not two cards"):
        one(spark, a=C.combo_169(F.lit("1d"), F.lit("Ad")))
    assert one(spark, a=C.board_texture(lit("2c", "9c", "Kc")), b=C.board_texture(lit("2c", "2d", "Kc")), c=C.board_texture(lit("2c", "9c", "Kd")), d=C.board_texture(lit("2c", "9h", "Kd")), e=C.board_texture(lit("2c"))) == ("monotone", "paired", "wet_two_tone", "dry_rainbow", "dry_rainbow")
    d = one(spark, f=C.draw_features(lit("8c", "9c"), lit("Tc", "7d", "2c"))).f
    assert d.flush_draw and d.open_ender and d.combo_draw and d.outs == 9 + 8 and d.ppot == 17 / 47
    g = one(spark, f=C.draw_features(lit("8c", "9d"), lit("Qh", "Jd", "2c"))).f
    assert g.gutshot and not g.open_ender and g.outs == 4
    h = one(spark, a=C.draw_features(lit("Jc", "Qd"), lit("Kh", "Ad", "2c")), b=C.draw_features(lit("8c", "9c"), lit("Tc", "7d", "2c", "3c", "4h")), c=C.draw_features(lit("Ac", "2d"), lit("4h", "3d", "Kc")))
    assert h.a.gutshot and not h.a.open_ender and h.b.outs == 0 and not h.b.flush_draw and h.c.gutshot and h.c.outs == 4


@settings(max_examples=20, deadline=None)
@given(st.floats(0, 3), st.floats(-1, 6))
def test_snap_takes_the_nearest_bucket(spark, frac, ratio):
    r = one(spark, a=X.snap(F.lit("bet"), F.lit(frac), F.lit(1.0), F.lit(False)), b=X.snap(F.lit("raise"), F.lit(0.5), F.lit(ratio), F.lit(False)))
    assert r.a == ("bet_overbet" if frac >= 1.75 else min(X.BETS, key=lambda b: abs(b[0] - frac))[1])
    assert r.b == min(X.RAISES, key=lambda b: abs(b[0] - ratio))[1]


def test_labels_keys_and_distributions(spark):
    r = one(spark, a=X.snap(F.lit("raise"), F.lit(None).cast("double"), F.lit(-1.0), F.lit(False)), b=X.label_preflop(F.lit("raise"), F.lit("srp"), F.lit("OOP"), F.lit("BB")), c=X.label_preflop(F.lit("call"), F.lit("srp"), F.lit("OOP"), F.lit("BB")), d=X.dp_index(F.lit("h_dp12")), e=X.parent_id(F.lit("h_dp12")))
    assert r == ("raise_min", "3bet_4x", "call", 12, "h")
    m = F.create_map(F.lit("fold"), F.lit(0.7), F.lit("x"), F.lit(-0.1))
    assert one(spark, a=P.dist_errors(m, ["fold"])).a == ["unknown", "negative", "sum"]
    legal = one(spark, a=P.filter_legal(F.create_map(F.lit("fold"), F.lit(0.2), F.lit("bet"), F.lit(0.6)), F.array(F.lit("fold")), F.lit("check")), b=P.filter_legal(F.create_map(F.lit("bet"), F.lit(1.0)), F.array(F.lit("fold")), F.lit("check")))
    assert legal.a == {"fold": 1.0} and legal.b == {"check": 1.0}


def test_state_survives_a_restart(spark, tmp_path):
    from decilog.streaming import stream as ST

    source, path, state = (str(tmp_path / n) for n in ("in", "table", "log"))
    want = {}
    for run in range(3):
        rows = [(f"k{k % 7}", 10 * run + k, run) for k in range(5)]
        for k, n, r in rows:
            want[k] = (n, r)
        spark.createDataFrame(rows, "key string, n long, run int").coalesce(1).write.parquet(f"{source}/{run}")
        s = spark.readStream.schema("key string, n long, run int").option("recursiveFileLookup", "true").parquet(source)
        got = ST.maintain_state(s, path, state, ["key"], "n", buckets=3)
        assert {r.key: (r.n, r.run) for r in got.collect()} == want
    before = {r.key: r.n for r in ST.state_table(spark, path, got.schema, before=1).collect()}
    assert before == {f"k{k}": k for k in range(5)}


def test_places_of_an_ordered_frame(spark, tmp_path):
    df = spark.range(1000).select((1000 - F.col("id")).alias("x")).repartition(7).orderBy("x")
    assert sorted((r.x, r.place) for r in R.with_place(df, str(tmp_path / "o")).collect()) == [(k, k) for k in range(1, 1001)]


def test_two_sided_product_is_spread_over_blocks(spark):
    df = spark.range(900).selectExpr("id % 2 AS side", "id AS item", "CAST(id AS DOUBLE) AS w", "CASE WHEN id < 840 THEN 'a' WHEN id < 860 THEN 'b' END AS brand")
    df = df.unionByName(spark.createDataFrame([(0, 7, 1.0, "one side")], "side long, item long, w double, brand string"))
    got = J.bounded_product(df, ["brand"], "side", "item", "w", block_rows=50)
    rows = [(r.brand, r.item_0, r.item_1, r.weight) for r in got.collect()]
    want = {(b, x, y, float(x * y)) for b, ids in (("a", range(840)), ("b", range(840, 860))) for x in ids for y in ids if x % 2 == 0 and y % 2 == 1}
    assert len(rows) == len(want) and set(rows) == want
    # one key's product is many tasks
    assert got.where("brand = 'a'").select(F.spark_partition_id().alias("p")).distinct().count() > 4


def vectors(spark, n, parts, seed=3, dims=64):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, k % parts, rng.normal(size=dims).tolist()) for k in range(n)], "id long, part int, vec array<float>")


def test_cells_reach_their_recall_within_partitions(spark):
    """Of rows that a fit on a small sample has not seen, among the rows of their partition alone."""
    df = vectors(spark, 4000, 4)
    asked = df.where("id % 20 = 0")
    cells = N.fit_cells(df, max_sample=800, keys=["part"])
    near = {(r.query, r.nb) for r in N.knn_cells(asked, df, ["part"], cells).collect()}
    exact = {(r.query, r.nb) for r in N.knn(asked, df, ["part"]).collect()}
    assert len(exact) == 2000 and len(near & exact) >= 0.9 * len(exact)
    assert cells.probes < len(cells.centroids)


def test_hashed_neighbours_make_no_rows_of_pairs(spark):
    df = vectors(spark, 300, 2, dims=8)
    got = N.knn_lsh(df, df, ["part"], 5, tables=3, planes=2, dims=8)
    m = np.array([r.vec for r in df.orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    signs = m @ np.random.default_rng(5).normal(size=(3, 2, 8)).round(4).reshape(-1, 8).T > 0
    codes = signs.reshape(300, 3, 2) @ np.array([1, 2])
    want = set()
    for q in range(300):
        may = [c for c in range(300) if c != q and c % 2 == q % 2 and (codes[c] == codes[q]).any()]
        want |= {(q, c, k + 1) for k, c in enumerate(sorted(may, key=lambda c: (1 - m[q] @ m[c], c))[:5])}
    assert {(r.query, r.nb, r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and plan.count("Join") <= 4  # only with the blocks' counts


def test_nearest_holds_few_candidates_and_keeps_ties_in_order():
    rng = np.random.default_rng(1)
    for sims in (rng.normal(size=(40, 5000)), rng.integers(0, 3, (40, 5000)).astype(float), np.full((3, 700), -np.inf), rng.normal(size=(4, 7))):
        sims[:, ::5] = -np.inf
        at, nb, value = N.nearest(sims, 10)
        for row in range(len(sims)):
            want = [c for c in np.lexsort((np.arange(sims.shape[1]), -sims[row]))[:10] if np.isfinite(sims[row, c])]
            assert nb[at == row].tolist() == want and value[at == row].tolist() == sims[row, want].tolist()


def test_a_vector_that_is_no_number_takes_no_neighbours_away(spark):
    rows = [(k, 0, [float(k + 1), 1.0]) for k in range(6)] + [(6, 0, [math.nan, 1.0]), (7, 0, None)]
    df = spark.createDataFrame(rows, "id long, part int, vec array<double>")
    got = N.knn(df, df, ["part"], 2).collect()
    assert sorted({r.query for r in got}) == list(range(6)) and len(got) == 12 and all(r.nb < 6 for r in got)


def test_sweep_of_weights_equals_a_search_of_each(spark):
    df = vectors(spark, 400, 2, dims=6).withColumns({"a": F.array((F.col("id") % 5).cast("double")), "b": F.array((F.col("id") % 3).cast("double"), F.col("id") / 400)})
    settings = [("a", 0.0), ("a", 0.5), ("b", 0.0), ("b", 2.0)]
    got = {(r.setting, r.query, r.nb, r["rank"]) for r in N.knn_sweep(df, ["part"], {"a": ["a"], "b": ["b"]}, settings, 4, block_rows=90).collect()}
    for number, (name, w) in enumerate(settings):
        one = df.select("id", "part", F.concat(F.transform("vec", lambda x: x.cast("double")), F.transform(name, lambda x: x * w)).alias("vec"))
        assert {x[1:] for x in got if x[0] == number} == {(r.query, r.nb, r["rank"]) for r in N.knn(one, one, ["part"], 4).collect()}


def test_card_steps_run_on_batches(spark):
    """Hands, draws and first forms go through one vector step each, with any number of cards; null sides have none."""
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        cards = rng.sample([r + s for r in C.RANKS for s in C.SUITS], 7)
        rows.append((cards[:2], cards[2 : 2 + rng.choice([0, 3, 4, 5])]))
    df = spark.createDataFrame([*rows, (None, ["As", "Kd"]), (["As"], None), (["xx", "As"], ["Kd"])], "hole array<string>, board array<string>")
    hole, board = F.col("hole"), F.col("board")
    got = df.select("hole", "board", C.joint_canonical(hole, board).alias("a"), C._joint_canonical_of_any(hole, board).alias("b"), C.made_hand_features(hole, board).alias("m"), C.draw_features(hole, board).alias("d"), C.made_hand(hole, board).alias("c"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") >= 1
    for r in got.collect():
        assert r.a == r.b
        if r.board is None or r.hole is None:
            assert r.m.rank_category == 0 and r.d.outs == 0
        elif len(r.board) >= 3:
            assert r.m.rank_category == r.c
