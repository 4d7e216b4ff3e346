"""Tables that are kept between runs: state with manifests, pinned versions, the vector index, and percentiles by ranges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from decilog.operators import evaluate as E
from decilog.operators import knn as K
from decilog.operators import metrics as M
from decilog.operators.index import VectorIndex
from decilog.streaming import stream as T


def folders(path):
    return sorted(d for top, dirs, _ in os.walk(path) for d in dirs if d.startswith("_version="))


def test_state_keeps_two_manifests_and_their_rows(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "table", "log"))
    want = {}
    for batch in range(9):
        rows = [(f"k{(batch * 5 + j) % 13}", batch * 10 + j) for j in range(5)]
        want.update({k: v for k, v in rows})
        spark.createDataFrame(rows, "key string, v long").coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema("key string, v long").parquet(source)
        got = T.maintain_state(s, path, state, ["key"], "v", buckets=4)
        assert {r.key: r.v for r in got.collect()} == want
    assert len(folders(f"{path}/rows")) <= 2 * 4 and len(os.listdir(f"{path}/manifest")) - sum(n.startswith("_") or n.startswith(".") for n in os.listdir(f"{path}/manifest")) == 2
    # a batch that is run again: its log entry is lost, its rows are not doubled
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    os.remove(f"{state}/commits/{last}")
    if os.path.exists(f"{state}/commits/.{last}.crc"):
        os.remove(f"{state}/commits/.{last}.crc")
    again = T.maintain_state(spark.readStream.schema("key string, v long").parquet(source), path, state, ["key"], "v", buckets=4)
    assert {r.key: r.v for r in again.collect()} == want


def test_late_rows_know_the_newest_time_without_all_batches(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "split", "log"))
    days = [5, 20, 3, 30, 8, 29]
    for k, day in enumerate(days):
        spark.sql(f"SELECT 's' AS source, TIMESTAMP'2024-01-{day:02d} 00:00:00' AS ts, {k} AS k").write.mode("append").parquet(source)
        s = spark.readStream.schema("source string, ts timestamp, k int").parquet(source)
        kept, late = T.quarantine_late(s, path, state, "ts", "source", "5 DAYS")
    assert sorted(r.k for r in late.collect()) == [2, 4] and sorted(r.k for r in kept.collect()) == [0, 1, 3, 5]
    assert sum(n.startswith("batch=") for n in os.listdir(f"{path}/newest")) == 2


def test_a_batch_keeps_the_version_it_was_scored_with(spark, tmp_path):
    source, versions, corpus, path, state = (str(tmp_path / n) for n in ("in", "versions", "corpus", "out", "log"))
    spark.createDataFrame([(1, 0, 0), (2, 15, 0), (3, 0, 15)], "nb long, added_at long, removed_at long").write.parquet(corpus)
    score = lambda batch, then: batch.crossJoin(then.agg(F.array_sort(F.collect_list("nb")).alias("seen")))

    def run():
        s = spark.readStream.schema("id long").parquet(source)
        return {r.id: (r.version, r.seen) for r in T.score_versioned(s, versions, corpus, score, path, state).collect()}

    spark.createDataFrame([(0, 10)], "version long, cutoff_ts long").write.mode("append").parquet(versions)
    spark.createDataFrame([(1,)], "id long").write.mode("append").parquet(source)
    assert run() == {1: (0, [1, 3])}
    spark.createDataFrame([(1, 20)], "version long, cutoff_ts long").write.mode("append").parquet(versions)
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".").startswith("0"):
            os.remove(f"{state}/commits/{name}")  # the first batch runs again
    assert run() == {1: (0, [1, 3])}
    spark.createDataFrame([(2,)], "id long").write.mode("append").parquet(source)
    assert run() == {1: (0, [1, 3]), 2: (1, [1, 2])}


def test_index_adds_removes_and_splits(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    vec = np.concatenate([c + 0.3 * rng.normal(size=(60, 8)) for c in centres])
    rows = [(k, v.tolist(), k % 2, k * 37 % 720) for k, v in enumerate(vec)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, part long, added_at long").cache()
    first = df.where("id % 4 <> 0")
    index = VectorIndex.build(first, str(tmp_path / "index"), ["part"], k=5, recall=0.97)

    def recall(held, **kw):
        exact = {(r["query"], r.nb) for r in K.knn(df, held, ["part"], 5).collect()}
        found = {(r["query"], r.nb) for r in index.search(df, 5, **kw).collect()}
        assert len(found) <= len(exact)
        return len(exact & found) / len(exact)

    assert recall(first) >= 0.9
    assert index.add(df.where("id % 4 = 0")) == 1 and recall(df) >= 0.9
    index = VectorIndex.load(spark, str(tmp_path / "index"), ["part"])
    index.remove(df.where("id % 7 = 0").select("id"), 1000)
    before = len(index.cells()[0])
    version = index.split(30)
    sizes = {r.cell: r.n for r in index.written("rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    live = set(index.cells()[0].tolist())
    assert version == 3 and len(live) > before and sum(sizes[c] for c in live) == len(rows)
    assert recall(df.where("id % 7 <> 0")) >= 0.9 and recall(df, at=999) >= 0.9 and recall(df.where("added_at <= 400"), at=400) >= 0.9
    assert recall(first, version=0) >= 0.9
    df.limit(5).write.parquet(str(tmp_path / "index" / "rows" / "version=9"))  # of a change that failed half way
    assert index.version() == 3 and sum(1 for _ in index.written("rows").collect()) == sum(sizes.values())


def test_sweep_equals_separate_searches(spark):
    rng = np.random.default_rng(5)
    vec, one, two = rng.normal(size=(60, 5)), rng.normal(size=(60, 1)), rng.normal(size=(60, 3))
    vec[7] = one[7] = two[7] = 0
    rows = [(k, vec[k].tolist(), one[k].tolist(), two[k].tolist(), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, a array<double>, b array<double>, part long")
    settings = [("a", 0.0), ("a", 2.0), ("b", 0.5)]
    got = K.knn_sweep(df, ["part"], {"a": ["a"], "b": ["b"]}, settings, 4, block_rows=9).collect()
    for number, (name, weight) in enumerate(settings):
        whole = df.withColumn("vec", F.concat("vec", F.transform(name, lambda x: x * weight)))
        want = {(r["query"], r["rank"]): (r.nb, r.distance) for r in K.knn(whole, whole, ["part"], 4).collect()}
        own = {(r["query"], r["rank"]): (r.nb, r.distance) for r in got if r.setting == number}
        assert own.keys() == want.keys() and all(own[k][0] == want[k][0] and abs(own[k][1] - want[k][1]) < 1e-9 for k in own if k[0] != 7)


def test_masked_loo_by_hand(spark):
    rows = [(0, [1.0, 0.0], "call", True, "x"), (1, [1.0, 0.1], "call", True, "x"), (2, [1.0, 0.2], "bet", False, "y"), (3, [0.0, 1.0], "check", False, "y")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, action string, facing boolean, pair string").withColumn("part", F.lit(0))
    sims = spark.createDataFrame([("x", "x", 1.0), ("y", "y", 1.0), ("x", "y", 0.5), ("y", "x", 0.5)], "a string, b string, sim double")
    r = E.masked_loo(df, ["part"], {True: ["fold", "call"], False: ["check", "bet"]}, {True: "fold", False: "check"}, pair_sims=sims, k=1).first()
    # 0 sees 1's call; 1 sees 2's bet, which is not legal: it folds; 2 sees 1's call and checks; 3 sees 2's bet
    assert (r.rows, r.loss, r.n_sensitive, r.coverage) == (4, 0.75, 2, 1.0) and r.sensitive_loss == 1.0
    assert r.fidelity == pytest.approx((1 + 0.5 + 0.5 + 1) / 4)
    skipped = E.masked_loo(df, ["part"], {True: [], False: []}, {True: "fold", False: "check"}, k=4).first()
    assert (skipped.rows, skipped.coverage) == (0, 0.0)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=500), "ties": np.repeat([1.0, 2.0], [99, 1]), "wide": 10.0 ** rng.uniform(-30, 30, 200), "one": np.array([4.0])}
    rows = [(k, float(x)) for k, own in values.items() for x in own] + [("null", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {(r.k, r.p): r.value for r in M.exact_percentiles(df, ["k"], "x", [0.0, 0.5, 0.99, 1.0], bins=16).collect()}
    assert got.keys() == {(k, p) for k in values for p in (0.0, 0.5, 0.99, 1.0)}
    for (k, p), v in got.items():
        assert v == pytest.approx(float(np.percentile(values[k], 100 * p)), rel=1e-9)
    assert M.exact_percentiles(df.limit(0), ["k"], "x", [0.5]).collect() == []
