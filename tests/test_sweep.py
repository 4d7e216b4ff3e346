"""The neighbour search under several vectors at once, against brute force."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from decilog.operators import knn as K

SETTINGS = [("a", 0.0), ("a", 0.5), ("b", 2.0), ("b", 0.0)]


def brute(ids, parts, vec, blocks, k):
    """Each setting's neighbours by all pairs, where equal vectors tie: (setting, query) to ids in order."""
    want = {}
    for number, (name, weight) in enumerate(SETTINGS):
        m = np.concatenate([vec, blocks[name] * weight], axis=1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(length == 0, 1, length)
        first, own = K.distinct(m)
        for q in range(len(ids)):
            far = 1 - (m[first] * m[q]).sum(axis=1)[own]
            may = [c for c in np.lexsort((ids, far)) if parts[c] == parts[q] and ids[c] != ids[q]]
            want[number, ids[q]] = [ids[c] for c in may[:k]]
    return want


def found(spark, ids, parts, vec, blocks, k, **kw):
    kind = "string" if isinstance(ids[0], str) else "long"
    rows = pd.DataFrame({"id": ids, "part": parts, "vec": vec.tolist(), "a": blocks["a"].tolist(), "b": blocks["b"].tolist()})
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1), f"id {kind}, part long, vec array<float>, a array<double>, b array<double>")
    got = K.knn_sweep(df, ["part"], {"a": ["a"], "b": ["b"]}, SETTINGS, k, **kw).toPandas()
    return {key: list(g.sort_values("rank")["nb"]) for key, g in got.groupby(["setting", "query"])}


@pytest.mark.parametrize("block_rows, met, text", [(20_000, 16_384, False), (150, 64, True)])
def test_copies_of_a_vector_go_by_id(spark, monkeypatch, block_rows, met, text):
    """One vector in a third of the rows, others five times, zeros, and entries that differ only beside the base."""
    monkeypatch.setattr(K, "SWEEP_ROWS", met)
    rng = np.random.default_rng(3)
    n, k = 900, 6
    vec = rng.normal(size=(180, 64)).astype(np.float32)[np.arange(n) % 180]
    vec[::3] = vec[0]
    vec[[5, 400, 401]] = 0
    ids = [f"r{x:04}" for x in range(n)] if text else list(range(n))
    at = np.arange(n)
    blocks = {"a": (at % 5)[:, None].astype(float), "b": np.stack([at % 3, at * 13 % 400 / 100], axis=1)}
    parts = (at % 180 % 2).tolist()
    got = found(spark, ids, parts, vec.astype(float), blocks, k, block_rows=block_rows)
    assert got == brute(ids, parts, vec.astype(float), blocks, k)


def test_rows_that_are_no_numbers_have_no_neighbours_and_a_few_rows_have_all(spark):
    rows = [(k, 0, [float(k + 1), 1.0], [1.0]) for k in range(5)] + [(5, 0, [math.nan, 1.0], [1.0]), (6, 0, None, [1.0]), (None, 0, [1.0, 1.0], [1.0])]
    rows += [(7, 1, [1.0, 2.0], [0.0]), (8, 2, [0.0, 0.0], [0.0]), (9, 2, [0.0, 0.0], [0.0]), (10, 3, [1e-3, 0.0], [9.0]), (11, 3, [0.0, 1e-3], [9.0])]
    df = spark.createDataFrame(rows, "id long, part int, vec array<double>, a array<double>")
    got = K.knn_sweep(df, ["part"], {"a": ["a"]}, [("a", 1.0)], 8).collect()
    near = {}
    for r in got:
        near.setdefault(r.query, set()).add(r.nb)
    assert near == {**{k: set(range(5)) - {k} for k in range(5)}, 8: {9}, 9: {8}, 10: {11}, 11: {10}}


def test_an_id_in_two_rows_is_one_query(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], [0.0]), (1, 0, [0.0, 1.0], [0.0]), (2, 0, [1.0, 0.1], [0.0]), (3, 0, [0.1, 1.0], [0.0])], "id long, part int, vec array<double>, a array<double>")
    got = K.knn_sweep(df, ["part"], {"a": ["a"]}, [("a", 1.0)], 2).collect()
    assert sorted((r["rank"], r.nb) for r in got if r.query == 1) == [(1, 2), (2, 3)]


def test_neighbours_are_whole_when_a_task_ends(spark):
    """A block pair once gave k rows for each query and setting, which were merged: their number grew with the square of the table."""
    df = spark.range(400).selectExpr("id", "id % 2 AS part", "array(sin(id), cos(id * 7), sin(id * 3)) AS vec", "array(double(id % 5)) AS a")
    got = K.knn_sweep(df, ["part"], {"a": ["a"]}, [("a", 0.0), ("a", 0.5)], 4, block_rows=20)
    assert got.count() == 400 * 2 * 4
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_blocks_of_a_partition_are_as_many_tasks(spark):
    df = spark.range(600).selectExpr("id", "7 AS part", "array(sin(id), cos(id * 7), sin(id * 3)) AS vec", "array(double(id % 5)) AS a")
    got = K.knn_sweep(df, ["part"], {"a": ["a"]}, [("a", 0.5)], 4, block_rows=25)  # 24 blocks, 32 tasks
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 24


def test_what_a_block_holds_does_not_grow_with_the_rows_that_pass():
    rng = np.random.default_rng(2)

    def batch(first, n):
        vec = rng.normal(size=(n, 8)).astype(np.float32)
        of = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), of(vec), of(np.ones((n, 1)))], names=["id", "vec", "a"])

    def peak(batches):
        block = K.Sweep(["vec"], {"a": ["a"]}, [("", 0.0), ("a", 0.5)], 5, "id")
        block.asked.append(batch(0, 500))
        tracemalloc.start()
        for b in range(batches):
            block.meet(batch(b * 5000, 5000))
        assert sum(b.num_rows for b in block.found([0, 1])) == 500 * 2 * 5
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(24) < 1.2 * peak(6) < 60e6
