"""Equal vectors in the neighbour search tie, and the smaller id goes first."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from decilog.operators import knn as K


@pytest.mark.parametrize("block_rows", [20_000, 500])
def test_copies_of_a_vector_go_by_id(spark, block_rows):
    base, copies, dims, k = 400, 5, 64, 7
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(base, dims)).astype(np.float32)
    n = base * copies - 7
    rows = pd.DataFrame({"id": np.arange(n), "part": 0, "vec": [vectors[i % base].tolist() for i in range(n)]})
    df = spark.createDataFrame(rows, "id long, part int, vec array<float>")
    got = K.knn(df.where(F.col("id") < base), df, ["part"], k, block_rows=block_rows).toPandas()
    found = {q: list(g.sort_values("rank")["nb"]) for q, g in got.groupby("query")}
    m = vectors.astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(base):
        near = np.argsort(-(m @ m[q]), kind="stable")[:k]
        want = [c for v in near for c in range(v, n, base) if c != q][:k]
        assert found[q] == want


def test_distinct_rows_and_paired_products_of_odd_matrices():
    m = np.array([[0.0, 1.0], [-0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])
    first, place = K.distinct(m)
    assert len(first) == 2 and (m[first][place] == m).all()
    assert len(K.distinct(np.zeros((3, 0)))[0]) == 1
    assert K.paired(m, m, np.array([0, 2]), np.array([3, 3])).tolist() == [1.0, 0.0]
    none = np.zeros(0, int)
    assert K.paired(m, m, none, none).tolist() == []
