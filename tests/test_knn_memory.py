"""What a block pair of the neighbour search holds in a Python worker."""

import tracemalloc

import numpy as np
import pandas as pd

from decilog.operators import knn as K


def block_function(spark, rows):
    """The function that a pair of blocks is given to, taken from the operator."""
    found = []

    class Side:
        def __init__(self, df):
            self.df = df

        def applyInPandas(self, f, schema):
            found.append(f)
            return spark.createDataFrame([], schema)

    df = spark.createDataFrame([(1, 0, [0.5] * 4)], "id long, part int, vec array<float>")
    group = type(df.groupBy("part"))
    plain = group.cogroup
    try:
        group.cogroup = lambda self, other: Side(other)
        K.knn(df, df, ["part"], 10, block_rows=rows)
    finally:
        group.cogroup = plain
    return found[0]


def test_block_pair_holds_little_beside_its_rows(spark):
    n, dims = 6000, 8
    block = block_function(spark, n)
    rng = np.random.default_rng(1)
    side = lambda first: pd.DataFrame({"id": np.arange(first, first + n), "vec": list(rng.normal(size=(n, dims)).astype(np.float32))})
    q, c = side(0), side(n)
    tracemalloc.start()
    got = block(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 10 * n
    assert peak < 60e6  # 1,024 queries' products with all rows, and their copies, were more
