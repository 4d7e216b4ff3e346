"""The two-sided product comes in an order in which little of it has to be written."""

import os

from decilog.operators import lookup as J


def test_products_are_written_in_few_bytes(spark, tmp_path):
    n = 2400
    df = spark.range(n).selectExpr("'a' AS brand", "id % 2 AS side", "id * 7919 % 100003 AS item", "900 + id * 31 % 211 / 10 AS w").repartition(3, "item")
    J.bounded_product(df, ["brand"], "side", "item", "w", block_rows=400).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.distinct().count() == got.count() == n * n // 4
    size = sum(os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.endswith(".parquet"))
    assert size < n * n // 4  # a byte a row; without the order more than two


def test_products_of_null_weights_and_of_equal_rows_stay(spark):
    rows = [(0, 1, 2.0), (0, 1, 2.0), (0, 2, None), (1, 5, 3.0), (1, 6, None), (2, 7, 1.0), (None, 8, 1.0)]
    df = spark.createDataFrame([("a", *r) for r in rows], "brand string, side int, item long, w double")
    got = J.bounded_product(df, ["brand"], "side", "item", "w", block_rows=1).collect()
    want = [(x, y, None if None in (v, w) else v * w) for s, x, v in rows if s == 0 for t, y, w in rows if t == 1]
    assert sorted([(r.item_0, r.item_1, r.weight) for r in got], key=repr) == sorted(want, key=repr)
