"""Work items of a spot, however many."""

from decilog.operators import corpus


def test_all_items_of_a_spot_are_listed(spark):
    rows = [("a", k) for k in range(2500)] + [("b", 7), ("b", None), (None, 1)]
    df = spark.createDataFrame(rows, "spot string, item long").repartition(3)
    got = corpus.group_spots(df, ["spot"], "item").collect()
    assert all(len(r["items"]) <= 1000 for r in got)
    listed = {s: [i for r in sorted(got, key=lambda r: r.chunk) if r.spot == s for i in r["items"]] for s in ("a", "b", None)}
    assert listed == {"a": list(range(2500)), "b": [7], None: [1]}
    assert {r.spot: r.n for r in got} == {"a": 2500, "b": 2, None: 1}
    assert corpus.spot_items(df, ["spot"], "item").count() == len(rows)
