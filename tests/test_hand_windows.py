"""Windows over hands: what a task holds, and the vectors that are built on them."""

from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from decilog.functions import cards as C
from decilog.operators import vectors as V
from decilog.plans import registry
from decilog.plans.bindings import ordered_moves
from decilog.plans.features import spots, strength, wide

registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_later_vector_moves_its_rows_once(spark):
    """One shuffle by hand; equities, blockers and cards come without another."""
    text = plan(registry.QUERIES["f14_later_vector"](spark, SF))
    assert "SortMergeJoin" not in text and "hashpartitioning(hand_id" not in text and "hashpartitioning(eq_key" not in text
    assert text.count("FileScan parquet") == 3  # the moves, the equities and their mean


def test_first_vector_moves_its_rows_once(spark):
    text = plan(registry.QUERIES["f14_first_vector"](spark, SF))
    assert "hashpartitioning(hand_id" not in text and "hashpartitioning(eq_key" not in text
    scans = [line for line in text.splitlines() if "combo" in line.lower() or "raise_error" in line.lower()]
    assert not any("l_partkey" in line for line in scans)  # classes are named of pairs of cards, not of lines


@pytest.mark.parametrize("street", ["street = 'preflop'", "street <> 'preflop'"])
def test_vector_of_a_row_is_its_entries(spark, street):
    """The array that the operator makes has what the query lists, by rounding to decimals too."""
    df = spots(spark, SF, street).withColumns({"value_blocked": F.lit(0.25), "range_blocked": F.lit(None).cast("double")}).limit(200).localCheckpoint()
    entries = V.first_entries(strength) if street.endswith("= 'preflop'") and "<>" not in street else V.later_entries()
    rows = {(r.hand_id, r.seq): r for r in wide(V.with_cards(df), entries).collect()}
    made = V.with_vector(df, strength).select("hand_id", "seq", F.transform("vec", lambda x: F.round(x, 12)).alias("vec")).collect()
    assert len(made) == len(rows) == 200
    for r in made:
        want = rows[r.hand_id, r.seq]
        assert len(r.vec) == len(entries)
        assert all(0 <= x <= 1 and abs(x - want[f"v{k}"]) <= 1.5e-12 for k, x in enumerate(r.vec))


def test_board_shapes(spark):
    pick = Random(3)
    deck = [r + s for s in C.SUITS for r in C.RANKS]
    boards = [pick.sample(deck, n) for n in (0, 1, 2, 3, 4, 5) for _ in range(60)]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(boards)], "id long, board array<string>")
    got = {r.id: r.s for r in df.select("id", C.board_shape(F.col("board")).alias("s")).collect()}
    for k, b in enumerate(boards):
        ranks, suits = [C.RANKS.index(c[0]) for c in b], [c[1] for c in b]
        near = any(max(x) - min(x) <= 4 for x in combinations(sorted(set(ranks)), 3))
        in_row = any(x[2] - x[0] == 2 for x in combinations(sorted(set(ranks)), 3))
        want = (len(b), max((suits.count(s) for s in suits), default=0), len(set(ranks)) < len(b), near, in_row, max(ranks, default=0))
        assert tuple(got[k]) == want, b


def test_card_of_a_number(spark):
    got = [r.c for r in spark.range(53).orderBy("id").select(C.card(F.col("id")).alias("c")).collect()]
    assert got == [r + s for s in C.SUITS for r in C.RANKS] + [None]


def test_tasks_of_hand_windows_grow_in_number_not_in_rows(spark):
    """More lines are more tasks, whatever the session's shuffle partitions (4 here), up to the last window; hands stay whole."""
    moves = ordered_moves(spark, SF, 500)
    got = V.with_street_history(moves).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("hand_id").alias("hands")).collect()
    assert sum(r.n for r in got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(got) >= 10 and max(r.n for r in got) <= 1000
    assert sum(len(r.hands) for r in got) == len(set().union(*[r.hands for r in got]))


@pytest.mark.parametrize("name", ["f09_street_history", "f09_betting_features", "f14_feature_vector", "f28_preflop_roles"])
def test_queries_over_hands_use_those_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan(registry.QUERIES[name](spark, SF))
