"""Whole feature vectors of decisions: 34 entries on the first street, 80 on the later ones.

Counts over the street's earlier events are windows of the hand; equities and blockers are
joins to tables. The vector of a row is then one expression over its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.functions import cards as C
from decilog.functions import features as X
from decilog.operators.extract import before, hand_window

#: Upper ends of the sizes faced, and what a first-street opponent's seat stands for.
FACED_SIZES = [0.125, 0.29, 0.41, 0.58, 0.705, 0.875, 1.25]
SEAT_GROUPS = [["BTN"], ["UTG"], ["MP", "CO"], ["SB", "BB"]]
FIRST_TIGHTNESS = {"UTG": 1.0, "MP": 0.67, "CO": 0.5, "BTN": 0.33, "SB": 0.5, "BB": 0.5}
#: Strength from which a hand class is premium.
PREMIUM = 6 / 7
BOLD = ("bet", "raise", "allin")


def with_street_history(events: DataFrame) -> DataFrame:
    """What came before on the street and before the flop: raises, and the seat's own checks, bets, bold actions and chips.

    Adds n_raises, own_checks, own_bets, own_bold, own_put, others_bold, first_raises, own_first_raises.
    """
    street, own = before(hand_window("hand_id", "street")), before(hand_window("hand_id", "street", "actor"))
    count = lambda test, w: F.coalesce(F.sum(test.cast("long")).over(w), F.lit(0))
    verb = F.col("action")
    first = (F.col("street") == "preflop") & verb.isin("raise", "allin")
    got = events.withColumns(
        {
            "n_raises": count(verb.isin("raise", "allin"), street), "own_checks": count(verb == "check", own), "own_bets": count(verb.isin("bet", "raise"), own), "own_bold": count(verb.isin(*BOLD), own),
            "own_put": F.coalesce(F.sum(F.when(verb.isin("call", *BOLD), F.col("amount"))).over(own), F.lit(0)), "_bold": count(verb.isin(*BOLD), street),
            "first_raises": count(first, before(hand_window())), "own_first_raises": count(first, before(hand_window("hand_id", "actor"))),
        }
    )
    return got.withColumn("others_bold", F.col("_bold") - F.col("own_bold")).drop("_bold")


def with_equity(df: DataFrame, equity: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with deciles (nine), variance, mean and ``equity_known``; rows without an entry get the mean of every column over all entries.

    equity: keys, deciles, variance, mean; one entry for each key.
    """
    population = equity.agg(F.array(*[F.avg(F.col("deciles")[k]) for k in range(9)]).alias("_deciles"), F.avg("variance").alias("_variance"), F.avg("mean").alias("_mean"))
    found = equity.select(*keys, "deciles", "variance", "mean")
    both = df.join(found, keys, "left").join(F.broadcast(population), how="cross").withColumn("equity_known", F.col("mean").isNotNull())  # one row
    return both.withColumns({c: F.coalesce(c, f"_{c}") for c in ("deciles", "variance", "mean")}).drop("_deciles", "_variance", "_mean")


def blocker_table(ranges: DataFrame, key: str, strength: Callable[[Column], Column]) -> DataFrame:
    """key, pair, value_blocked, range_blocked for each of the 1326 pairs of cards and each range.

    ranges: key, cls, w. A class's weight is spread over its pairs; a pair blocks those that
    share a card with it: what holds the one card and what holds the other, less the pair
    itself, which is in both. value_blocked is of the premium classes, weighted by strength.
    The table has 1326 rows a range, so rows that need it join two columns.
    """
    spark = ranges.sparkSession
    numbers = spark.range(52).select(F.col("id").alias("n"))
    pairs = numbers.join(numbers.select(F.col("n").alias("m")), F.col("n") < F.col("m")).select(C.card(F.col("n")).alias("a"), C.card(F.col("m")).alias("b"))
    pairs = pairs.select("a", "b", pair_key(F.array("a", "b")).alias("pair"), C.combo_169(F.col("a"), F.col("b")).alias("cls"))
    rank = strength(F.col("cls"))
    spread = ranges.where("w > 0").select(key, "cls", (F.col("w") / C.class_combos(F.col("cls"))).alias("w")).join(F.broadcast(pairs), "cls")
    spread = spread.select(key, "pair", "a", "b", "w", F.when(rank >= PREMIUM, F.col("w") * rank).otherwise(0.0).alias("v"))
    of_card = spread.select(key, F.explode(F.array("a", "b")).alias("card"), "w", "v").groupBy(key, "card").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    whole = spread.groupBy(key).agg(F.sum("w").alias("all_w"), F.sum("v").alias("all_v"))
    side = lambda c: of_card.select(key, F.col("card").alias(c), F.col("w").alias(f"w_{c}"), F.col("v").alias(f"v_{c}"))
    every = whole.join(F.broadcast(pairs.drop("cls")), how="cross")  # 1326 rows
    both = every.join(side("a"), [key, "a"], "left").join(side("b"), [key, "b"], "left").join(spread.select(key, "pair", "w", "v"), [key, "pair"], "left").fillna(0.0)
    share = lambda x: F.when(F.col(f"all_{x}") > 0, F.least((F.col(f"{x}_a") + F.col(f"{x}_b") - F.col(x)) / F.col(f"all_{x}"), F.lit(1.0))).otherwise(0.0)
    return both.select(key, "pair", share("v").alias("value_blocked"), share("w").alias("range_blocked"))


def pair_key(cards: Column) -> Column:
    return F.array_join(F.array_sort(cards), "")


def with_blockers(df: DataFrame, table: DataFrame, key: str, hole: str = "hole") -> DataFrame:
    """``df`` with value_blocked and range_blocked of its hole cards; 0 where the range is not known."""
    got = df.withColumn("pair", pair_key(F.col(hole))).join(table, [key, "pair"], "left").drop("pair")
    return got.fillna(0.0, ["value_blocked", "range_blocked"])


def flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def villain() -> Column:
    return F.coalesce("facing_pos", "aggressor")


def faced() -> Column:
    return F.coalesce("facing_frac", F.lit(0.0))


def draws_entries(draws: Column) -> list[Column]:
    """Eight: the five flags, both potentials, outs over twenty."""
    flags = [draws[c].cast("double") for c in ("flush_draw", "backdoor_flush", "open_ender", "gutshot", "combo_draw")]
    return [*flags, X.within(draws["ppot"]), X.within(draws["npot"]), X.within(draws["outs"] / 20)]


def made_entries(made: Column) -> list[Column]:
    """Six: class over eight, ranks over twelve, three flags."""
    return [made["rank_category"] / 8, made["pair_rank"] / 12, made["kicker"] / 12, *[made[c].cast("double") for c in ("is_set", "top_pair", "overpair")]]


def betting_entries() -> list[Column]:
    """Sixteen: place of the street, raises, own boldness, one-hot size faced (eight), own chips, three counts, check before a bet."""
    street = F.when(F.col("street") == "turn", 0.5).when(F.col("street") == "river", 1.0).otherwise(0.0)
    free = (faced() <= 0) | (F.col("facing") == "check_to")
    # a function over an array also keeps the 80 entries out of whole-stage code, whose one method for them is too long to be compiled to machine code
    over = F.size(F.filter(F.array(*map(F.lit, FACED_SIZES)), lambda top: top < faced()))
    place = F.when(free, 0).otherwise(F.least(over + 1, F.lit(7)))
    put = F.when(F.col("pot_before") > 0, X.within(F.col("own_put") / F.col("pot_before"))).otherwise(0.0)
    counts = [X.within(F.col(c) / 3) for c in ("own_checks", "own_bets", "others_bold")]
    return [street, X.within(F.col("n_raises") / 4), flag(F.col("own_bold") > 0), *[flag(place == k) for k in range(8)], put, *counts, flag((F.col("own_checks") > 0) & (F.col("others_bold") > 0) & (faced() > 0))]


def board_entries(shape: Column) -> list[Column]:
    """Seven, all 0 under three cards: flush possible, made; straight possible; paired; one suit; three ranks in a row over thirteen; highest rank."""
    tests = [shape["max_suit"] >= 3, shape["max_suit"] >= 4, shape["near"], shape["paired"], shape["max_suit"] == shape["n_cards"]]
    values = [*map(flag, tests), F.when(shape["in_row"], 3 / 13).otherwise(0.0), shape["high"] / 12]
    return [F.when(shape["n_cards"] >= 3, x).otherwise(0.0) for x in values]


#: What the cards tell, computed once for a row: columns that :func:`later_entries` reads.
CARD_COLUMNS = {"_draws": C.draw_features, "_made": C.made_hand_features, "_shape": lambda hole, board: C.board_shape(board)}


def with_cards(df: DataFrame) -> DataFrame:
    return df.withColumns({name: f(F.col("hole"), F.col("board")) for name, f in CARD_COLUMNS.items()})


def later_entries() -> list[Column]:
    """The 80 entries of the later streets, from the columns of the operators here and in ``extract`` and of :func:`with_cards`.

    Equity 12, draws 8, made hand 6, own seat 8, sizes 7, betting 16, first street 6, board 7, opponent 10.
    Of the first street's six the last four are 0, as nothing in the log tells them.
    Every entry is an expression of its own, without arrays or functions over them, so it is compiled.
    """
    equity = X.equity_entries(F.col("deciles"), F.col("variance"), F.col("mean"), F.col("street") == "river")
    own = X.hero_entries(F.col("actor"), F.col("pos_rel"), F.col("n_active"))
    sizes = X.pot_sizes(faced(), F.coalesce("spr", F.lit(0.0)), F.col("pot_before") / F.col("blind"), F.col("amount") / F.col("blind"), F.col("stack_after") / F.col("blind"), F.coalesce(F.col("actor") == F.col("aggressor"), F.lit(False)))
    first = [flag(F.col("actor") == F.col("aggressor")), X.within(F.col("first_raises") / 4), *[F.lit(0.0)] * 4]
    cards = [*draws_entries(F.col("_draws")), *made_entries(F.col("_made"))]
    return [X.entry(x) for x in (*equity, *cards, *own, *sizes, *betting_entries(), *first, *board_entries(F.col("_shape")), *X.villain_entries(villain(), F.col("actor"), F.col("aggressor")))]


def first_entries(strength: Callable[[Column], Column]) -> list[Column]:
    """The 34 entries of the first street: equity 6, hand class 5, own seat 9, sizes 3, betting 4, opponent 5, blockers 2.

    The opponent's tightness is the column ``tightness``, where it is known, else its seat's.
    """
    cls = C.combo_169(F.col("hole")[0], F.col("hole")[1])
    of = C.class_features(cls)
    equity = [*[F.col("deciles")[k] for k in (0, 2, 4, 6, 8)], F.col("mean")]
    hand = [F.when(of["pair"], (of["high"] - 2) / 12).otherwise(0.0), flag(of["suited"]), F.when(of["pair"], 0.0).otherwise(X.within(of["gap"] / 12)), flag(of["broadway"]), strength(cls)]
    own = [flag(F.col("pos_rel") == "IP"), *X.hot(F.col("actor"), X.SEATS), F.col("n_active") / 6, F.lit(0.0)]
    sizes = X.preflop_sizes(faced(), F.coalesce("spr", F.lit(0.0)), F.col("pot_before") / F.col("blind"))
    kind = F.when(F.col("facing") == "bet_to", 0.5).when(F.col("facing") == "raise_to", 1.0).otherwise(0.0)
    betting = [X.within(F.col("n_raises") / 4), flag(F.col("own_first_raises") > 0), kind, X.within(faced() / 5)]
    seats = [flag(villain().isin(*group)) for group in SEAT_GROUPS]
    tight = F.coalesce("tightness", *[F.when(villain() == s, F.lit(v)) for s, v in FIRST_TIGHTNESS.items()], F.lit(0.5))
    return [X.entry(x) for x in (*equity, *hand, *own, *sizes, *betting, *seats, tight, F.col("value_blocked"), F.col("range_blocked"))]


def with_vector(df: DataFrame, strength: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``vec``: each row's vector by its street, every entry within [0, 1]."""
    vec = F.when(F.col("street") == "preflop", F.array(*first_entries(strength))).otherwise(F.array(*later_entries()))
    return with_cards(df).withColumn("vec", vec).drop(*CARD_COLUMNS)
