"""Decision points from a log of a hand's events, as windows per hand.

Events have hand, seq (a total order within the hand), street, actor and action. What
is known *before* an event comes from frames that end one row before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREETS = ["preflop", "flop", "turn", "river"]
#: Seats in the order in which they act after and before the flop.
AFTER_FLOP = ["SB", "BB", "UTG", "MP", "CO", "BTN"]
BEFORE_FLOP = ["UTG", "MP", "CO", "BTN", "SB", "BB"]
RAISES = ["raise", "allin"]


def rank_in(order: list[str], c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), c)


def hand_window(hand: str = "hand_id", *more: str):
    return Window.partitionBy(hand, *more).orderBy("seq")


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def exclusion_reason(table_size: Column, straddled: Column) -> Column:
    """Why a hand is left out, the first that holds; null if it stays."""
    return F.when(table_size == 2, "heads_up").when(table_size > 6, "too_many_seats").when(straddled, "straddle")


def explode_events(hands: DataFrame, streets: list[str], hand: str = "hand_id") -> DataFrame:
    """One row per event of the nested per-street arrays, numbered through the hand."""

    def tagged_with(street: str) -> Column:
        return F.transform(street, lambda e: F.struct(F.lit(street).alias("street"), e.alias("event")))

    tagged = list(map(tagged_with, streets))
    return hands.select(hand, F.posexplode(F.concat(*tagged)).alias("seq", "x")).select(hand, "seq", "x.street", "x.event.*")


def hero_decisions(events: DataFrame, hero: Column, posts: tuple[str, ...] = ("post",)) -> DataFrame:
    """The hero's own choices: not the forced posts. Apply after the windows."""
    return events.where(hero & ~F.col("action").isin(*posts))


def with_stack_before(events: DataFrame, stack: str = "stack_after", amount: str = "amount") -> DataFrame:
    """Stack before the action, and the seat's last known stack from earlier events."""
    known = F.last(stack, ignorenulls=True).over(before(hand_window("hand_id", "actor")))
    return events.withColumns({"stack_before": F.col(stack) + F.col(amount), "stack_known": known})


def with_active_players(events: DataFrame) -> DataFrame:
    """Seats of the hand less those that folded before; decisions with one seat left are dropped."""
    seats = F.collect_set("actor").over(Window.partitionBy("hand_id"))
    folded = F.collect_set(F.when(F.col("action") == "fold", F.col("actor"))).over(before(hand_window()))
    return events.withColumn("active", F.array_sort(F.array_except(seats, folded))).withColumn("n_active", F.size("active").cast("long")).where("n_active > 1")


def with_facing(events: DataFrame) -> DataFrame:
    """What the previous event of the street leaves: cold, check_to, bet_to or raise_to; its seat and amount."""
    w = hand_window("hand_id", "street")
    prev = F.lag("action").over(w)
    kind = F.when(prev.isNull(), "cold").when(prev.isin("check", "call", "fold"), "check_to").when(prev == "bet", "bet_to").otherwise("raise_to")
    return events.withColumns({"facing": kind, "facing_pos": F.lag("actor").over(w), "facing_size": F.lag("amount").over(w)})


def with_pot_before(events: DataFrame, blinds: int = 3) -> DataFrame:
    """Chips put in before the event, with the blinds."""
    return events.withColumn("pot_before", F.coalesce(F.sum("amount").over(before(hand_window())), F.lit(0)) + blinds)


def with_aggressor(events: DataFrame, as_of: bool = True) -> DataFrame:
    """The last seat to bet or raise before the flop: up to the event, or over the whole street."""
    seat = F.when((F.col("street") == "preflop") & F.col("action").isin("bet", *RAISES), F.col("actor"))
    w = before(hand_window()) if as_of else hand_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = events.withColumn("aggressor", F.last(seat, ignorenulls=True).over(w))
    return got.withColumn("was_aggressor", F.coalesce(F.col("aggressor") == F.col("actor"), F.lit(False)))


def pot_type(raises: Column) -> Column:
    return F.when(raises == 0, "limp").when(raises == 1, "srp").when(raises == 2, "3bet").when(raises == 3, "4bet").otherwise("5bet+")


def with_pot_type(events: DataFrame) -> DataFrame:
    """By the raises before: those so far on the first street, all of them later."""
    raised = F.sum(((F.col("street") == "preflop") & F.col("action").isin(*RAISES)).cast("long"))
    live = F.coalesce(raised.over(before(hand_window())), F.lit(0))
    whole = raised.over(Window.partitionBy("hand_id"))
    return events.withColumn("pot_type", pot_type(F.when(F.col("street") == "preflop", live).otherwise(whole)))


def with_pos_rel(events: DataFrame) -> DataFrame:
    """IP or OOP. ``events`` has active and aggressor.

    After the flop IP is the last active seat. Before it the last raiser's seat
    decides, and without one the two late seats are IP.
    """
    me = rank_in(AFTER_FLOP, F.col("actor"))
    last = F.array_max(F.transform("active", lambda s: rank_in(AFTER_FLOP, s)))
    early = F.when(F.col("aggressor").isNotNull(), me > rank_in(AFTER_FLOP, F.col("aggressor"))).otherwise(F.col("actor").isin("CO", "BTN"))
    return events.withColumn("pos_rel", F.when(F.when(F.col("street") == "preflop", early).otherwise(me == last), "IP").otherwise("OOP"))


def with_committed(events: DataFrame) -> DataFrame:
    """Chips that the seat had put in on the street before, and what the event adds.

    A raise names the total it goes to, so it adds that less what is in already.
    """
    w = hand_window("hand_id", "street", "actor")
    top = F.coalesce(F.max(F.when(F.col("action") == "raise", F.col("amount"))).over(before(w)), F.lit(0))
    plain = F.coalesce(F.sum(F.when(F.col("action") != "raise", F.col("amount"))).over(before(w)), F.lit(0))
    got = events.withColumn("committed", F.greatest(top, plain))
    return got.withColumn("added", F.when(F.col("action") == "raise", F.greatest(F.col("amount") - F.col("committed"), F.lit(0))).otherwise(F.col("amount")))


def with_actor_order(events: DataFrame) -> DataFrame:
    """Distinct seats that acted before on the street, plus one."""
    seen = F.collect_set("actor").over(before(hand_window("hand_id", "street")))
    return events.withColumn("actor_order", F.size(F.array_remove(seen, F.col("actor"))).cast("long") + 1)


def with_opponents(events: DataFrame) -> DataFrame:
    """The other active seats in order of acting, and the one seat if there is just one."""
    others = F.array_remove("active", F.col("actor"))
    ordered = F.transform(F.array_sort(F.transform(others, lambda s: F.struct(rank_in(BEFORE_FLOP, s).alias("r"), s.alias("s")))), lambda x: x["s"])
    return events.withColumn("opponents", ordered).withColumn("villain", F.when(F.size("opponents") == 1, F.col("opponents")[0]))


def with_history(events: DataFrame) -> DataFrame:
    """``seat:action`` of the street's earlier events, in order."""
    got = F.collect_list(F.concat("actor", F.lit(":"), "action")).over(before(hand_window("hand_id", "street")))
    return events.withColumn("history", got)


def with_size_ratios(df: DataFrame) -> DataFrame:
    """facing / pot, amount / pot (null without a pot), and amount / facing with -1 for unknown."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return df.withColumns(
        {"facing_frac": ratio("facing_size", "pot_before"), "size_frac": ratio("amount", "pot_before"), "raise_ratio": F.coalesce(ratio("amount", "facing_size"), F.lit(-1.0))}
    )


def to_bb(c: Column, bb: Column) -> Column:
    """In big blinds at 3 decimals; null unless the blind is positive."""
    return F.when(bb > 0, F.round(c / bb, 3))


def stake_label(bb: Column) -> Column:
    return F.concat(F.lit("NL"), bb.cast("string"))


def with_decision_id(df: DataFrame) -> DataFrame:
    """Index of the decision among the hand's remaining rows, and its id."""
    got = df.withColumn("decision_idx", (F.row_number().over(hand_window()) - 1).cast("long"))
    return got.withColumn("id", F.concat(F.col("hand_id").cast("string"), F.lit("_dp"), F.col("decision_idx").cast("string")))


def spr_x100(spr: Column) -> Column:
    return F.coalesce(F.round(spr * 100).cast("long"), F.lit(-1))


def rebuild_replay(events: DataFrame) -> DataFrame:
    """Per event: seats folded before, chips of the seat so far, and the pot's next change."""
    folded = F.size(F.collect_set(F.when(F.col("action") == "fold", F.col("actor"))).over(before(hand_window()))).cast("long")
    put = F.coalesce(F.sum("amount").over(before(hand_window("hand_id", "actor"))), F.lit(0))
    return events.withColumns({"folded_before": folded, "put_before": put, "next_amount": F.lead("amount").over(hand_window())})
