"""Column expressions for keys, labels, buckets and bounded vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size buckets of bets (of the pot) and raises (of the bet faced).
BETS = [(0.25, "bet_25"), (0.33, "bet_33"), (0.50, "bet_50"), (0.75, "bet_75"), (1.00, "bet_100"), (1.50, "bet_150")]
RAISES = [(1.00, "raise_min"), (2.50, "raise_2_5x"), (3.00, "raise_3x"), (4.00, "raise_pot")]
#: The legal actions on the first and the later streets, free and facing a bet.
LEGAL = {
    (True, False): ["check", "open_2_2bb", "open_3bb", "allin"],
    (True, True): ["fold", "call", "3bet_3x", "3bet_4x", "4bet_2_5x", "allin"],
    (False, False): ["check", "bet_25", "bet_33", "bet_50", "bet_75", "bet_100", "bet_150", "bet_overbet", "allin"],
    (False, True): ["fold", "call", "raise_min", "raise_2_5x", "raise_3x", "raise_pot", "allin"],
}


def cluster_key(**columns: Column) -> Column:
    """``k=v|k=v`` in order of the names."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("?"))) for k, c in sorted(columns.items())])


def parse_key(key: Column) -> Column:
    """The map behind a cluster key."""
    return F.str_to_map(key, F.lit(r"\|"), F.lit("="))


def bucket_of(key: Column, name: str) -> Column:
    """One value of a cluster key, ``?`` without it."""
    return F.coalesce(F.try_element_at(parse_key(key), F.lit(name)), F.lit("?"))


def scenario_key(pot: Column, rel: Column, n: Column, aggressor: Column) -> Column:
    """``pot|rel|nN|seat:pfr``, or ``vNA`` without an aggressor."""
    return F.concat_ws("|", pot, rel, F.concat(F.lit("n"), n.cast("string")), F.coalesce(F.concat(aggressor, F.lit(":pfr")), F.lit("vNA")))


def parse_actions(tokens: Column) -> Column:
    """``seat:verb[:size]`` tokens of a line, ``/`` between streets, as structs (street, seat, stem, size)."""
    streets = F.split(tokens, "/")
    one = lambda t, k: F.struct(
        k.alias("street"), F.split_part(t, F.lit(":"), F.lit(1)).alias("seat"), F.lower(F.regexp_extract(t, r":([A-Za-z]+)", 1)).alias("stem"),
        F.regexp_extract(t, r"([0-9.]+)$", 1).try_cast("double").alias("size"),
    )
    return F.flatten(F.transform(streets, lambda s, k: F.transform(F.filter(F.split(s, " "), lambda t: t != ""), lambda t: one(t, k))))


def facing_size(tokens: Column, pot: Column) -> Column:
    """Size of the last token of a line, as a share of the pot; 0 if it has none."""
    last = F.element_at(F.split(tokens, " "), -1)
    return F.coalesce(F.regexp_extract(last, r"([0-9.]+)$", 1).try_cast("double") / F.nullif(pot, F.lit(0.0)), F.lit(0.0))


def label_preflop(stem: Column, pot: Column, rel: Column, pos: Column) -> Column:
    """Sized name of a first-street raise by the pot it meets; other stems stay."""
    sized = (
        F.when(pot.isNull() | pot.isin("limp", "unopened"), F.when(pos.isin("SB", "BB"), "open_3bb").otherwise("open_2_2bb"))
        .when(pot == "srp", F.when(rel == "OOP", "3bet_4x").otherwise("3bet_3x"))
        .when(pot == "3bet", "4bet_2_5x").otherwise("allin")
    )
    return F.when(stem == "raise", sized).otherwise(stem)


def nearest(x: Column, buckets: list[tuple[float, str]]) -> Column:
    """Name of the nearest bucket; of two equally near the smaller."""
    near = F.array_min(F.array(*[F.struct(F.abs(x - b).alias("d"), F.lit(k).alias("k")) for k, (b, _) in enumerate(buckets)]))
    return F.element_at(F.array(*[F.lit(n) for _, n in buckets]), near["k"] + 1)


def snap(stem: Column, frac: Column, ratio: Column, allin: Column, overbet: float = 1.75, strict: bool = False) -> Column:
    """Sized name of a later-street bet or raise; unknown sizes are 0.5 and 2.5, and a ratio of -1 is the least raise."""
    frac, ratio = F.coalesce(frac, F.lit(0.5)), F.coalesce(ratio, F.lit(2.5))
    bet = F.when(frac > overbet if strict else frac >= overbet, "bet_overbet").otherwise(nearest(frac, BETS))
    return F.when(stem.isin("bet", "raise") & allin, "allin").when(stem == "bet", bet).when(stem == "raise", nearest(ratio, RAISES)).otherwise(stem)


def quality(exploitability_pct: Column) -> Column:
    """max(0, 1 - pct / 100)."""
    return F.greatest(F.lit(0.0), 1 - exploitability_pct / 100)


def legal_actions(street: Column, facing: Column) -> Column:
    """The legal actions by street and bet faced."""
    free = F.coalesce(facing, F.lit(0)) <= 0
    names = lambda key: F.array(*map(F.lit, LEGAL[key]))
    first = F.when(free, names((True, False))).otherwise(names((True, True)))
    later = F.when(free, names((False, False))).otherwise(names((False, True)))
    return F.when(F.lower(street) == "preflop", first).otherwise(later)


def parent_id(decision_id: Column) -> Column:
    return F.regexp_replace(decision_id, r"_dp\d+$", "")


def dp_index(decision_id: Column) -> Column:
    return F.regexp_extract(decision_id, r"_dp(\d+)$", 1).try_cast("int")


def range_notation(df: DataFrame, key: str, cls: str, w: str, least: float = 0.005) -> DataFrame:
    """``class:weight`` lists with the largest weight as 1.00, two decimals, whole weights bare: key, notation."""
    share = F.col(w) / F.max(w).over(Window.partitionBy(key))
    text = F.when(F.round(share, 2) >= 1, F.col(cls)).otherwise(F.concat(F.col(cls), F.lit(":"), F.format_string("%.2f", F.round(share, 2))))
    got = df.withColumns({"_s": share}).withColumn("_t", text).where(F.col("_s") >= least)
    return got.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_t")), ",").alias("notation"))


def palette_key(pot: Column, hero: Column, villain: Column, opener: Column) -> Column:
    """Name of the range palette of a villain in a pot."""
    opened = villain == opener
    return (
        F.when(pot == "limp", F.concat(villain, F.lit("_limp")))
        .when(pot == "srp", F.when(opened, F.concat(villain, F.lit("_open"))).otherwise(F.concat(villain, F.lit("_call_vs_"), F.coalesce(opener, hero))))
        .otherwise(F.when(opened, F.concat(villain, F.lit("_call_"), pot)).otherwise(F.concat(villain, F.lit("_"), pot)))
    )


def entry(x: Column) -> Column:
    """One entry of a vector, within [0, 1]; 0 if it is not known."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def assemble(*parts: Column) -> Column:
    """Arrays joined to one vector, each entry within [0, 1]; unknown entries are 0."""
    return F.transform(F.concat(*parts), entry)


def geometry(pot: Column, stack: Column, facing: Column) -> Column:
    """Array: log pot, log stack, stack-to-pot over 20, facing share of the pot, pot odds."""
    spr = stack / F.greatest(pot, F.lit(1e-9))
    return F.array(F.log1p(pot) / 6, F.log1p(stack) / 8, F.least(spr / 20, F.lit(1.0)), F.least(facing / F.greatest(pot, F.lit(1e-9)), F.lit(2.0)) / 2, facing / F.greatest(pot + facing, F.lit(1e-9)))


def one_hot(c: Column, values: list[str]) -> Column:
    return F.array(*hot(c, values))


#: Seats in their order of the encodings, and what their place tells of a range.
SEATS = ["UTG", "MP", "CO", "BTN", "SB", "BB"]
TIGHTNESS = {"UTG": 1.0, "MP": 0.8, "CO": 0.6, "BTN": 0.4, "SB": 0.5, "BB": 0.5}
BREADTH = {"UTG": 0.3, "MP": 0.4, "CO": 0.6, "BTN": 0.8, "SB": 0.5, "BB": 0.7}


def within(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def log_share(x: Column, top: float) -> Column:
    """log(1 + x) as a share of log(1 + top)."""
    return within(F.log1p(x) / math.log1p(top))


def pot_sizes(facing: Column, spr: Column, pot_bb: Column, to_bb: Column, stack_bb: Column, was_aggressor: Column) -> list[Column]:
    """Of the later streets: pot odds, log stack-to-pot, commitment, log pot, facing size, facing at all, was the aggressor.

    ``facing`` is a share of the pot; the other sizes are in big blinds.
    """
    odds = F.when(facing > 0, within(facing / (1 + facing), high=0.5)).otherwise(0.0)
    total = stack_bb + to_bb
    committed = F.when(total > 0, within(to_bb / total)).otherwise(0.0)
    return [odds, log_share(spr, 100), committed, log_share(pot_bb, 200), within(facing / 5), (facing > 0).cast("double"), was_aggressor.cast("double")]


def pot_geometry(*sizes: Column) -> Column:
    """Array of :func:`pot_sizes`."""
    return F.array(*pot_sizes(*sizes))


def preflop_sizes(facing: Column, spr: Column, pot_bb: Column) -> list[Column]:
    """Of the first street: pot odds, log pot, log stack-to-pot."""
    return [F.when(facing > 0, facing / (1 + facing)).otherwise(0.0), log_share(pot_bb, 200), log_share(spr, 100)]


def hot(c: Column, values: list[str]) -> list[Column]:
    return [(c == v).cast("double") for v in values]


def hero_entries(seat: Column, rel: Column, n_players: Column) -> list[Column]:
    """One-hot seat (six), in position, players over six."""
    return [*hot(seat, SEATS), (rel == "IP").cast("double"), within(n_players / 6)]


def hero_position(seat: Column, rel: Column, n_players: Column) -> Column:
    """Array of :func:`hero_entries`."""
    return F.array(*hero_entries(seat, rel, n_players))


def _by_seat(seat: Column, table: dict[str, float], other: float) -> Column:
    return F.coalesce(*[F.when(seat == k, F.lit(v)) for k, v in table.items()], F.lit(other))


def villain_entries(villain: Column, hero: Column, aggressor: Column) -> list[Column]:
    """One-hot seat (six), raised first, tightness, breadth, seats from the hero's scaled to [0, 1].

    An unknown opponent has no seat, middling tightness and breadth, and the first seat's place.
    """
    raised = F.coalesce((aggressor != hero) & (aggressor == villain), F.lit(False)).cast("double")
    place = lambda s: _by_seat(s, {k: float(n) for n, k in enumerate(SEATS)}, 0.0)
    relative = within(((place(villain) - place(hero)) / 6 + 1) / 2)
    seats = [F.coalesce(x, F.lit(0.0)) for x in hot(villain, SEATS)]
    return [*seats, raised, _by_seat(villain, TIGHTNESS, 0.5), _by_seat(villain, BREADTH, 0.5), relative]


def villain_position(villain: Column, hero: Column, aggressor: Column) -> Column:
    """Array of :func:`villain_entries`."""
    return F.array(*villain_entries(villain, hero, aggressor))


def equity_entries(deciles: Column, variance: Column, mean: Column, river: Column) -> list[Column]:
    """The entries of :func:`equity_block`, each an expression of its own."""
    return [within(x) for x in (*[F.when(river, mean).otherwise(deciles[k]) for k in range(9)], F.least(variance, F.lit(1.0)) / 0.25, mean, deciles[8])]


def equity_block(deciles: Column, variance: Column, mean: Column, river: Column) -> Column:
    """Array of twelve: nine deciles (the mean nine times on the river), variance over 0.25, mean, best case."""
    nine = F.when(river, F.array_repeat(mean, 9)).otherwise(deciles)
    return F.transform(F.concat(nine, F.array(F.least(variance, F.lit(1.0)) / 0.25, mean, deciles[8])), lambda x: within(x))
