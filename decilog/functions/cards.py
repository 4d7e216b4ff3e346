"""Column expressions on cards and boards: a card is rank and suit, as in ``Td``."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS, SUITS = "23456789TJQKA", "cdhs"


def card(number: Column) -> Column:
    """Card of a number from 0 to 51; others have none."""
    return F.get(F.array(*[F.lit(r + s) for s in SUITS for r in RANKS]), number.cast("int"))


def rank_of(c: Column) -> Column:
    """Rank as a number from 2 to 14."""
    return F.array_position(F.array(*map(F.lit, RANKS)), F.substring(c, 1, 1)) + 1


def suit_of(c: Column) -> Column:
    return F.substring(c, 2, 1)


def combo_169(a: Column, b: Column) -> Column:
    """Hand class of two cards, in either order: pair, suited or offsuit; a malformed card is an error."""
    x, y = rank_of(a), rank_of(b)
    high, low = F.when(x >= y, F.substring(a, 1, 1)).otherwise(F.substring(b, 1, 1)), F.when(x >= y, F.substring(b, 1, 1)).otherwise(F.substring(a, 1, 1))
    tail = F.when(x == y, "").when(suit_of(a) == suit_of(b), "s").otherwise("o")
    fine = a.rlike("^[2-9TJQKA][cdhs]$") & b.rlike("^[2-9TJQKA][cdhs]$")
    return F.when(fine, F.concat(high, low, tail)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not two cards:"), a, b)))


def sorted_cards(cards: Column) -> Column:
    """Cards by rank, then suit, from the highest."""
    keyed = F.array_sort(F.transform(cards, lambda c: F.struct((-rank_of(c)).alias("r"), suit_of(c).alias("s"), c.alias("c"))))
    return F.transform(keyed, lambda x: x["c"])


def _renamed(to: str):
    return lambda c: F.concat(F.substring(c, 1, 1), F.translate(F.substring(c, 2, 1), SUITS, to))


def _np_cards(cards: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and suits, from 0, of each row's cards in one string; -1 after the last."""
    text = cards.fillna("").to_numpy().astype("U")
    wide = max(2, text.dtype.itemsize // 4)
    codes = np.ascontiguousarray(text).astype(f"U{wide + wide % 2}").view(np.uint32).reshape(len(text), -1)
    return _PLACE[0][codes[:, ::2] & 127], _PLACE[1][codes[:, 1::2] & 127]


def _np_mask(cards: pd.Series) -> np.ndarray:
    """52 bits as in :func:`card_mask`."""
    ranks, suits = _np_cards(cards)
    bits = np.where((ranks >= 0) & (suits >= 0), np.int64(1) << np.maximum(suits * 13 + ranks, 0).astype(np.int64), 0)
    return np.bitwise_or.reduce(bits, axis=1)


@F.pandas_udf(T.StringType())
def _first_form(hole: pd.Series, board: pd.Series) -> pd.Series:
    """``hole|board`` of cards in one string each; sides that are not whole cards give whatever they give.

    Forms differ by their suits alone, so the first is that with the least digits to base
    four; cards of a side are in order by rank, then renamed suit.
    """
    parts, values = [], []
    for ranks, suits in map(_np_cards, (hole, board)):
        values.append((np.where(ranks < 0, 127, (12 - ranks) * 4), suits))
    best = best_cards = None
    for to in permutations(range(4)):
        cards = [np.sort(np.where(v == 127, v, v + np.array(to, np.int16)[s]), axis=1) for v, s in values]
        number = np.zeros(len(hole), np.int64)
        for c in cards:
            for k in range(c.shape[1]):
                number = number * 4 + (c[:, k] & 3)
        if best is None:
            best, best_cards = number, cards
        else:
            less = number < best
            best, best_cards = np.where(less, number, best), [np.where(less[:, None], c, d) for c, d in zip(cards, best_cards)]
    for c in best_cards:
        flat = _NAMES[np.minimum(c, 52)]
        parts.append(reduce(np.char.add, flat.T))
    return pd.Series(np.char.add(np.char.add(parts[0], "|"), parts[1]))


#: Places of rank and suit letters by code, and cards by (12 - rank) * 4 + suit; the last is none.
_PLACE = [np.array([letters.find(chr(k)) for k in range(128)], np.int16) for letters in (RANKS, SUITS)]
_NAMES = np.array([RANKS[12 - k // 4] + SUITS[k % 4] for k in range(52)] + [""])


def joint_canonical(hole: Column, board: Column) -> Column:
    """``hole|board`` under the suit renaming that comes first of the 24; equal for hands that differ by suits alone."""
    sides = [F.array_join(x, "") for x in (hole, board)]
    fine = reduce(lambda a, b: a & b, [x.rlike("^([2-9TJQKA][cdhs]){0,15}$") for x in sides])
    return F.when(fine, _first_form(*sides)).otherwise(_joint_canonical_of_any(hole, board))


def _joint_canonical_of_any(hole: Column, board: Column) -> Column:
    """:func:`joint_canonical` by column expressions, for what are not cards too."""
    forms = []
    for to in permutations(SUITS):
        turn = _renamed("".join(to))
        forms.append(F.concat_ws("|", F.array_join(sorted_cards(F.transform(hole, turn)), ""), F.array_join(sorted_cards(F.transform(board, turn)), "")))
    return F.array_min(F.array(*forms))


def canonical_board(board: Column) -> Column:
    """The board alone under the first suit renaming."""
    return F.substring_index(joint_canonical(F.array().cast("array<string>"), board), "|", -1)


def board_texture(board: Column) -> Column:
    """monotone, then paired, then wet_two_tone, else dry_rainbow; under three cards dry_rainbow."""
    suits, ranks = F.size(F.array_distinct(F.transform(board, suit_of))), F.size(F.array_distinct(F.transform(board, rank_of)))
    return F.when(F.coalesce(F.size(board), F.lit(0)) < 3, "dry_rainbow").when(suits == 1, "monotone").when(ranks < F.size(board), "paired").when(suits == 2, "wet_two_tone").otherwise("dry_rainbow")


def _most(values: Column) -> Column:
    """How often the most frequent value of an array is in it."""
    return F.array_max(F.transform(values, lambda v: F.size(F.filter(values, lambda w: w == v))))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def rank_mask(ranks: Column) -> Column:
    """Bit r is set if rank r is there; the ace also sets bit 1."""
    mask = F.aggregate(ranks, F.lit(0), lambda m, r: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), r.cast("int"))))
    return let(mask, lambda m: m.bitwiseOR(F.shiftright(m, 13).bitwiseAND(F.lit(2))))


def card_mask(cards: Column) -> Column:
    """52 bits, 13 for each suit; the bit of a card is set if it is there."""
    index = lambda c: (F.instr(F.lit(SUITS), suit_of(c)) - 1) * 13 + F.instr(F.lit(RANKS), F.substring(c, 1, 1)) - 1
    return F.aggregate(cards, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), index(c))))


def suit_masks(mask: Column) -> list[Column]:
    """The 13 rank bits of each suit, from the two up to the ace."""
    return [F.shiftright(mask, 13 * k).bitwiseAND(F.lit((1 << 13) - 1)) for k in range(4)]


def ranks_of_suits(suits: list[Column], n: int) -> Column:
    """Rank bits that ``n`` of the suits have at least."""
    out = None
    for some in combinations(suits, n):
        both = some[0]
        for other in some[1:]:
            both = both.bitwiseAND(other)
        out = both if out is None else out.bitwiseOR(both)
    return out


def straight_in(ranks: Column) -> Column:
    """Whether five ranks in a row are set; the ace also stands below the two."""
    low = F.shiftleft(ranks, 1).bitwiseOR(F.shiftright(ranks, 12))
    both = low.bitwiseAND(F.shiftright(low, 1))
    return both.bitwiseAND(F.shiftright(both, 2)).bitwiseAND(F.shiftright(low, 4)) != 0


def top_rank(ranks: Column) -> Column:
    """Highest rank set, 0 for the two; 0 if none is."""
    return F.length(F.bin(ranks)) - 1


def three_near(mask: Column) -> Column:
    """Whether three ranks lie within five in a row."""
    found = F.lit(False)
    for k in range(1, 11):
        found = found | (F.bit_count(F.shiftright(mask, k).bitwiseAND(F.lit(31))) >= 3)
    return found


@F.pandas_udf(T.StructType([T.StructField("n_cards", T.IntegerType()), T.StructField("max_suit", T.IntegerType()), T.StructField("paired", T.BooleanType()), T.StructField("near", T.BooleanType()), T.StructField("in_row", T.BooleanType()), T.StructField("high", T.IntegerType())]))
def _shape_of(board: pd.Series, n: pd.Series) -> pd.DataFrame:
    ranks, suits = _np_cards(board)
    of = [reduce(np.add, [(column == v).astype(np.int32) for column in values.T]) for values, top in ((suits, 4), (ranks, 13)) for v in range(top)]
    mask = reduce(np.bitwise_or, [(count > 0).astype(np.int64) << r for r, count in enumerate(of[4:])])
    any_of = lambda tests: reduce(np.logical_or, tests)
    return pd.DataFrame(
        {
            "n_cards": n.astype(np.int32), "max_suit": reduce(np.maximum, of[:4]), "paired": reduce(np.maximum, of[4:]) > 1, "near": any_of([_BITS[(mask >> k) & 31] >= 3 for k in range(10)]),
            "in_row": any_of([((mask >> k) & 7) == 7 for k in range(11)]), "high": _TOP[mask],
        }
    )


def board_shape(board: Column) -> Column:
    """Struct: n_cards, max_suit, paired, near (three ranks within five in a row, the ace high), in_row (three ranks in a row), high (0 for the two)."""
    return _shape_of(*_sides(board, board)[1:])


def board_features(board: Column) -> Column:
    """Struct: n_cards, paired, max_suit, high_rank, span, broadway, connected."""
    ranks = F.transform(board, rank_of)
    return F.struct(
        F.size(board).alias("n_cards"), (_most(ranks) > 1).alias("paired"), _most(F.transform(board, suit_of)).alias("max_suit"),
        F.array_max(ranks).alias("high_rank"), (F.array_max(ranks) - F.array_min(ranks)).alias("span"),
        F.size(F.filter(ranks, lambda r: r >= 10)).alias("broadway"), let(rank_mask(ranks), three_near).alias("connected"),
    )


def draw_features(hole: Column, board: Column) -> Column:
    """Struct: flush_draw, backdoor_flush, open_ender, gutshot, combo_draw, ppot, npot, outs.

    Nothing is a draw before the flop or on the river. Four of a suit or more with a hole
    card among them draw to a flush; an open-ender is four ranks in a row with both ends
    free and in range, a gutshot any other four within five (wheels included). Outs: nine
    for the flush, eight or four for the straight; ppot is their share of unseen cards.
    """
    return _draws_of(*_sides(hole, board))


@F.pandas_udf(T.StructType([T.StructField("flush_draw", T.BooleanType()), T.StructField("backdoor_flush", T.BooleanType()), T.StructField("open_ender", T.BooleanType()), T.StructField("gutshot", T.BooleanType()), T.StructField("combo_draw", T.BooleanType()), T.StructField("ppot", T.DoubleType()), T.StructField("npot", T.DoubleType()), T.StructField("outs", T.IntegerType())]))
def _draws_of(hole: pd.Series, board: pd.Series, n: pd.Series) -> pd.DataFrame:
    h, b, size = _np_mask(hole), _np_mask(board), n.to_numpy()
    any_of = lambda tests: reduce(np.logical_or, tests)
    counts = [(_BITS[x], _BITS[y]) for x, y in zip(_np_masks(h), _np_masks(b))]
    ranks, live = _np_of_suits(_np_masks(h | b), 1), (size >= 3) & (size <= 4)
    flush = live & any_of([(x + y >= 4) & (x >= 1) & (y < 5) for x, y in counts])
    backdoor = (size == 3) & any_of([(x == 2) & (y == 1) for x, y in counts])
    ender = live & any_of([((ranks >> k) & 63) == 30 for k in range(8)])
    within = any_of([_BITS[(ranks >> k) & 31] == 4 for k in range(9)])
    wheel = any_of([(ranks & bits) == bits for bits in ((1 << 12) | 7, (1 << 12) | 11)])
    gut = live & ~ender & (within | wheel)
    outs = (np.where(flush, 9, 0) + np.where(ender, 8, np.where(gut, 4, 0))).astype(np.int32)
    return pd.DataFrame({"flush_draw": flush, "backdoor_flush": backdoor, "open_ender": ender, "gutshot": gut, "combo_draw": flush & (ender | gut), "ppot": outs / (50 - size), "npot": 0.0, "outs": outs})


def _np_masks(mask: np.ndarray) -> list[np.ndarray]:
    """The 13 rank bits of each suit, from the two up to the ace."""
    return [(mask >> (13 * k)) & 0x1FFF for k in range(4)]


def _np_of_suits(suits: list[np.ndarray], n: int) -> np.ndarray:
    """Rank bits that ``n`` of the suits have at least."""
    return reduce(np.bitwise_or, [reduce(np.bitwise_and, some) for some in combinations(suits, n)])


def _np_straight(ranks: np.ndarray) -> np.ndarray:
    low = (ranks << 1) | (ranks >> 12)
    both = low & (low >> 1)
    return (both & (both >> 2) & (low >> 4)) != 0


#: Highest rank by its bits, 0 for the two and for none; how many bits are set.
_TOP, _BITS = (np.array([f(k) for k in range(1 << 13)], np.int32) for f in (lambda k: max(k.bit_length() - 1, 0), int.bit_count))


def _np_class(mask: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class of the best five cards, and the rank bits that one to four suits have."""
    suits = _np_masks(mask)
    one, two, three, four = ranks = [_np_of_suits(suits, n) for n in range(1, 5)]
    any_of = lambda f: reduce(np.logical_or, [f(s) for s in suits])
    tests = [any_of(_np_straight), four != 0, (three != 0) & (_BITS[two] > 1), any_of(lambda s: _BITS[s] >= 5), _np_straight(one), three != 0, _BITS[two] > 1, two != 0]
    return np.select(tests, [8, 7, 6, 5, 4, 3, 2, 1], 0).astype(np.int32), ranks


@F.pandas_udf(T.IntegerType())
def _made_of(cards: pd.Series) -> pd.Series:
    return pd.Series(_np_class(_np_mask(cards))[0])


def _sides(hole: Column, board: Column) -> list[Column]:
    """Both sides' cards in one string each, and the board's size; a side that is not known has no cards."""
    return [*[F.coalesce(F.array_join(x, ""), F.lit("")) for x in (hole, board)], F.when(board.isNull(), 0).otherwise(F.size(board))]


def made_hand(hole: Column, board: Column) -> Column:
    """Class of the best five of up to seven cards: 0 high card, 1 pair, ... 8 straight flush."""
    return _made_of(F.concat(*_sides(hole, board)[:2]))


@F.pandas_udf(T.StructType([T.StructField("rank_category", T.IntegerType()), T.StructField("pair_rank", T.IntegerType()), T.StructField("kicker", T.IntegerType()), T.StructField("is_set", T.BooleanType()), T.StructField("top_pair", T.BooleanType()), T.StructField("overpair", T.BooleanType())]))
def _made_features_of(hole: pd.Series, board: pd.Series, n: pd.Series) -> pd.DataFrame:
    own, shared = _np_mask(hole), _np_mask(board)
    cls, (one, two, three, _) = _np_class(own | shared)
    cls = np.where(n.to_numpy() >= 3, cls, 0).astype(np.int32)
    mine = _np_masks(own)
    top, pocket, best = _TOP[_np_of_suits(_np_masks(shared), 1)], _np_of_suits(mine, 2) != 0, _TOP[_np_of_suits(mine, 1)]
    trips = np.isin(cls, (3, 6))
    rank = np.where(cls == 1, _TOP[two], np.where(trips, _TOP[three], 0)).astype(np.int32)
    return pd.DataFrame(
        {
            "rank_category": cls, "pair_rank": rank, "kicker": np.where(cls == 1, _TOP[one & ~two], 0).astype(np.int32), "is_set": trips & pocket & (best == _TOP[three]),
            "top_pair": np.isin(cls, (1, 3)) & (rank == top), "overpair": (cls == 1) & pocket & (best > top),
        }
    )


def made_hand_features(hole: Column, board: Column) -> Column:
    """Struct: rank_category, pair_rank, kicker, is_set, top_pair, overpair; all 0 under three board cards.

    Ranks count from 0 (the two). pair_rank is that of a pair, of three of a kind, or of a
    full house's three; is_set: both hole cards are among the three.
    """
    return _made_features_of(*_sides(hole, board))


def class_features(cls: Column) -> Column:
    """Struct of a hand class: pair, suited, gap, broadway, high."""
    a, b = rank_of(F.substring(cls, 1, 1)), rank_of(F.substring(cls, 2, 1))
    return F.struct((a == b).alias("pair"), cls.endswith("s").alias("suited"), F.greatest(a - b - 1, F.lit(0)).alias("gap"), ((a >= 10) & (b >= 10)).alias("broadway"), a.alias("high"))


def class_combos(cls: Column) -> Column:
    """Card pairs of a hand class: 6, 4 or 12."""
    return F.when(cls.endswith("s"), 4).when(cls.endswith("o"), 12).otherwise(6)
