"""Queries of whole feature vectors, and of the blocks that only they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilog.functions import cards as C
from decilog.functions import features as X
from decilog.operators import extract as E
from decilog.operators import vectors as V
from decilog.plans.bindings import role, with_roles
from decilog.plans.decisions import ACTIVE, AGG, DEALT, FACING, NUMBERS, POT, W, WA, cut, moves, with_dealt
from decilog.plans.registry import ORACLES, query

BLIND = 10


def strength(cls):
    """A hand class's strength: its ranks over 28, pairs and suited ones a fifth more, at most 1."""
    f = C.class_features(cls)
    low = F.when(f["pair"], f["high"]).otherwise(f["high"] - f["gap"] - 1)
    return F.least((f["high"] + low) / 28 * F.when(f["pair"] | f["suited"], 1.2).otherwise(1.0), F.lit(1.0))


def ranges(spark, d):
    """Hand classes that each seat was dealt, with their numbers; a pair of cards is named once for all its rows."""
    pairs = role(spark, d, "moves").groupBy(F.col("actor").alias("seat"), *[F.expr(x).alias(n) for x, n in zip(NUMBERS, "ab")]).agg(F.count(F.lit(1)).alias("n"))
    cls = F.coalesce(C.combo_169(C.card(F.col("a")), C.card(F.col("b"))), F.lit(""))  # never null: else a join's test for null names the class of each row of the scan
    return pairs.groupBy("seat", cls.alias("cls")).agg(F.sum("n").cast("double").alias("w"))


def equities(spark, d):
    e = role(spark, d, "equity")
    return e.withColumn("deciles", F.array(*[F.col("mean") * (6 + k) / 10 for k in range(9)]))


def spots(spark, d, street):
    """Dealt moves of some streets with everything that the vectors need, blockers aside. Windows of one order follow each other."""
    df = V.with_street_history(E.with_facing(moves(spark, d)))
    df = E.with_pos_rel(E.with_active_players(E.with_aggressor(E.with_size_ratios(E.with_pot_before(df)))))
    df = with_dealt(df.where(street)).withColumns({"eq_key": F.col("l_partkey") % 64, "blind": F.lit(BLIND), "spr": F.col("stack_after") / F.col("pot_before"), "seat": V.villain(), "tightness": F.lit(None).cast("double")})
    return V.with_equity(df, F.broadcast(equities(spark, d)), ["eq_key"])  # 48 keys


def wide(df, entries):
    """Entries, which are within [0, 1], at 12 decimals: by whole numbers, as rounding by decimals takes longer than all else."""
    return cut(df, *[(F.floor(x * 1e12 + 0.5) / 1e12).alias(f"v{k}") for k, x in enumerate(entries)])


def clip(x: str, low: float = 0, high: float = 1) -> str:
    return f"least(greatest(CAST({x} AS DOUBLE), {low}), {high})"


def yes(test: str) -> str:
    return f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"


def log_share(x: str, top: int) -> str:
    return clip(f"ln(1 + {x}) / ln({top + 1})")


WS = "PARTITION BY hand_id, street ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
WH = "PARTITION BY hand_id, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
count = lambda test, w: f"count(*) FILTER (WHERE {test}) OVER ({w})"
BOLD = "action IN ('bet', 'raise', 'allin')"
HISTORY = f"""SELECT *, CASE WHEN pa IS NULL THEN 'cold' WHEN pa IN ('check', 'call', 'fold') THEN 'check_to' WHEN pa = 'bet' THEN 'bet_to' ELSE 'raise_to' END AS facing, {AGG} AS aggressor, coalesce(facing_size / CAST(pot_before AS DOUBLE), 0) AS f,
 {count("action IN ('raise', 'allin')", WS)} AS n_raises, {count("action = 'check'", WA)} AS own_checks, {count("action IN ('bet', 'raise')", WA)} AS own_bets, {count(BOLD, WA)} AS own_bold, {count(BOLD, WS)} - {count(BOLD, WA)} AS others_bold,
 coalesce(sum(amount) FILTER (WHERE action = 'call' OR {BOLD}) OVER ({WA}), 0) AS own_put, {count("street = 'preflop' AND action IN ('raise', 'allin')", W)} AS first_raises, {count("street = 'preflop' AND action IN ('raise', 'allin')", WH)} AS own_first FROM ({POT})"""
COUNTS = "SELECT hand_id, seq, n_raises, own_checks, own_bets, own_bold, others_bold, own_put, first_raises, own_first"
SPOTS = f"""h AS ({HISTORY}), po AS ({ORACLES['x10_pos_rel']}), ac AS (SELECT hand_id, seq, n_active FROM ({ACTIVE}) WHERE n_active > 1), {DEALT}, dr AS ({ORACLES['f06_draw_features']}), md AS ({ORACLES['f07_made_hand_features']}),
t AS (SELECT h.*, coalesce(facing_pos, aggressor) AS villain, stack_after / CAST(pot_before AS DOUBLE) AS spr, pos_rel, n_active, g.h AS hole, g.b AS board, dr.* EXCLUDE (hand_id, seq), md.* EXCLUDE (hand_id, seq), e.mean AS e_mean, e.variance AS e_variance
 FROM h JOIN po USING (hand_id, seq) JOIN ac USING (hand_id, seq) JOIN g USING (hand_id, seq) JOIN dr USING (hand_id, seq) JOIN md USING (hand_id, seq) LEFT JOIN equity e ON e.eq_key = h.l_partkey % 64)"""


@query(with_roles(f"{COUNTS} FROM ({HISTORY})"))
def f09_street_history(spark, d):
    return cut(V.with_street_history(moves(spark, d)), "n_raises", "own_checks", "own_bets", "own_bold", "others_bold", "own_put", "first_raises", F.col("own_first_raises").alias("own_first"))


def decile(k: int) -> str:
    return f"coalesce(e_mean * (6 + {k}) / 10, (SELECT avg(mean * (6 + {k}) / 10) FROM equity))"


MEAN, VARIANCE = "coalesce(e_mean, (SELECT avg(mean) FROM equity))", "coalesce(e_variance, (SELECT avg(variance) FROM equity))"


@query(with_roles(f"""WITH s AS (SELECT hand_id, seq, street, e.mean AS e_mean, e.variance AS e_variance FROM moves m LEFT JOIN equity e ON e.eq_key = m.l_partkey % 64)
SELECT hand_id, seq, e_mean IS NOT NULL AS known, {', '.join(f"round(CASE WHEN street = 'river' THEN {clip(MEAN)} ELSE {clip(decile(k))} END, 12) AS p{k}" for k in (0, 4, 8))}, round({clip(f'least({VARIANCE}, 1) / 0.25')}, 12) AS variance, round({clip(decile(8))}, 12) AS best FROM s"""))
def f13_equity_features(spark, d):
    df = V.with_equity(moves(spark, d).withColumn("eq_key", F.col("l_partkey") % 64), equities(spark, d), ["eq_key"])
    block = X.equity_block(F.col("deciles"), F.col("variance"), F.col("mean"), F.col("street") == "river")
    got = cut(df, F.col("equity_known").alias("known"), block.alias("b"))
    return got.select("hand_id", "seq", "known", *[F.round(F.col("b")[k], 12).alias(n) for k, n in ((0, "p0"), (4, "p4"), (8, "p8"), (9, "variance"), (11, "best"))])


#: Every pair of cards by number, its class, and how strong the class is.
PAIRS = """pr AS (SELECT a, b, greatest(a % 13, b % 13) + 2 AS x, least(a % 13, b % 13) + 2 AS y, a // 13 = b // 13 AS s FROM range(52) p(a), range(52) q(b) WHERE a < b),
pc AS (SELECT a, b, substr('23456789TJQKA', CAST(x - 1 AS INTEGER), 1) || substr('23456789TJQKA', CAST(y - 1 AS INTEGER), 1) || CASE WHEN x = y THEN '' WHEN s THEN 's' ELSE 'o' END AS cls, CASE WHEN x = y THEN 6 WHEN s THEN 4 ELSE 12 END AS n, least((x + y) / 28.0 * CASE WHEN x = y OR s THEN 1.2 ELSE 1.0 END, 1) AS strength FROM pr)"""
RANGE = f"rg AS (SELECT m.actor AS seat, c.cls, CAST(count(*) AS DOUBLE) AS w FROM moves m JOIN ({ORACLES['f01_combo_169']}) c USING (hand_id, seq) GROUP BY m.actor, c.cls)"
BLOCKED = f"""{PAIRS}, {RANGE}, sp AS (SELECT seat, a, b, w / n AS w, CASE WHEN strength >= 6 / 7.0 THEN w / n * strength ELSE 0 END AS v FROM rg JOIN pc ON pc.cls = rg.cls), wh AS (SELECT seat, sum(w) AS w, sum(v) AS v FROM sp GROUP BY seat),
hit AS (SELECT wh.seat, pc.a, pc.b, any_value(wh.w) AS all_w, any_value(wh.v) AS all_v, coalesce(sum(sp.w), 0) AS w, coalesce(sum(sp.v), 0) AS v FROM wh, pc LEFT JOIN sp ON sp.seat = wh.seat AND (sp.a = pc.a OR sp.b = pc.a OR sp.a = pc.b OR sp.b = pc.b) GROUP BY wh.seat, pc.a, pc.b),
bk AS (SELECT seat, a, b, CASE WHEN all_v > 0 THEN v / all_v ELSE 0 END AS value_blocked, CASE WHEN all_w > 0 THEN w / all_w ELSE 0 END AS range_blocked FROM hit)"""
CARDS = "substr('23456789TJQKA', CAST({0} % 13 + 1 AS INTEGER), 1) || substr('cdhs', CAST({0} // 13 + 1 AS INTEGER), 1)"


@query(with_roles(f"WITH {BLOCKED} SELECT seat, array_to_string(list_sort([{CARDS.format('a')}, {CARDS.format('b')}]), '') AS pair, round(value_blocked, 9) AS value_blocked, round(range_blocked, 9) AS range_blocked FROM bk"))
def f12_blocker_table(spark, d):
    """Every pair of hole cards against every seat's range: the share of it, and of its premium part, that the pair blocks."""
    return V.blocker_table(ranges(spark, d), "seat", strength).select("seat", "pair", F.round("value_blocked", 9).alias("value_blocked"), F.round("range_blocked", 9).alias("range_blocked"))


SEATS = "['UTG', 'MP', 'CO', 'BTN', 'SB', 'BB']"
RANKS = "list_distinct(list_transform(board, lambda x: x % 13))"
SUIT = "list_max(list_transform(range(4), lambda s: len(list_filter(board, lambda x: x // 13 = s))))"
HOT = [yes(f"actor = '{s}'") for s in X.SEATS]
BUCKET = "CASE WHEN f <= 0 OR facing = 'check_to' THEN 0 " + " ".join(f"WHEN f <= {t} THEN {k}" for k, t in enumerate(V.FACED_SIZES, 1)) + " ELSE 7 END"
LATER = [
    *[f"CASE WHEN street = 'river' THEN {clip(MEAN)} ELSE {clip(decile(k))} END" for k in range(9)], clip(f"least({VARIANCE}, 1) / 0.25"), clip(MEAN), clip(decile(8)),
    *map(yes, ("flush_draw", "backdoor_flush", "open_ender", "gutshot", "combo_draw")), "outs / CAST(50 - len(board) AS DOUBLE)", "0.0", clip("outs / 20.0"),
    "rank_category / 8.0", "pair_rank / 12.0", "kicker / 12.0", *map(yes, ("is_set", "top_pair", "overpair")),
    *HOT, yes("pos_rel = 'IP'"), clip("n_active / 6.0"),
    f"CASE WHEN f > 0 THEN {clip('f / (1 + f)', high=0.5)} ELSE 0 END", log_share("spr", 100), "CASE WHEN stack_after + amount > 0 THEN amount / CAST(stack_after + amount AS DOUBLE) ELSE 0 END", log_share(f"pot_before / {BLIND}.0", 200), clip("f / 5"), yes("f > 0"), yes("actor = aggressor"),
    "CASE street WHEN 'turn' THEN 0.5 WHEN 'river' THEN 1.0 ELSE 0.0 END", clip("n_raises / 4.0"), yes("own_bold > 0"), *[yes(f"{BUCKET} = {k}") for k in range(8)], clip("own_put / CAST(pot_before AS DOUBLE)"),
    *[clip(f"{c} / 3.0") for c in ("own_checks", "own_bets", "others_bold")], yes("own_checks > 0 AND others_bold > 0 AND f > 0"),
    yes("actor = aggressor"), clip("first_raises / 4.0"), "0.0", "0.0", "0.0", "0.0",
    yes(f"{SUIT} >= 3"), yes(f"{SUIT} >= 4"), yes(f"len(list_filter(range(10), lambda lo: len(list_filter({RANKS}, lambda r: r BETWEEN lo AND lo + 4)) >= 3)) > 0"), yes(f"len({RANKS}) < len(board)"), yes(f"{SUIT} = len(board)"),
    f"CASE WHEN len(list_filter(range(11), lambda lo: len(list_filter({RANKS}, lambda r: r BETWEEN lo AND lo + 2)) = 3)) > 0 THEN 3 / 13.0 ELSE 0 END", f"list_max({RANKS}) / 12.0",
    *[yes(f"villain = '{s}'") for s in X.SEATS], yes("aggressor <> actor AND aggressor = villain"),
    "CASE villain WHEN 'UTG' THEN 1.0 WHEN 'MP' THEN 0.8 WHEN 'CO' THEN 0.6 WHEN 'BTN' THEN 0.4 ELSE 0.5 END", "CASE villain WHEN 'UTG' THEN 0.3 WHEN 'MP' THEN 0.4 WHEN 'CO' THEN 0.6 WHEN 'BTN' THEN 0.8 WHEN 'BB' THEN 0.7 ELSE 0.5 END",
    clip(f"((coalesce(list_position({SEATS}, villain), 1) - list_position({SEATS}, actor)) / 6.0 + 1) / 2"),
]
columns_sql = lambda entries: ", ".join(f"round(CAST({clip(x)} AS DOUBLE), 12) AS v{k}" for k, x in enumerate(entries))


@query(with_roles(f"WITH {SPOTS} SELECT hand_id, seq, {columns_sql(LATER)} FROM t WHERE street <> 'preflop'"))
def f14_later_vector(spark, d):
    """The 80 entries of each decision after the first street."""
    return wide(V.with_cards(spots(spark, d, "street <> 'preflop'")), V.later_entries())


X1, Y1 = "greatest(hole[1] % 13, hole[2] % 13)", "least(hole[1] % 13, hole[2] % 13)"
SAME = "hole[1] // 13 = hole[2] // 13"
FIRST = [
    *[clip(decile(k)) for k in (0, 2, 4, 6, 8)], clip(MEAN),
    f"CASE WHEN {X1} = {Y1} THEN {X1} / 12.0 ELSE 0 END", yes(SAME), f"CASE WHEN {X1} = {Y1} THEN 0 ELSE ({X1} - {Y1} - 1) / 12.0 END", yes(f"{Y1} >= 8"), f"least(({X1} + {Y1} + 4) / 28.0 * CASE WHEN {X1} = {Y1} OR {SAME} THEN 1.2 ELSE 1.0 END, 1)",
    yes("pos_rel = 'IP'"), *HOT, "n_active / 6.0", "0.0",
    "CASE WHEN f > 0 THEN f / (1 + f) ELSE 0 END", log_share(f"pot_before / {BLIND}.0", 200), log_share("spr", 100),
    clip("n_raises / 4.0"), yes("own_first > 0"), "CASE facing WHEN 'bet_to' THEN 0.5 WHEN 'raise_to' THEN 1.0 ELSE 0.0 END", clip("f / 5"),
    *[yes(f"villain IN ({', '.join(map(repr, group))})") for group in V.SEAT_GROUPS], "CASE villain WHEN 'UTG' THEN 1.0 WHEN 'MP' THEN 0.67 WHEN 'CO' THEN 0.5 WHEN 'BTN' THEN 0.33 ELSE 0.5 END",
    "coalesce(value_blocked, 0)", "coalesce(range_blocked, 0)",
]


@query(with_roles(f"WITH {SPOTS}, {BLOCKED} SELECT hand_id, seq, {columns_sql(FIRST)} FROM t LEFT JOIN bk ON bk.seat = t.villain AND bk.a = least(hole[1], hole[2]) AND bk.b = greatest(hole[1], hole[2]) WHERE street = 'preflop'"))
def f14_first_vector(spark, d):
    """The 34 entries of each decision on the first street."""
    table = F.broadcast(V.blocker_table(ranges(spark, d), "seat", strength))  # 1326 rows for each of six seats
    return wide(V.with_blockers(spots(spark, d, "street = 'preflop'"), table, "seat"), V.first_entries(strength))
