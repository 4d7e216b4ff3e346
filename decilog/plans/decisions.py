"""Queries of decision extraction and of column features, on an order's lines as a hand's moves."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from decilog.functions import cards as C
from decilog.functions import features as X
from decilog.functions import predicates as P
from decilog.operators import extract as E
from decilog.plans.bindings import ordered_moves, role, with_roles
from decilog.plans.registry import query

HEAD = "hand_id, seq"


def moves(spark, d):
    """For windows over a hand; what needs no order reads the role itself."""
    return ordered_moves(spark, d)


def cut(df, *columns):
    return df.select("hand_id", F.col("seq").cast("long").alias("seq"), *columns)


W = "PARTITION BY hand_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(with_roles("""WITH h AS (SELECT hand_id, count(*) AS n, count(DISTINCT actor) AS seats, bool_or(amount = 50) AS s FROM moves GROUP BY hand_id)
SELECT coalesce(CASE WHEN CASE WHEN seats = 2 THEN 2 ELSE n END = 2 THEN 'heads_up' WHEN n > 6 THEN 'too_many_seats' WHEN s THEN 'straddle' END, 'kept') AS reason, count(*) AS n FROM h GROUP BY 1"""))
def x01_exclusions(spark, d):
    h = moves(spark, d).groupBy("hand_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor").alias("seats"), F.bool_or(F.col("amount") == 50).alias("straddled"))
    size = F.when(F.col("seats") == 2, 2).otherwise(F.col("n"))
    reason = E.exclusion_reason(size, F.col("straddled"))
    return h.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT hand_id, CAST(seq AS INTEGER) AS seq, street, actor, action, amount FROM moves"))
def x02_explode_events(spark, d):
    event = F.struct("seq", "actor", "action", "amount")
    street = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("street") == s, event))), lambda e: F.struct(e["actor"].alias("actor"), e["action"].alias("action"), e["amount"].alias("amount"))).alias(s)
    nested = moves(spark, d).groupBy("hand_id").agg(*map(street, E.STREETS))
    return E.explode_events(nested, E.STREETS)


@query(with_roles("SELECT hand_id, seq, action FROM moves WHERE actor = 'BTN' AND action <> 'check'"))
def x03_hero_decisions(spark, d):
    return cut(E.hero_decisions(moves(spark, d), F.col("actor") == "BTN", ("check",)), "action")


@query(with_roles("SELECT hand_id, seq, stack_after + amount AS stack_before, last_value(stack_after) OVER (PARTITION BY hand_id, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stack_known FROM moves"))
def x04_stacks(spark, d):
    return cut(E.with_stack_before(moves(spark, d)), "stack_before", "stack_known")


ACTIVE = f"""SELECT *, len(list_filter(seats, lambda s: NOT list_contains(folded, s))) AS n_active, list_sort(list_filter(seats, lambda s: NOT list_contains(folded, s))) AS active FROM (
 SELECT m.*, list_distinct(list(actor) OVER (PARTITION BY hand_id)) AS seats, coalesce(list(actor) FILTER (WHERE action = 'fold') OVER ({W}), []) AS folded FROM moves m)"""


@query(with_roles(f"SELECT hand_id, seq, n_active, array_to_string(active, ',') AS active FROM ({ACTIVE}) WHERE n_active > 1"))
def x05_active_players(spark, d):
    return cut(E.with_active_players(moves(spark, d)), "n_active", F.array_join("active", ",").alias("active"))


FACING = "SELECT *, lag(action) OVER s AS pa, lag(actor) OVER s AS facing_pos, lag(amount) OVER s AS facing_size FROM moves WINDOW s AS (PARTITION BY hand_id, street ORDER BY seq)"


@query(with_roles(f"SELECT hand_id, seq, CASE WHEN pa IS NULL THEN 'cold' WHEN pa IN ('check', 'call', 'fold') THEN 'check_to' WHEN pa = 'bet' THEN 'bet_to' ELSE 'raise_to' END AS facing, facing_pos, facing_size FROM ({FACING})"))
def x06_facing(spark, d):
    return cut(E.with_facing(moves(spark, d)), "facing", "facing_pos", "facing_size")


POT = f"SELECT *, CAST(coalesce(sum(amount) OVER ({W}), 0) + 3 AS BIGINT) AS pot_before FROM ({FACING})"


@query(with_roles(f"SELECT hand_id, seq, pot_before FROM ({POT})"))
def x07_pot_before(spark, d):
    return cut(E.with_pot_before(moves(spark, d)), "pot_before")


AGG = f"last_value(CASE WHEN street = 'preflop' AND action IN ('bet', 'raise', 'allin') THEN actor END IGNORE NULLS) OVER ({W})"


@query(with_roles(f"SELECT hand_id, seq, aggressor, coalesce(aggressor = actor, FALSE) AS was_aggressor FROM (SELECT *, {AGG} AS aggressor FROM moves)"))
def x08_aggressor(spark, d):
    return cut(E.with_aggressor(moves(spark, d)), "aggressor", "was_aggressor")


RAISED = "CASE WHEN street = 'preflop' AND action = 'raise' THEN 1 ELSE 0 END"


@query(with_roles(f"""SELECT hand_id, seq, CASE n WHEN 0 THEN 'limp' WHEN 1 THEN 'srp' WHEN 2 THEN '3bet' WHEN 3 THEN '4bet' ELSE '5bet+' END AS pot_type FROM (
SELECT hand_id, seq, CASE WHEN street = 'preflop' THEN coalesce(sum({RAISED}) OVER ({W}), 0) ELSE sum({RAISED}) OVER (PARTITION BY hand_id) END AS n FROM moves)"""))
def x09_pot_type(spark, d):
    return cut(E.with_pot_type(moves(spark, d)), "pot_type")


R = "list_position(['SB', 'BB', 'UTG', 'MP', 'CO', 'BTN'], {})"


@query(with_roles(f"""WITH a AS (SELECT *, {AGG} AS aggressor FROM ({ACTIVE}))
SELECT hand_id, seq, CASE WHEN CASE WHEN street <> 'preflop' THEN {R.format('actor')} = list_max(list_transform(active, lambda s: {R.format('s')})) WHEN aggressor IS NOT NULL THEN {R.format('actor')} > {R.format('aggressor')} ELSE actor IN ('CO', 'BTN') END THEN 'IP' ELSE 'OOP' END AS pos_rel FROM a WHERE n_active > 1"""))
def x10_pos_rel(spark, d):
    return cut(E.with_pos_rel(E.with_active_players(E.with_aggressor(moves(spark, d)))), "pos_rel")


WA = "PARTITION BY hand_id, street, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(with_roles(f"""SELECT hand_id, seq, committed, CASE WHEN action = 'raise' THEN greatest(amount - committed, 0) ELSE amount END AS added FROM (SELECT *, CAST(greatest(coalesce(max(CASE WHEN action = 'raise' THEN amount END) OVER ({WA}), 0), coalesce(sum(CASE WHEN action <> 'raise' THEN amount END) OVER ({WA}), 0)) AS BIGINT) AS committed FROM moves)"""))
def x11_committed(spark, d):
    return cut(E.with_committed(moves(spark, d)), "committed", "added")


@query(with_roles("""SELECT hand_id, seq, len(list_filter(list_distinct(coalesce(seen, [])), lambda s: s <> actor)) + 1 AS actor_order FROM (SELECT *, list(actor) OVER (PARTITION BY hand_id, street ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM moves)"""))
def x12_actor_order(spark, d):
    return cut(E.with_actor_order(moves(spark, d)), "actor_order")


B = "list_position(['UTG', 'MP', 'CO', 'BTN', 'SB', 'BB'], {})"


@query(with_roles(f"""SELECT hand_id, seq, array_to_string(list_filter(['UTG', 'MP', 'CO', 'BTN', 'SB', 'BB'], lambda s: list_contains(active, s) AND s <> actor), ',') AS opponents FROM ({ACTIVE}) WHERE n_active > 1"""))
def x13_opponents(spark, d):
    return cut(E.with_opponents(E.with_active_players(moves(spark, d))), F.array_join("opponents", ",").alias("opponents"))


@query(with_roles("""SELECT hand_id, seq, coalesce(string_agg(actor || ':' || action, ' ') OVER (PARTITION BY hand_id, street ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM moves"""))
def x14_history(spark, d):
    return cut(E.with_history(moves(spark, d)), F.array_join("history", " ").alias("history"))


def ratios(spark, d):
    return E.with_size_ratios(E.with_pot_before(E.with_facing(moves(spark, d))))


RATIO = f"SELECT *, facing_size / CAST(pot_before AS DOUBLE) AS facing_frac, amount / CAST(pot_before AS DOUBLE) AS size_frac, coalesce(CASE WHEN facing_size > 0 THEN amount / CAST(facing_size AS DOUBLE) END, -1.0) AS raise_ratio FROM ({POT})"


@query(with_roles(f"SELECT hand_id, seq, round(facing_frac, 5) AS facing_frac, round(size_frac, 5) AS size_frac, round(raise_ratio, 5) AS raise_ratio FROM ({RATIO})"))
def x15_size_ratios(spark, d):
    return cut(ratios(spark, d), *[F.round(c, 5).alias(c) for c in ("facing_frac", "size_frac", "raise_ratio")])


@query(with_roles("SELECT hand_id, seq, CASE WHEN l_suppkey % 5 > 0 THEN round(amount / CAST(l_suppkey % 5 AS DOUBLE), 3) END AS bb, 'NL' || (l_suppkey % 5) AS stake, coalesce(CAST(round(stack_after / CAST(nullif(amount, 0) AS DOUBLE) * 100) AS BIGINT), -1) AS spr FROM moves"))
def x16_to_bb(spark, d):
    blind = F.col("l_suppkey") % 5
    spr = F.col("stack_after") / F.nullif(F.col("amount"), F.lit(0))
    return cut(moves(spark, d), E.to_bb(F.col("amount"), blind).alias("bb"), E.stake_label(blind).alias("stake"), E.spr_x100(spr).alias("spr"))


@query(with_roles("SELECT hand_id, seq, row_number() OVER (PARTITION BY hand_id ORDER BY seq) - 1 AS decision_idx, hand_id || '_dp' || (row_number() OVER (PARTITION BY hand_id ORDER BY seq) - 1) AS id FROM moves WHERE action <> 'check'"))
def x17_decision_id(spark, d):
    return cut(E.with_decision_id(moves(spark, d).where("action <> 'check'")), "decision_idx", "id")


@query(with_roles(f"""SELECT hand_id, seq, len(list_distinct(coalesce(list(actor) FILTER (WHERE action = 'fold') OVER ({W}), []))) AS folded_before, CAST(coalesce(sum(amount) OVER (PARTITION BY hand_id, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS put_before, lead(amount) OVER (PARTITION BY hand_id ORDER BY seq) AS next_amount FROM moves"""))
def w10_rebuild_replay(spark, d):
    return cut(E.rebuild_replay(moves(spark, d)), "folded_before", "put_before", "next_amount")


# --- features -----------------------------------------------------------------

CARD = "substr('23456789TJQKA', CAST(({0}) % 13 + 1 AS INTEGER), 1) || substr('cdhs', CAST(floor(({0}) / 13) + 1 AS INTEGER), 1)"
NUMBERS = ["(l_partkey * 7) % 52", "(l_partkey * 7 + l_suppkey % 51 + 1) % 52"]


def with_dealt(df):
    """Moves with two hole cards and a board of three to five cards, all different."""
    n = [F.pmod(F.col("l_partkey") * 7 + k * (F.col("l_suppkey") % 7 + 4), F.lit(52)) for k in range(7)]
    df = df.where(F.size(F.array_distinct(F.array(*n))) == 7)
    board = F.slice(F.array(*map(C.card, n[2:])), F.lit(1), F.greatest(F.col("street_no") + 2, F.lit(3)).cast("int"))
    return df.withColumns({"hole": F.array(*map(C.card, n[:2])), "board": board})


def dealt(spark, d):
    return with_dealt(role(spark, d, "moves"))


#: The dealt cards in SQL: a card is its number; c all seven, h the hole, b the board.
DEALT = """g AS (SELECT *, c[1:2] AS h, c[3:(2 + greatest(street_no + 2, 3))] AS b FROM (SELECT hand_id, seq, street_no, list_transform(range(7), lambda k: (l_partkey * 7 + k * (l_suppkey % 7 + 4)) % 52) AS c FROM moves) WHERE len(list_distinct(c)) = 7)"""
TURNS = ", ".join(str(list(p)) for p in permutations(range(4)))


def form_sql(cards: str) -> str:
    """Cards under the suit turn ``p`` from the highest, as one string."""
    keys = f"list_sort(list_transform({cards}, lambda x: (12 - x % 13) * 4 + p[x // 13 + 1]))"
    return f"array_to_string(list_transform({keys}, lambda y: substr('23456789TJQKA', 13 - y // 4, 1) || substr('cdhs', y % 4 + 1, 1)), '')"


RUN = "len(list_filter(range(-1, 9), lambda lo: len(list_filter(range(lo, lo + 5), lambda q: list_contains({0}, (q + 13) % 13))) = 5)) > 0"
RANKS_SQL = "list_distinct(list_transform({0}, lambda x: x % 13))"
SUITED = "list_transform(list_filter({0}, lambda x: x // 13 = {1}), lambda x: x % 13)"
OF_A_KIND = "len(list_filter(range(13), lambda r: len(list_filter({0}, lambda x: x % 13 = r)) >= {1}))"


def class_sql(cards: str) -> str:
    suits = [SUITED.format(cards, k) for k in range(4)]
    return f"""CASE WHEN {' OR '.join(RUN.format(s) for s in suits)} THEN 8 WHEN {OF_A_KIND.format(cards, 4)} > 0 THEN 7 WHEN {OF_A_KIND.format(cards, 3)} > 0 AND {OF_A_KIND.format(cards, 2)} > 1 THEN 6
 WHEN {' OR '.join(f'len({s}) >= 5' for s in suits)} THEN 5 WHEN {RUN.format(RANKS_SQL.format(cards))} THEN 4 WHEN {OF_A_KIND.format(cards, 3)} > 0 THEN 3 WHEN {OF_A_KIND.format(cards, 2)} > 1 THEN 2 WHEN {OF_A_KIND.format(cards, 2)} > 0 THEN 1 ELSE 0 END"""


HIGHEST = "coalesce(list_max(list_filter(range(13), lambda r: len(list_filter({0}, lambda x: x % 13 = r)) {1})), 0)"


@query(with_roles(f"""WITH c AS (SELECT hand_id, seq, {CARD.format(NUMBERS[0])} AS a, {CARD.format(NUMBERS[1])} AS b, (l_partkey * 7) % 52 % 13 AS x, ((l_partkey * 7 + l_suppkey % 51 + 1) % 52) % 13 AS y FROM moves)
SELECT hand_id, seq, CASE WHEN x >= y THEN substr(a, 1, 1) || substr(b, 1, 1) ELSE substr(b, 1, 1) || substr(a, 1, 1) END || CASE WHEN x = y THEN '' WHEN substr(a, 2, 1) = substr(b, 2, 1) THEN 's' ELSE 'o' END AS cls FROM c"""))
def f01_combo_169(spark, d):
    a, b = C.card(F.expr(NUMBERS[0])), C.card(F.expr(NUMBERS[1]))
    return cut(moves(spark, d), C.combo_169(a, b).alias("cls"))


@query(with_roles(f"""WITH {DEALT}, f AS (SELECT hand_id, seq, min({form_sql('h')} || '|' || {form_sql('b')}) AS canonical FROM g, (SELECT unnest([{TURNS}]) AS p) GROUP BY hand_id, seq) SELECT canonical, count(*) AS n FROM f GROUP BY canonical"""))
def f02_joint_canonical(spark, d):
    return dealt(spark, d).select(C.joint_canonical(F.col("hole"), F.col("board")).alias("canonical")).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles(f"""WITH {DEALT}, f AS (SELECT hand_id, seq, min({form_sql('b')}) AS board FROM g, (SELECT unnest([{TURNS}]) AS p) GROUP BY hand_id, seq) SELECT board, count(*) AS n FROM f GROUP BY board"""))
def f03_canonical_board(spark, d):
    return dealt(spark, d).select(C.canonical_board(F.col("board")).alias("board")).groupBy("board").agg(F.count(F.lit(1)).alias("n"))


BOARD3 = [f"((l_partkey * 7 + {k} * (l_suppkey % 7 + 4)) % 52)" for k in (2, 3, 4)]


@query(with_roles(f"""WITH b AS (SELECT price, [{', '.join(x + ' // 13' for x in BOARD3)}] AS s, [{', '.join(x + ' % 13' for x in BOARD3)}] AS r FROM moves)
SELECT CASE WHEN len(list_distinct(s)) = 1 THEN 'monotone' WHEN len(list_distinct(r)) < 3 THEN 'paired' WHEN len(list_distinct(s)) = 2 THEN 'wet_two_tone' ELSE 'dry_rainbow' END AS texture, count(*) AS n, round(sum(price), 2) AS total FROM b GROUP BY 1"""))
def f04_board_texture(spark, d):
    board = F.array(*[C.card(F.expr(x)) for x in BOARD3])
    return role(spark, d, "moves").groupBy(C.board_texture(board).alias("texture")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(with_roles(f"""WITH b AS (SELECT m.hand_id, [{', '.join(x + ' // 13' for x in BOARD3)}] AS s, [{', '.join(x + ' % 13' for x in BOARD3)}] AS r FROM moves m WHERE seq = 0)
SELECT CASE WHEN len(list_distinct(s)) = 1 THEN 'monotone' WHEN len(list_distinct(r)) < 3 THEN 'paired' WHEN len(list_distinct(s)) = 2 THEN 'wet_two_tone' ELSE 'dry_rainbow' END AS texture, count(*) AS n, round(sum(bb_delta), 3) AS bb FROM b JOIN payoffs p ON p.hand_id = b.hand_id GROUP BY 1"""))
def a29_by_texture(spark, d):
    from decilog.operators import metrics as M

    board = F.array(*[C.card(F.expr(x)) for x in BOARD3])
    first = moves(spark, d).where("seq = 0").select("hand_id", board.alias("board")).join(role(spark, d, "payoffs"), "hand_id")
    return M.by_texture(first, C.board_texture(F.col("board"))).select("texture", "n", F.round("bb", 3).alias("bb"))


@query(with_roles(f"""WITH {DEALT}, f AS (SELECT CAST(len(b) AS INTEGER) AS n_cards, {OF_A_KIND.format('b', 2)} > 0 AS paired, CAST(list_max(list_transform(range(4), lambda s: len(list_filter(b, lambda x: x // 13 = s)))) AS INTEGER) AS max_suit,
 list_max(list_transform(b, lambda x: x % 13)) + 2 AS high, list_max(list_transform(b, lambda x: x % 13)) - list_min(list_transform(b, lambda x: x % 13)) AS span, len(list_filter(b, lambda x: x % 13 >= 8)) AS broadway,
 len(list_filter(range(-1, 9), lambda lo: len(list_filter(range(lo, lo + 5), lambda q: list_contains({RANKS_SQL.format('b')}, (q + 13) % 13))) >= 3)) > 0 AS connected FROM g)
SELECT n_cards, paired, max_suit, connected, count(*) AS n, round(avg(span), 6) AS span, round(avg(high), 6) AS high, round(avg(broadway), 6) AS broadway FROM f GROUP BY n_cards, paired, max_suit, connected"""))
def f05_board_features(spark, d):
    f = dealt(spark, d).select(C.board_features(F.col("board")).alias("f")).select("f.*").groupBy("n_cards", "paired", "max_suit", "connected")
    return f.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(to) for c, to in (("span", "span"), ("high_rank", "high"), ("broadway", "broadway"))])


ALL_RANKS = RANKS_SQL.format("list_concat(h, b)")


@query(with_roles(f"""WITH {DEALT}, s AS (SELECT hand_id, seq, len(b) AS n, {' OR '.join(f"(len({SUITED.format('h', k)}) + len({SUITED.format('b', k)}) >= 4 AND len({SUITED.format('h', k)}) >= 1)" for k in range(4))} AS fl, {' OR '.join(f"(len({SUITED.format('h', k)}) = 2 AND len({SUITED.format('b', k)}) = 1)" for k in range(4))} AS bd,
 len(list_filter(range(1, 9), lambda r: len(list_filter(range(r, r + 4), lambda q: list_contains({ALL_RANKS}, q))) = 4 AND NOT list_contains({ALL_RANKS}, r - 1) AND NOT list_contains({ALL_RANKS}, r + 4))) > 0 AS oe,
 len(list_filter(range(-1, 9), lambda lo: len(list_filter(range(lo, lo + 5), lambda q: list_contains({ALL_RANKS}, (q + 13) % 13))) = 4 AND (lo >= 0 OR list_contains({ALL_RANKS}, 12) AND list_contains({ALL_RANKS}, 0) AND list_contains({ALL_RANKS}, 1)))) > 0 AS wi FROM g),
t AS (SELECT hand_id, seq, n, fl AND n < 5 AS fl, bd AND n = 3 AS bd, oe AND n < 5 AS oe, wi AND NOT oe AND n < 5 AS gut FROM s), o AS (SELECT *, CASE WHEN fl THEN 9 ELSE 0 END + CASE WHEN oe THEN 8 WHEN gut THEN 4 ELSE 0 END AS outs FROM t)
SELECT hand_id, seq, fl AS flush_draw, bd AS backdoor_flush, oe AS open_ender, gut AS gutshot, fl AND (oe OR gut) AS combo_draw, round(outs / CAST(50 - n AS DOUBLE), 6) AS ppot, CAST(0 AS DOUBLE) AS npot, outs FROM o"""))
def f06_draw_features(spark, d):
    return cut(dealt(spark, d), C.draw_features(F.col("hole"), F.col("board")).alias("f")).select("hand_id", "seq", "f.*").withColumn("ppot", F.round("ppot", 6))


@query(with_roles(f"""WITH {DEALT} SELECT hand_id, seq, {class_sql('list_concat(h, b)')} AS made FROM g"""))
def f07_made_hand(spark, d):
    return cut(dealt(spark, d), C.made_hand(F.col("hole"), F.col("board")).alias("made"))


@query(with_roles(f"""WITH {DEALT}, a AS (SELECT hand_id, seq, list_concat(h, b) AS a, h, b, {class_sql('list_concat(h, b)')} AS cls FROM g),
r AS (SELECT hand_id, seq, cls, CASE WHEN cls = 1 THEN {HIGHEST.format('a', '>= 2')} WHEN cls IN (3, 6) THEN {HIGHEST.format('a', '>= 3')} ELSE 0 END AS pair_rank, CASE WHEN cls = 1 THEN {HIGHEST.format('a', '= 1')} ELSE 0 END AS kicker,
 list_max(list_transform(b, lambda x: x % 13)) AS top, h[1] % 13 = h[2] % 13 AS pocket, h[1] % 13 AS own FROM a)
SELECT hand_id, seq, cls AS rank_category, CAST(pair_rank AS INTEGER) AS pair_rank, CAST(kicker AS INTEGER) AS kicker, cls IN (3, 6) AND pocket AND own = pair_rank AS is_set, cls IN (1, 3) AND pair_rank = top AS top_pair, cls = 1 AND pocket AND own > top AS overpair FROM r"""))
def f07_made_hand_features(spark, d):
    return cut(dealt(spark, d), C.made_hand_features(F.col("hole"), F.col("board")).alias("f")).select("hand_id", "seq", "f.*")


@query(with_roles(f"""WITH c AS (SELECT (l_partkey * 7) % 52 AS a, (l_partkey * 7 + l_suppkey % 51 + 1) % 52 AS b FROM moves), r AS (SELECT greatest(a % 13, b % 13) AS x, least(a % 13, b % 13) AS y, a // 13 = b // 13 AS s, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT substr('23456789TJQKA', x + 1, 1) || substr('23456789TJQKA', y + 1, 1) || CASE WHEN x = y THEN '' WHEN s THEN 's' ELSE 'o' END AS cls, CAST(sum(n) AS BIGINT) AS n, CASE WHEN x = y THEN 6 WHEN s THEN 4 ELSE 12 END AS combos, x = y AS pair, s AND x <> y AS suited, CAST(greatest(x - y - 1, 0) AS BIGINT) AS gap, x >= 8 AND y >= 8 AS broadway, CAST(x + 2 AS BIGINT) AS high FROM (SELECT x, y, s AND x <> y AS s, sum(n) AS n FROM r GROUP BY 1, 2, 3) GROUP BY x, y, s"""))
def f11_class_features(spark, d):
    cls = C.combo_169(C.card(F.expr(NUMBERS[0])), C.card(F.expr(NUMBERS[1])))
    df = role(spark, d, "moves").select(cls.alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return df.select("cls", "n", C.class_features(F.col("cls")).alias("f"), C.class_combos(F.col("cls")).alias("combos")).select("cls", "n", "combos", "f.*")


GEO = f"""WITH a AS (SELECT hand_id, seq, actor, {AGG} AS aggressor, stack_after / CAST(pot_before AS DOUBLE) AS spr, pot_before / 10.0 AS pot_bb, coalesce(facing_size / CAST(pot_before AS DOUBLE), 0) AS f, amount / 10.0 AS to_bb, stack_after / 10.0 AS stack_bb FROM ({POT}))"""


@query(with_roles(GEO + """SELECT hand_id, seq, round(CASE WHEN f > 0 THEN least(f / (1 + f), 0.5) ELSE 0 END, 12) AS pot_odds, round(least(ln(1 + spr) / ln(101), 1), 12) AS log_spr, round(CASE WHEN stack_bb + to_bb > 0 THEN to_bb / (stack_bb + to_bb) ELSE 0 END, 12) AS commitment,
 round(least(ln(1 + pot_bb) / ln(201), 1), 12) AS log_pot, round(least(f / 5, 1), 12) AS facing_frac, CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END AS facing, CASE WHEN actor = aggressor THEN 1.0 ELSE 0.0 END AS was_aggressor FROM a"""))
def f08_geometry(spark, d):
    """The seven entries of the later streets; the first street has three of them."""
    df = E.with_aggressor(ratios(spark, d))
    vec = X.pot_geometry(F.coalesce("facing_frac", F.lit(0.0)), F.col("stack_after") / F.col("pot_before"), F.col("pot_before") / 10, F.col("amount") / 10, F.col("stack_after") / 10, F.coalesce(F.col("actor") == F.col("aggressor"), F.lit(False)))
    names = ["pot_odds", "log_spr", "commitment", "log_pot", "facing_frac", "facing", "was_aggressor"]
    return cut(df, vec.alias("v")).select("hand_id", "seq", *[F.round(F.col("v")[k], 12).alias(n) for k, n in enumerate(names)])


SEATS_SQL = "['UTG', 'MP', 'CO', 'BTN', 'SB', 'BB']"


@query(with_roles(f"""WITH f AS ({FACING}), a AS (SELECT f.*, {AGG} AS aggressor FROM f), v AS (SELECT *, coalesce(facing_pos, aggressor) AS villain FROM a)
SELECT hand_id, seq, list_position({SEATS_SQL}, actor) AS hero_slot, coalesce(list_position({SEATS_SQL}, villain), 0) AS villain_slot, CASE WHEN aggressor <> actor AND aggressor = villain THEN 1.0 ELSE 0.0 END AS villain_raised,
 CAST(CASE villain WHEN 'UTG' THEN 1.0 WHEN 'MP' THEN 0.8 WHEN 'CO' THEN 0.6 WHEN 'BTN' THEN 0.4 ELSE 0.5 END AS DOUBLE) AS tightness, CAST(CASE villain WHEN 'UTG' THEN 0.3 WHEN 'MP' THEN 0.4 WHEN 'CO' THEN 0.6 WHEN 'BTN' THEN 0.8 WHEN 'BB' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS breadth,
 round(least(greatest(((coalesce(list_position({SEATS_SQL}, villain), 1) - list_position({SEATS_SQL}, actor)) / 6.0 + 1) / 2, 0), 1), 6) AS relative FROM v"""))
def f10_position_features(spark, d):
    """Slots that are set in the two one-hot blocks, and the entries behind the opponent's."""
    df = E.with_aggressor(E.with_facing(moves(spark, d)))
    hero = X.hero_position(F.col("actor"), F.lit("IP"), F.lit(6))
    villain = X.villain_position(F.coalesce("facing_pos", "aggressor"), F.col("actor"), F.col("aggressor"))
    v = cut(df, hero.alias("h"), villain.alias("v"))
    rest = [F.round(F.col("v")[6 + k], 6).alias(n) for k, n in enumerate(["villain_raised", "tightness", "breadth", "relative"])]
    return v.select("hand_id", "seq", F.array_position(F.slice("h", 1, 6), 1.0).alias("hero_slot"), F.array_position(F.slice("v", 1, 6), 1.0).alias("villain_slot"), *rest)


def hot_sql(column: str, values) -> list[str]:
    return [f"CASE WHEN {column} = '{v}' THEN 1.0 ELSE 0.0 END" for v in values]


VECTOR = [
    "least(ln(1 + pot_before) / 6, 1)", "least(ln(1 + stack_after) / 8, 1)", "least(stack_after / CAST(pot_before AS DOUBLE) / 20, 1)", "least(f / CAST(pot_before AS DOUBLE), 2) / 2", "f / CAST(pot_before + f AS DOUBLE)",
    *hot_sql("p.actor", E.AFTER_FLOP), *hot_sql("p.street", E.STREETS), "n_active / 6.0",
]


@query(with_roles(f"""WITH p AS (SELECT *, coalesce(facing_size, 0) AS f FROM ({POT})), a AS (SELECT hand_id, seq, n_active FROM ({ACTIVE}))
SELECT p.hand_id, p.seq, {', '.join(f'round(CAST({x} AS DOUBLE), 12) AS v{k}' for k, x in enumerate(VECTOR))} FROM p JOIN a ON a.hand_id = p.hand_id AND a.seq = p.seq WHERE n_active > 1"""))
def f14_feature_vector(spark, d):
    df = E.with_active_players(ratios(spark, d))
    vec = X.assemble(X.geometry(F.col("pot_before").cast("double"), F.col("stack_after").cast("double"), F.coalesce("facing_size", F.lit(0)).cast("double")), X.one_hot(F.col("actor"), E.AFTER_FLOP), X.one_hot(F.col("street"), E.STREETS), F.array(F.col("n_active") / 6))
    return cut(df, vec.alias("vec")).select("hand_id", "seq", *[F.round(F.col("vec")[k], 12).alias(f"v{k}") for k in range(len(VECTOR))])


@query(with_roles("SELECT 'actor=' || actor || '|street=' || street AS key, actor AS bucket, '?' AS other, count(*) AS n FROM moves GROUP BY 1, 2"))
def f15_cluster_key(spark, d):
    key = X.cluster_key(street=F.col("street"), actor=F.col("actor"))
    got = role(spark, d, "moves").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("key", X.bucket_of(F.col("key"), "actor").alias("bucket"), X.bucket_of(F.col("key"), "none").alias("other"), "n")


@query(with_roles(f"""WITH a AS (SELECT *, {AGG} AS aggressor FROM ({ACTIVE}))
SELECT street || '|' || action || '|n' || n_active || '|' || coalesce(aggressor || ':pfr', 'vNA') AS key, count(*) AS n FROM a WHERE n_active > 1 GROUP BY 1"""))
def f16_scenario_key(spark, d):
    df = E.with_active_players(E.with_aggressor(moves(spark, d)))
    key = X.scenario_key(F.col("street"), F.col("action"), F.col("n_active"), F.col("aggressor"))
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))




@query(with_roles("SELECT hand_id, count(*) AS n, arg_max(action, seq) AS last, round(sum(amount), 1) AS total FROM moves GROUP BY hand_id"))
def f18_parse_actions(spark, d):
    token = F.concat_ws(":", "actor", "action", "amount")
    line = moves(spark, d).groupBy("hand_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", token.alias("t")))), lambda x: x["t"]), " ").alias("line"))
    a = X.parse_actions(F.col("line"))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x["size"])
    return line.select("hand_id", F.size(a).cast("long").alias("n"), F.element_at(a, -1)["stem"].alias("last"), F.round(total, 1).alias("total"))


@query(with_roles(f"""SELECT hand_id, seq, CASE WHEN action <> 'raise' THEN action WHEN n = 0 THEN CASE WHEN actor IN ('SB', 'BB') THEN 'open_3bb' ELSE 'open_2_2bb' END WHEN n = 1 THEN CASE WHEN seq % 2 = 0 THEN '3bet_4x' ELSE '3bet_3x' END WHEN n = 2 THEN '4bet_2_5x' ELSE 'allin' END AS label
FROM (SELECT *, coalesce(sum({RAISED}) OVER ({W}), 0) AS n FROM moves) WHERE street = 'preflop'"""))
def f19_label_preflop(spark, d):
    df = E.with_pot_type(moves(spark, d)).where("street = 'preflop'")
    rel = F.when(F.col("seq") % 2 == 0, "OOP").otherwise("IP")
    return cut(df, X.label_preflop(F.col("action"), F.col("pot_type"), rel, F.col("actor")).alias("label"))


def snap_sql(x: str, buckets) -> str:
    pairs = ", ".join(f"{{'d': abs({x} - {v}), 'k': {k}, 'name': '{n}'}}" for k, (v, n) in enumerate(buckets))
    return f"list_min([{pairs}]).name"


@query(with_roles(f"""SELECT hand_id, seq, CASE WHEN action IN ('bet', 'raise') AND amount = 50 THEN 'allin' WHEN action = 'bet' THEN CASE WHEN size_frac >= 1.75 THEN 'bet_overbet' ELSE {snap_sql('size_frac', X.BETS)} END WHEN action = 'raise' THEN {snap_sql('raise_ratio', X.RAISES)} ELSE action END AS snapped FROM ({RATIO})"""))
def f20_snap(spark, d):
    got = X.snap(F.col("action"), F.col("size_frac"), F.col("raise_ratio"), F.col("amount") == 50)
    return cut(ratios(spark, d), got.alias("snapped"))


@query(with_roles("SELECT solve_id, round(greatest(0, 1 - exploitability / 100), 8) AS quality FROM solves"))
def f22_quality(spark, d):
    return role(spark, d, "solves").select("solve_id", F.round(X.quality(F.col("exploitability")), 8).alias("quality"))


@query(with_roles(f"""SELECT hand_id, seq, CASE WHEN street = 'preflop' THEN CASE WHEN coalesce(facing_size, 0) <= 0 THEN 'check,open_2_2bb,open_3bb,allin' ELSE 'fold,call,3bet_3x,3bet_4x,4bet_2_5x,allin' END
 WHEN coalesce(facing_size, 0) <= 0 THEN 'check,bet_25,bet_33,bet_50,bet_75,bet_100,bet_150,bet_overbet,allin' ELSE 'fold,call,raise_min,raise_2_5x,raise_3x,raise_pot,allin' END AS legal FROM ({FACING})"""))
def f23_legal_actions(spark, d):
    return cut(E.with_facing(moves(spark, d)), F.array_join(X.legal_actions(F.col("street"), F.col("facing_size")), ",").alias("legal"))


@query(with_roles("SELECT hand_id || '_dp' || seq AS id, CAST(hand_id AS VARCHAR) AS parent, CAST(seq AS INTEGER) AS dp FROM moves"))
def f24_decision_parts(spark, d):
    ids = moves(spark, d).select(F.concat("hand_id", F.lit("_dp"), "seq").alias("id"))
    return ids.select("id", X.parent_id(F.col("id")).alias("parent"), X.dp_index(F.col("id")).alias("dp"))


@query(with_roles("""WITH n AS (SELECT actor, action, count(*) AS w FROM moves GROUP BY actor, action), s AS (SELECT actor, action, round(w / CAST(max(w) OVER (PARTITION BY actor) AS DOUBLE), 2) AS s FROM n)
SELECT actor, string_agg(CASE WHEN s >= 1 THEN action ELSE action || ':' || printf('%.2f', s) END, ',' ORDER BY action) AS notation FROM s WHERE s >= 0.005 GROUP BY actor"""))
def f26_range_notation(spark, d):
    df = role(spark, d, "moves").groupBy("actor", "action").agg(F.count(F.lit(1)).alias("w"))
    return X.range_notation(df, "actor", "action", "w")


@query(with_roles(f"""WITH a AS (SELECT *, {AGG} AS opener, CASE WHEN street = 'preflop' THEN coalesce(sum({RAISED}) OVER ({W}), 0) ELSE sum({RAISED}) OVER (PARTITION BY hand_id) END AS raises FROM moves),
t AS (SELECT *, CASE WHEN raises = 0 THEN 'limp' WHEN raises = 1 THEN 'srp' WHEN raises = 2 THEN '3bet' WHEN raises = 3 THEN '4bet' ELSE '5bet+' END AS pot FROM a)
SELECT CASE WHEN pot = 'limp' THEN actor || '_limp' WHEN pot = 'srp' THEN CASE WHEN actor = opener THEN actor || '_open' ELSE actor || '_call_vs_' || coalesce(opener, 'BTN') END WHEN actor = opener THEN actor || '_call_' || pot ELSE actor || '_' || pot END AS key, count(*) AS n FROM t GROUP BY 1"""))
def f27_palette_key(spark, d):
    df = E.with_pot_type(E.with_aggressor(moves(spark, d)))
    key = X.palette_key(F.col("pot_type"), F.lit("BTN"), F.col("actor"), F.col("aggressor"))
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT action, count(*) FILTER (WHERE seats - 1 + 1 >= 3) AS multiway, count(*) AS n FROM (SELECT *, len(list_distinct(list(actor) OVER (PARTITION BY hand_id))) AS seats FROM moves) GROUP BY action"))
def p10_is_multiway(spark, d):
    from pyspark.sql import Window

    df = moves(spark, d).withColumn("seats", F.size(F.collect_set("actor").over(Window.partitionBy("hand_id"))))
    return df.groupBy("action").agg(F.count_if(P.is_multiway(F.col("seats") - 1)).alias("multiway"), F.count(F.lit(1)).alias("n"))


DIST = "SELECT actor, street, action, count(*) / CAST(sum(count(*)) OVER (PARTITION BY actor, street) AS DOUBLE) AS p FROM moves GROUP BY actor, street, action"


def dist_maps(spark, d):
    from decilog.operators.stats import action_freq

    p = action_freq(role(spark, d, "moves"), ["actor", "street"])
    return p.groupBy("actor", "street").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "p")))).alias("dist"))


@query(with_roles(f"""WITH d AS ({DIST}), l AS (SELECT *, sum(CASE WHEN action IN ('fold', 'call') THEN p ELSE 0 END) OVER (PARTITION BY actor, street) AS t FROM d)
SELECT actor, street, action, round(p / t, 6) AS prob FROM l WHERE action IN ('fold', 'call')"""))
def p06_filter_legal(spark, d):
    legal = P.filter_legal(F.col("dist"), F.array(F.lit("fold"), F.lit("call")), F.lit("call"))
    return dist_maps(spark, d).select("actor", "street", F.explode(legal).alias("action", "prob")).withColumn("prob", F.round("prob", 6))


@query(with_roles(f"""WITH d AS ({DIST}) SELECT actor, street, concat_ws(',', CASE WHEN bool_or(action NOT IN ('fold', 'call', 'check', 'raise')) THEN 'unknown' END, CASE WHEN street = 'river' THEN 'sum' END) AS errors FROM d GROUP BY actor, street"""))
def p07_dist_errors(spark, d):
    df = dist_maps(spark, d).withColumn("dist", F.when(F.col("street") == "river", F.transform_values("dist", lambda k, v: v / 2)).otherwise(F.col("dist")))
    return df.select("actor", "street", F.array_join(P.dist_errors(F.col("dist"), ["fold", "call", "check", "raise"]), ",").alias("errors"))
