"""Range grids, charts, betting roles and solved spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.functions import features as X


def range_grid(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Per key and class of rows with parallel arrays combos, weights, equity: weight, mean weight, weighted equity."""
    cells = ranges.select(*key, F.explode(F.arrays_zip("combos", "weights", "equity")).alias("c")).select(*key, F.col("c.combos").alias("cls"), F.col("c.weights").alias("w"), F.col("c.equity").alias("e"))
    total = F.sum("w")
    return cells.groupBy(*key, "cls").agg(total.alias("weight"), F.avg("w").alias("mean_weight"), F.when(total > 0, F.sum(F.col("w") * F.col("e")) / total).alias("equity"))


def range_legend(cells: DataFrame, action: str = "action", w: str = "w") -> DataFrame:
    """Weight of each action and its share of all weight."""
    got = cells.groupBy(action).agg(F.sum(w).alias("weight"))
    return got.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))  # one row per action


def range_summary(dist: DataFrame, key: list[str], fold: str = "fold") -> DataFrame:
    """Per key: share that does not fold and number of classes that fold more than not."""
    by = dist.groupBy(*key, "cls").agg(F.sum(F.when(F.col("action") != fold, F.col("p")).otherwise(0.0)).alias("live"))
    return by.groupBy(*key).agg(F.avg("live").alias("live_share"), F.count_if(F.col("live") < 0.5).alias("folding"), F.count(F.lit(1)).alias("classes"))


def build_charts(dealt: DataFrame, key: list[str], cls: str = "cls", action: str = "action") -> DataFrame:
    """Raise and call frequencies of each class: a rate of the times dealt; a call has what a raise leaves. Zero rows go."""
    n = F.count(F.lit(1))
    got = dealt.groupBy(*key, cls).agg((F.count_if(F.col(action) == "raise") / n).alias("raise"), (F.count_if(F.col(action) == "call") / n).alias("call"))
    got = got.withColumn("call", F.least("call", 1 - F.col("raise")))
    rows = got.select(*key, cls, F.explode(F.create_map(F.lit("raise"), F.round("raise", 4), F.lit("call"), F.round("call", 4))).alias("action", "freq"))
    return rows.where("freq > 0")


def chart_coverage(charts: DataFrame, key: list[str], combos: Column) -> DataFrame:
    """Share of all 1326 card pairs that a chart plays, and its classes."""
    return charts.groupBy(*key).agg((F.sum(combos * F.col("freq")) / 1326).alias("mass"), F.countDistinct("cls").alias("n_combos"))


def betting_features(events: DataFrame) -> DataFrame:
    """Per hand and street: counts of each verb and of bets and raises by size bucket of the pot."""
    verb = lambda v: F.count_if(F.col("action") == v).alias(f"n_{v}")
    bold = F.col("action").isin("bet", "raise")
    size = F.col("size_frac")
    cut = [0.0, 0.33, 0.75, 1.25, 1e9]
    bins = [F.count_if(bold & (size > a) & (size <= b)).alias(f"size_{k}") for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    return events.groupBy("hand_id", "street").agg(*map(verb, ("fold", "check", "call", "bet", "raise")), *bins)


def with_blockers(df: DataFrame, row_id: str, cards: str, combos: DataFrame, key: str) -> DataFrame:
    """Share of a range's weight whose card pairs hold one of the row's cards: row_id, blocked.

    combos: key, a, b, w in long form. Rows whose key has no range get 0.
    """
    hit = F.array_contains(F.col(cards), F.col("a")) | F.array_contains(F.col(cards), F.col("b"))
    met = df.select(row_id, cards, key).join(combos, key).groupBy(row_id).agg((F.sum(F.when(hit, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("blocked"))
    return df.join(met, row_id, "left").fillna(0.0, ["blocked"])


def preflop_roles(events: DataFrame) -> DataFrame:
    """Role of each seat before the flop and the raiser it last met: hand_id, actor, role, target.

    By the seat's last action of weight: its raise by the raises before it (pfr, 3bettor,
    4bettor, 5bettor), else its call (limper without a raise, caller after one, cold_caller
    after more), else checker.
    """
    w = Window.partitionBy("hand_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = events.where("street = 'preflop'").withColumns(
        {"raises": F.coalesce(F.sum((F.col("action") == "raise").cast("int")).over(w), F.lit(0)), "raiser": F.last(F.when(F.col("action") == "raise", F.col("actor")), ignorenulls=True).over(w)}
    )
    role = (
        F.when(F.col("action") == "raise", F.element_at(F.array(*map(F.lit, ["pfr", "3bettor", "4bettor", "5bettor"])), (F.least("raises", F.lit(3)) + 1).cast("int")))
        .when((F.col("action") == "call") & (F.col("raises") == 0), "limper").when((F.col("action") == "call") & (F.col("raises") == 1), "caller")
        .when(F.col("action") == "call", "cold_caller").when((F.col("action") == "check") & (F.col("raises") == 0), "checker")
    )
    rated = first.withColumn("role", role).withColumn("rank", F.when(F.col("action") == "raise", 2).when(F.col("role").isNotNull(), 1).otherwise(0))
    got = rated.groupBy("hand_id", "actor").agg(F.max_by(F.struct("role", "raiser"), F.struct("rank", "seq")).alias("s"))
    return got.select("hand_id", "actor", F.coalesce("s.role", F.lit("unknown")).alias("role"), F.when(F.col("s.role").isNotNull(), F.col("s.raiser")).alias("target"))


def scenario_keys(roles: DataFrame, hero: str) -> DataFrame:
    """``seat:role[:target]`` of every other seat of a hand, sorted and joined by ``+``; vNA without one."""
    spec = F.concat_ws(":", "actor", "role", "target")
    return roles.groupBy("hand_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("actor") != hero, spec))), "+").alias("k")).select("hand_id", F.when(F.col("k") == "", "vNA").otherwise(F.col("k")).alias("scenario"))


def map_solver_actions(solves: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Solver labels as named actions with frequencies that sum to 1, and the rows whose label cannot be read.

    solves: key, label ("BET 120"), freq, pot, to_call, villain_total. A bet snaps by its
    share of the pot, a raise by what it adds over what the villain has in, per chip to call.
    """
    verb, chips = F.upper(F.split_part(F.trim("label"), F.lit(" "), F.lit(1))), F.split_part(F.trim("label"), F.lit(" "), F.lit(2)).try_cast("double")
    sized = chips.isNotNull() & (chips > 0)
    base = F.when(F.col("villain_total") > 0, F.col("villain_total")).otherwise(F.col("to_call"))
    ratio = chips / F.greatest("pot", F.lit(1e-9))
    bet = F.when(ratio >= 1.8, "bet_overbet").otherwise(X.nearest(ratio, X.BETS))
    name = (
        F.when(verb.isin("CHECK", "FOLD", "CALL"), F.lower(verb)).when(verb == "ALLIN", "allin").when((verb == "BET") & sized, bet)
        .when((verb == "RAISE") & sized & (F.col("to_call") > 0), X.nearest((chips - base) / F.nullif(F.col("to_call"), F.lit(0)), X.RAISES))
    )
    named = solves.withColumn("action", name)
    sums = named.where("action IS NOT NULL").groupBy(key, "action").agg(F.sum("freq").alias("p"))
    return sums.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key))), named.where("action IS NULL")


def ingest_solves(dist: DataFrame, solves: DataFrame, vectors: DataFrame, key: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """Corpus rows of solved spots: likeliest action, quality by exploitability, -1 for an unknown ratio; wrong vectors are rejected."""
    best = dist.groupBy(key).agg(F.max_by("action", F.struct("p", "action")).alias("action"), F.max("p").alias("p"))
    rows = solves.select(key, X.quality(F.col("exploitability")).alias("gto_score"), F.coalesce("spr", F.lit(-1)).alias("spr")).join(best, key).join(vectors, key)
    return rows.where(F.size("vec") == dims), rows.where(F.size("vec") != dims)
