"""Session metrics, trends, rollups and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.sources.io import work_dir


def novel_rate(obs: DataFrame, session: str, flag: str) -> DataFrame:
    """Share of flagged rows per session."""
    return obs.groupBy(session).agg(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")).alias("rate"))


def latency_percentiles(df: DataFrame, session: str, x: str, accuracy: int | None = None) -> DataFrame:
    """p50 and p99 with linear interpolation.

    They hold every distinct value of a session in one task. For sessions of unbounded
    size ``accuracy`` gives values whose rank is off by at most 1 / accuracy of the rows,
    from a sketch of bounded size.
    """
    at = (lambda p: F.percentile_approx(x, p, accuracy)) if accuracy else (lambda p: F.percentile(x, p))
    return df.groupBy(session).agg(at(0.5).alias("p50"), at(0.99).alias("p99"))


def exact_percentiles(df: DataFrame, keys: list[str], x: str, ps: list[float], bins: int = 256) -> DataFrame:
    """Percentiles with linear interpolation, without a key's values in one task: keys, p, value.

    Equal values are counted first. For each rank that is asked for, the values between the
    current bounds are counted in ``bins`` ranges of equal width, and the range that holds the
    rank becomes the new bounds, until it is one value. A round shuffles counts by range, a
    bounded number for each key and rank; a key with very many values is as many rows of the
    counted table, which any task may hold. Rounds are written to the shared folder. Nulls
    do not count; keys without values have no rows.
    """
    spark = df.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = work_dir(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    value = F.col(x).cast("double")
    counted = kept(df.where(value.isNotNull()).groupBy(*keys, value.alias("_x")).agg(F.count(F.lit(1)).alias("_n")), "counted")
    ends = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    exact = F.col("_p") * (F.col("_all") - 1)
    asked = ends.withColumn("_p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))))
    bounds = kept(asked.select(*keys, "_rank", "_low", "_high", F.lit(0).cast("long").alias("_under")).distinct(), "bounds")
    done = bounds.limit(0)
    while True:
        done = done.unionByName(bounds.where("_low = _high"))
        left = bounds.where("_low < _high")
        if not left.take(1):
            break
        inside = counted.join(left, keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))
        place = F.least(F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        ranges = inside.groupBy(*keys, "_rank", "_under", place.alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        order = Window.partitionBy(*keys, "_rank").orderBy("_bin")
        upto = ranges.withColumn("_upto", F.col("_under") + F.sum("_n").over(order))
        hit = upto.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        bounds = kept(hit.select(*keys, "_rank", "_low", "_high", (F.col("_upto") - F.col("_n")).alias("_under")), "bounds")
    found = done.select(*keys, "_rank", F.col("_low").alias("_v"))
    side = lambda name: found.select(*keys, F.col("_rank").alias(f"_{name}"), F.col("_v").alias(name))
    both = ends.select(*keys, "_all").withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_at", F.col("p") * (F.col("_all") - 1)).withColumns({"_a": F.floor("_at"), "_b": F.ceil("_at")})
    both = both.join(side("a"), [*keys, "_a"]).join(side("b"), [*keys, "_b"])
    return both.select(*keys, "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.col("_a"))).alias("value"))


def session_metrics(obs: DataFrame, losses: DataFrame, latency: str, session: str = "session_id") -> DataFrame:
    """Long metric rows of each session: session, cluster_key (null for the session's own), name, value.

    ``losses``: session, cluster_key, value.
    """
    blank = F.lit(None).cast("string").alias("cluster_key")
    own = losses.select(session, "cluster_key", F.lit("ev_loss").alias("name"), F.col("value").cast("double").alias("value"))
    novel = novel_rate(obs, session, "sparse").select(session, blank, F.lit("novel_spot_rate").alias("name"), F.col("rate").alias("value"))
    times = latency_percentiles(obs, session, latency).select(session, blank, F.posexplode(F.array("p50", "p99")).alias("k", "value"))
    times = times.select(session, "cluster_key", F.when(F.col("k") == 0, "latency_p50").otherwise("latency_p99").alias("name"), "value")
    return own.unionByName(novel).unionByName(times)


def metric_by_cluster(metrics: DataFrame, nodes: DataFrame, suppressions: DataFrame, since: Column) -> DataFrame:
    """Mean metric and sessions per cluster, with the newest active node's source.

    Rows before ``since`` and suppressed clusters are out; clusters without an active
    node have a null source.
    """
    live = nodes.where("active").groupBy("cluster_key").agg(F.max_by("source", "created_at").alias("source"))
    hidden = suppressions.where("active").select("cluster_key").distinct()
    kept = metrics.where(F.col("ts") > since).join(hidden, "cluster_key", "left_anti")
    got = kept.groupBy("cluster_key").agg(F.avg("value").alias("mean"), F.countDistinct("session_id").alias("sessions"), F.sum("n").alias("n"))
    return got.join(live, "cluster_key", "left")


def leaderboard(matches: DataFrame) -> DataFrame:
    """Per opponent over finished matches: played, completed, mean, hands; best mean first, nulls last."""
    done = matches.where(F.col("status").isin("completed", "aborted"))
    good = F.col("status") == "completed"
    return done.groupBy("opponent").agg(
        F.count(F.lit(1)).alias("played"), F.count_if(good).alias("completed"), F.avg(F.when(good, F.col("bb_delta"))).alias("mean"), F.max("bb_delta").alias("best")
    ).orderBy(F.desc_nulls_last("mean"), "opponent")


def exploitability(solves: DataFrame, visits: DataFrame) -> DataFrame:
    """Newest solve per cluster, mean weighted by visits (plain if there are none), and coverage."""
    newest = solves.groupBy("cluster_key").agg(F.max_by("exploitability", F.struct("solved_at", "solve_id")).alias("x"))
    seen = visits.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("visits"))
    both = newest.join(seen, "cluster_key", "full")
    w = F.when(F.col("x").isNotNull(), F.coalesce("visits", F.lit(0)))
    return both.agg(
        F.when(F.sum(w) > 0, F.sum(F.col("x") * w) / F.sum(w)).otherwise(F.avg("x")).alias("mean"),
        (F.coalesce(F.sum(w), F.lit(0)) / F.greatest(F.sum("visits"), F.lit(1))).alias("coverage"), F.count("x").alias("solved"),
    )


def metric_trend(metrics: DataFrame, n: int = 30) -> DataFrame:
    """Mean metric of the newest ``n`` sessions, oldest first."""
    newest = metrics.groupBy("session_id").agg(F.avg("value").alias("mean"), F.min("ts").alias("ts")).orderBy(F.desc("ts"), F.desc("session_id")).limit(n)
    return newest.select("session_id", "mean").orderBy("session_id")


def loop_health(metrics: DataFrame, as_of: Column, recent: int = 3, days: int = 7, band: float = 0.05) -> DataFrame:
    """Mean of the last sessions against everything older than ``days``: improving, stalled or mixed (within 5 %, or too little history)."""
    sessions = metrics.groupBy("session_id").agg(F.avg("value").alias("v"), F.min("ts").alias("ts"))
    now = sessions.orderBy(F.desc("ts")).limit(recent).agg(F.avg("v").alias("recent"))
    old = sessions.where(F.col("ts") < as_of - F.make_dt_interval(F.lit(days))).agg(F.avg("v").alias("before"))
    verdict = (
        F.when(F.col("before").isNull() | F.col("recent").isNull(), "mixed")
        .when(F.col("recent") < F.col("before") * (1 - band), "improving")
        .when(F.col("recent") > F.col("before") * (1 + band), "stalled")
        .otherwise("mixed")
    )
    return now.crossJoin(old).withColumn("verdict", verdict)  # one row each


def latest_session(obs: DataFrame) -> DataFrame:
    """Counts of the newest session."""
    return obs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sparse").alias("sparse"), F.countDistinct("cluster_key").alias("clusters")
    ).orderBy(F.desc("session_id")).limit(1)


def node_growth(nodes: DataFrame, as_of: int, span: int) -> DataFrame:
    """Active nodes by source, and those of the last ``span``."""
    return nodes.where("active").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at") > as_of - span).alias("fresh"))


def cluster_rollup(obs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per cluster: observations, any sparse, largest distance, mean metric."""
    rolled = obs.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_obs"), F.bool_or("sparse").alias("sparse"), F.max("distance").alias("max_distance"))
    return rolled.join(metrics.groupBy("cluster_key").agg(F.avg("value").alias("mean")), "cluster_key", "left")


def entity_rollup(moves: DataFrame) -> DataFrame:
    """Per hand: decisions, first actor, deepest street, first time."""
    order = F.struct("seq")
    return moves.groupBy("hand_id").agg(
        F.count(F.lit(1)).alias("n_decisions"), F.min_by("actor", order).alias("first_actor"),
        F.max_by("street", F.struct("street_no")).alias("street_reached"), F.min("ts").alias("first_ts"),
    )


def histogram(df: DataFrame, x: str, bins: int = 11) -> DataFrame:
    """Equal-width bins between the least and the largest value: bin, n. The largest is in the last bin."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sparkline(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """A string of levels 0 to 7 per key in ``order``; flat series are all 0."""
    w = Window.partitionBy(key)
    span = F.max(x).over(w) - F.min(x).over(w)
    level = F.when(span == 0, 0).otherwise(F.least(F.floor((F.col(x) - F.min(x).over(w)) / span * 8), F.lit(7))).cast("string")
    got = df.select(key, order, level.alias("level")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "level"))).alias("s"))
    return got.select(key, F.array_join(F.col("s.level"), "").alias("line"))


def vector_quality(df: DataFrame, vec: str) -> DataFrame:
    """Per dimension: rows, finite, within [-1, 1], zeros, distinct values at 3 decimals."""
    long = df.select(F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.every(~F.isnan("x")).alias("finite"), F.every(F.abs("x") <= 1).alias("in_range"),
        F.count_if(F.col("x") == 0).alias("zeros"), F.countDistinct(F.round("x", 3)).alias("spread"),
    )


def distinct_values(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """The first distinct values of a column, in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit)


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """Rows per reason."""
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def attribute_by_street(moves: DataFrame, payoffs: DataFrame) -> DataFrame:
    """Payoff by street in proportion to the chips put in.

    A hand without chips counts on its last street; one without decisions on preflop.
    """
    w = Window.partitionBy("hand_id")
    chips = moves.withColumns({"total": F.sum("chips").over(w), "last": F.max("street_no").over(w)})
    by = chips.groupBy("hand_id", "street", "street_no").agg(F.sum("chips").alias("chips"), F.max("total").alias("total"), F.max("last").alias("last"))
    share = F.when(F.col("total") > 0, F.col("chips") / F.col("total")).otherwise((F.col("street_no") == F.col("last")).cast("double"))
    both = payoffs.select("hand_id", "bb_delta").join(by.select("hand_id", "street", share.alias("share")), "hand_id", "left")
    both = both.select(F.coalesce("street", F.lit("preflop")).alias("street"), (F.col("bb_delta") * F.coalesce("share", F.lit(1.0))).alias("bb"))
    return both.groupBy("street").agg(F.sum("bb").alias("bb"))


def attribute_by_cluster(moves: DataFrame, payoffs: DataFrame, cluster: str) -> DataFrame:
    """Payoff by cluster in proportion to the chips; an equal split in hands without chips."""
    w = Window.partitionBy("hand_id")
    share = F.when(F.sum("chips").over(w) > 0, F.col("chips") / F.sum("chips").over(w)).otherwise(1 / F.count(F.lit(1)).over(w))
    both = moves.select("hand_id", cluster, share.alias("share")).join(payoffs.select("hand_id", "bb_delta"), "hand_id")
    return both.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_decisions"), F.sum(F.col("share") * F.col("bb_delta")).alias("bb_total"))


def top_clusters(df: DataFrame, x: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` largest with a positive and the ``n`` smallest with a negative value: side, rank, key, x."""
    best = df.orderBy(F.desc(x), key).limit(n).where(F.col(x) > 0).withColumn("side", F.lit("profitable"))
    worst = df.orderBy(F.asc(x), key).limit(n).where(F.col(x) < 0).withColumn("side", F.lit("leaky"))
    return best.unionByName(worst)


#: Share of the pot that an action commits; unknown actions count as 1.
ACTION_WEIGHTS = {"fold": 0.0, "check": 0.0, "call": 1.0, "bet": 1.0, "raise": 2.0, "allin": 4.0}


def action_weight(action: Column) -> Column:
    """Chip weight of an action."""
    table = F.create_map(*[F.lit(x) for kv in ACTION_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, action), F.lit(1.0))


def by_texture(payoffs: DataFrame, texture: Column) -> DataFrame:
    """Payoffs by board texture; rows without a board are out."""
    return payoffs.withColumn("texture", texture).where("texture IS NOT NULL").groupBy("texture").agg(F.sum("bb_delta").alias("bb"), F.count(F.lit(1)).alias("n"))


def suite_verdict(matches: DataFrame, gate_passed: DataFrame) -> DataFrame:
    """passed = the gate passed and every match's lower end is over 0 (none: true). One row."""
    tier = matches.agg(F.coalesce(F.every(F.col("ci_low") > 0), F.lit(True)).alias("matches_ok"))
    return gate_passed.crossJoin(tier).withColumn("passed", F.col("gate_ok") & F.col("matches_ok"))
