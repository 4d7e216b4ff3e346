"""From neighbours to distributions: blending, legal actions, decisions, sampling, rebalancing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.operators import knn as K

#: How a voted action reads where no bet is faced, and where one is.
UNFACED = {"fold": "check", "call": "check", "raise_min": "bet_25", "raise_2_5x": "bet_50", "raise_3x": "bet_75", "raise_pot": "bet_100"}
FACED = {"check": "call", "bet_25": "raise_min", "bet_33": "raise_min", "bet_50": "raise_2_5x", "bet_75": "raise_3x", "bet_100": "raise_pot", "bet_150": "raise_pot", "bet_overbet": "raise_pot"}


def blend(neighbours: DataFrame, corpus: DataFrame, vocabulary: list[str] | None = None, id_col: str = "id", snap: Callable[[Column], Column] | None = None) -> DataFrame:
    """Action probabilities per query: weight = max(0, 1 - distance) x confidence x gto_score.

    A corpus row whose ``dist`` (a map of action -> share, where the corpus has that column)
    is there and not empty splits its weight over it; every other row votes for its
    ``action``. ``snap`` names an action in the terms of its own row, as an expression over the
    row's columns, before votes are added. Actions outside ``vocabulary``, and shares that are
    not positive, do not vote; a row with a vote counts with its whole weight, so what it
    gives to other actions lessens the sum. Queries without any weight give no rows.
    """
    named = snap or (lambda a: a)
    vote = lambda a, p: F.struct(named(a).alias("action"), p.alias("share"))
    votes = F.array(vote(F.col("action"), F.lit(1.0)))
    if "dist" in corpus.columns:
        votes = F.when(F.size("dist") > 0, F.transform(F.map_entries("dist"), lambda e: vote(e["key"], e["value"].cast("double")))).otherwise(votes)
    known = lambda v: (v["share"] > 0) & (v["action"].isNotNull() if vocabulary is None else F.coalesce(v["action"].isin(vocabulary), F.lit(False)))
    given = corpus.select(F.col(id_col).alias("nb"), "confidence", "gto_score", F.filter(votes, known).alias("votes")).where(F.size("votes") > 0)
    weight = F.greatest(F.lit(0.0), 1 - F.col("distance")) * F.coalesce("confidence", F.lit(1.0)) * F.coalesce("gto_score", F.lit(1.0))
    cast = neighbours.join(given, "nb").withColumn("w", weight).where("w > 0").select("query", "w", F.posexplode("votes").alias("place", "vote"))
    sums = cast.groupBy("query", F.col("vote.action").alias("action")).agg(F.sum(F.col("w") * F.col("vote.share")).alias("v"), F.sum(F.when(F.col("place") == 0, F.col("w")).otherwise(0.0)).alias("rows"))
    return sums.select("query", "action", (F.col("v") / F.sum("rows").over(Window.partitionBy("query"))).alias("prob"))


def remap(action: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, action), action)


def legalise(dist: DataFrame, key: str, facing: str, unfaced: dict[str, str] | None = None, faced: dict[str, str] | None = None) -> DataFrame:
    """Actions renamed to the legal family by the bet faced (0: none), added up and renormalised.

    A key whose probabilities sum to nothing checks, or calls when facing a bet.
    """
    free = F.col(facing) <= 0
    name = F.when(free, remap(F.col("action"), unfaced or UNFACED)).otherwise(remap(F.col("action"), faced or FACED))
    sums = dist.select(key, facing, name.alias("action"), "prob").groupBy(key, facing, "action").agg(F.sum("prob").alias("prob"))
    total = F.sum("prob").over(Window.partitionBy(key))
    sums = sums.withColumn("_t", total)
    empty = sums.where("_t <= 0").select(key, facing).distinct().select(key, F.when(free, "check").otherwise("call").alias("action"), F.lit(1.0).alias("prob"))
    return sums.where("_t > 0").select(key, "action", (F.col("prob") / F.col("_t")).alias("prob")).unionByName(empty)


def decide(spots: DataFrame, charts: DataFrame, chart_keys: list[str], blended: DataFrame, id_col: str = "id") -> DataFrame:
    """Chart frequencies where a chart has the spot (fold takes what is left), else the blend: id, action, prob, source."""
    hits = spots.select(id_col, *chart_keys).join(charts, chart_keys)
    rest = hits.groupBy(id_col).agg((1 - F.sum("freq")).alias("prob")).where(F.col("prob") > 1e-12).select(id_col, F.lit("fold").alias("action"), "prob")
    chart = hits.select(id_col, "action", F.col("freq").alias("prob")).unionByName(rest).groupBy(id_col, "action").agg(F.sum("prob").alias("prob"))
    known = hits.select(id_col).distinct()
    voted = blended.withColumnRenamed("query", id_col).join(known, id_col, "left_anti").select(id_col, "action", "prob")
    return chart.withColumn("source", F.lit("chart")).unionByName(voted.withColumn("source", F.lit("knn")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of ``key`` and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample_actions(dist: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One action per key, the same for the same key and seed: key, action."""
    w = Window.partitionBy(key)
    upto = F.sum("prob").over(w.orderBy("action").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("prob").over(w)
    cut = dist.withColumn("_c", upto).withColumn("_u", uniform(F.col(key), seed))
    return cut.where((F.col("_c") > F.col("_u")) | (F.col("_c") >= 1 - 1e-12)).groupBy(key).agg(F.min_by("action", "_c").alias("action"))


def similar(one_per_cluster: DataFrame, keys: list[str], obs: DataFrame, k: int = 10) -> DataFrame:
    """The nearest other clusters of each cluster, with their observations: query, nb, distance, rank, n_obs."""
    counts = obs.groupBy(F.col("cluster_key").alias("nb")).agg(F.count(F.lit(1)).alias("n_obs"))
    df = one_per_cluster.withColumnRenamed("cluster_key", "id")
    return K.knn(df, df, keys, k).join(counts, "nb", "left").fillna(0, ["n_obs"])


def rebalance(obs: DataFrame, corpus: DataFrame, keys: list[str], n_newest: int = 10, k: int = 10) -> DataFrame:
    """Per cluster, the mean of the blends of its newest observations, renormalised: cluster_key, action, prob, n_blends.

    ``obs``: id, cluster_key, ts, vec and the keys. Observations without a blend do not count.
    """
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("ts"), F.desc("id")))
    newest = obs.withColumn("_r", rank).where(F.col("_r") <= n_newest)
    dist = blend(K.knn(newest, corpus, keys, k), corpus).join(newest.select(F.col("id").alias("query"), "cluster_key"), "query")
    n = dist.groupBy("cluster_key").agg(F.countDistinct("query").alias("n_blends"))
    sums = dist.groupBy("cluster_key", "action").agg(F.sum("prob").alias("p"))
    total = F.sum("p").over(Window.partitionBy("cluster_key"))
    return sums.withColumn("prob", F.col("p") / total).drop("p").join(n, "cluster_key")
