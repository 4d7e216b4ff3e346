"""Rankings, newest rows, feeds and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.operators import stats


def rank_leaks(by_cluster: DataFrame, min_n: int = 20, limit: int = 20, sigma2: float = 0.05, bucket: str = "bucket") -> DataFrame:
    """Clusters by shrunken loss x ln(max(n, 2)).

    ``by_cluster``: cluster_key, mean, n, source, bucket. Stage A are clusters of the
    automatic sources, B the rest.
    """
    shrunk = stats.with_ci(stats.eb_shrink(by_cluster.where(F.col("n") >= min_n), bucket, "mean", "n", sigma2))
    shrunk = shrunk.withColumns(
        {
            "shrunk": stats.is_shrunk(F.col("n"), F.col("tau2"), sigma2),
            "score": F.col("post_mean") * F.log(F.greatest("n", F.lit(2))),
            "stage": F.when(F.col("source").isin("manual", "solver"), "B").otherwise("A"),
        }
    )
    return shrunk.orderBy(F.desc_nulls_last("score"), "cluster_key").limit(limit)


def eligible(df: DataFrame, nodes: DataFrame, suppressions: DataFrame, barred: tuple[str, ...] = ("seed", "manual")) -> DataFrame:
    """Rows whose cluster is not suppressed and whose newest active node is neither locked nor barred by source."""
    live = nodes.where("active").groupBy("cluster_key").agg(F.max_by(F.struct("locked", "source"), "created_at").alias("node"))
    hidden = suppressions.where("active").select("cluster_key").distinct()
    kept = df.join(hidden, "cluster_key", "left_anti").join(live, "cluster_key", "left")
    bad = F.coalesce(F.col("node.locked") | F.col("node.source").isin(*barred), F.lit(False))
    return kept.where(~bad).drop("node")


def leak_candidates(metrics: DataFrame, nodes: DataFrame, suppressions: DataFrame, tau: float = 0.3, min_obs: int = 20, n: int = 5, barred: tuple[str, ...] = ("seed", "manual")) -> DataFrame:
    """Per session, the ``n`` eligible clusters over ``tau`` with the best value x ln n."""
    df = eligible(metrics.where((F.col("value") > tau) & (F.col("n") >= min_obs)), nodes, suppressions, barred)
    df = df.withColumn("score", F.col("value") * F.log(F.greatest("n", F.lit(2))))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "cluster_key"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def coverage_gaps(obs: DataFrame, floor: float | None = None, inclusive: bool = False, limit: int = 50) -> DataFrame:
    """Sparse rows by distance, largest first, unknown last; over (or from) ``floor`` if given."""
    df = obs.where("sparse")
    if floor is not None:
        df = df.where(F.col("distance") >= floor if inclusive else F.col("distance") > floor)
    return df.orderBy(F.desc_nulls_last("distance"), "obs_id").limit(limit)


def latest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key by ``order``, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest(df: DataFrame, keys: list[str], ts: list[str]) -> DataFrame:
    """The newest row per key."""
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*ts)).alias("row"))
    return got.select("row.*")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order``."""
    return df.orderBy(*order).limit(k)


def solve_priority(obs: DataFrame, metrics: DataFrame, solved: DataFrame, limit: int = 100) -> DataFrame:
    """Unsolved sparse rows with priority = rows of the cluster x its newest metric x distance.

    The order is flop first, then distance, as work is taken up; the priority is a column.
    """
    newest = metrics.groupBy("cluster_key").agg(F.max_by("value", F.struct("ts", "session_id")).alias("loss"))
    df = obs.where("sparse").join(solved.select("cluster_key").distinct(), "cluster_key", "left_anti")
    df = df.withColumn("in_cluster", F.count(F.lit(1)).over(Window.partitionBy("cluster_key"))).join(newest, "cluster_key", "left")
    df = df.withColumn("priority", F.col("in_cluster") * F.coalesce("loss", F.lit(0.0)) * F.coalesce("distance", F.lit(0.0)))
    return df.orderBy(F.when(F.col("action") == "view", 0).otherwise(1), F.desc_nulls_last("distance"), "obs_id").limit(limit)


def with_prev(patches: DataFrame) -> DataFrame:
    """The patch before each one in its cluster, strictly earlier."""
    w = Window.partitionBy("cluster_key").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    df = patches.withColumn("day", F.unix_seconds(F.col("ts").cast("timestamp")))
    return df.withColumn("prev_patch", F.max(F.struct("day", "patch_id")).over(w)["patch_id"]).drop("day")


def natural_order(df: DataFrame, id_col: str) -> DataFrame:
    """Ids ``<hand>_dp<k>`` in order of hand and number; ids without a number last."""
    number = F.regexp_extract(id_col, r"_dp(\d+)$", 1)
    return df.orderBy(F.regexp_replace(id_col, r"_dp\d+$", ""), F.when(number != "", number.cast("int")).asc_nulls_last(), id_col)


def with_place(ordered: DataFrame, path: str) -> DataFrame:
    """Rows of an ordered frame with their place from 1, without one task for all.

    The frame is written below ``path`` once; a row's place is its number within its
    partition after the rows of the partitions before it.
    """
    spark = ordered.sparkSession
    marked = ordered.withColumn("_m", F.monotonically_increasing_id())
    marked.write.parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path).withColumn("_p", F.shiftright("_m", 33))
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    starts = counts.select("_p", before.alias("_s"))
    place = F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return marked.join(F.broadcast(starts), "_p").withColumn("place", place).drop("_m", "_p", "_s")


def activity(patches: DataFrame, matches: DataFrame, n: int = 10) -> DataFrame:
    """Patches and finished matches in one feed, newest first: kind, ref, ts, note."""
    left = patches.select(F.lit("patch").alias("kind"), F.col("patch_id").alias("ref"), "ts", F.col("source").alias("note"))
    right = matches.where("status = 'completed'").select(F.lit("match").alias("kind"), F.col("hand_id").alias("ref"), "ts", F.col("opponent").alias("note"))
    return left.unionByName(right).orderBy(F.desc("ts"), "kind", "ref").limit(n)


def patch_history(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Patches with their new and (if any) previous node."""
    new = nodes.select(F.col("node_id").alias("new_node_id"), F.col("gto_score").alias("new_score"), F.col("source").alias("new_source"))
    old = nodes.select(F.col("node_id").alias("prev_node_id"), F.col("gto_score").alias("prev_score"))
    return patches.join(new, "new_node_id").join(old, "prev_node_id", "left")


def patch_chain(patches: DataFrame) -> DataFrame:
    """The patches of each cluster in order of time, a row each: cluster_key, place (from 1), patch_id, prev_patch."""
    order = Window.partitionBy("cluster_key").orderBy("ts", "patch_id")
    return patches.select("cluster_key", F.row_number().over(order).cast("long").alias("place"), "patch_id", F.lag("patch_id").over(order).alias("prev_patch"))


def browse_hands(index: DataFrame, ranges: DataFrame, obs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Hands with flags whether ranges and observations of them exist, most decisions first."""
    df = index
    for other, flag in ((ranges, "has_ranges"), (obs, "has_obs")):
        df = df.join(other.select("hand_id").distinct().withColumn(flag, F.lit(True)), "hand_id", "left").fillna(False, [flag])
    return df.orderBy(F.desc_nulls_last("n_decisions"), "hand_id").offset(offset).limit(limit)


def ranges_contract(rows: DataFrame) -> DataFrame:
    """One record per decision with the two seats side by side; multiway if a third seat took part."""
    seat = lambda k, c: F.max(F.when(F.col("seat_no") == k, F.col(c)))
    return rows.groupBy("decision_id").agg(
        seat(0, "actor").alias("oop"), seat(1, "actor").alias("ip"), seat(0, "weight").alias("oop_weight"), seat(1, "weight").alias("ip_weight"),
        (F.max("seat_no") > 1).alias("multiway"),
    )


def block_errors(rows: DataFrame) -> DataFrame:
    """Rows whose arrays do not fit: one weight per combo, and combos x actions strategy entries."""
    errors = F.concat_ws(
        ",",
        F.when(F.size("weights") != F.size("combos"), "weights"),
        F.when(F.size("strategy") != F.size("combos") * F.size("actions"), "strategy"),
    )
    return rows.withColumn("errors", errors).where("errors <> ''")
