"""Joins: active rows, existence flags, newest rows, fallback chains, candidates and bounded products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.operators.stats import pair_runs  # noqa: F401  (paired runs are a join too)


def newest_active(nodes: DataFrame) -> DataFrame:
    """One row per cluster: its newest active node."""
    return nodes.where("active").groupBy("cluster_key").agg(F.max_by(F.struct("node_id", "source"), "created_at").alias("n")).select("cluster_key", "n.node_id", "n.source")


def join_active(metrics: DataFrame, nodes: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Metric rows of unsuppressed clusters with the newest active node, if any."""
    hidden = suppressions.where("active").select("cluster_key").distinct()
    return metrics.join(hidden, "cluster_key", "left_anti").join(newest_active(nodes), "cluster_key", "left")


def with_exists(df: DataFrame, other: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``df`` with whether ``other`` has a row of the same key."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, on, "left").fillna(False, [flag])


def with_latest(df: DataFrame, other: DataFrame, on: str, ts: str, value: str, as_of: str | None = None, row_id: str | None = None) -> DataFrame:
    """Left join to the newest row of ``other`` per key, or to the newest not after ``as_of``.

    The as-of form sorts both sides together and carries the last value forward, so
    it does not pair every row with every earlier one.
    """
    if as_of is None:
        return df.join(other.groupBy(on).agg(F.max_by(value, ts).alias(value)), on, "left")
    left = df.select(on, F.col(as_of).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(other.schema[value].dataType).alias("_v"), row_id)
    right = other.select(on, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(df.schema[row_id].dataType).alias(row_id))
    w = Window.partitionBy(on).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return df.join(found.select(row_id, value), row_id)


def join_patch_nodes(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Patches with their new node and, where there is one, their previous node."""
    new = nodes.select(F.col("node_id").alias("new_node_id"), F.col("source").alias("new_source"))
    old = nodes.select(F.col("node_id").alias("prev_node_id"), F.col("source").alias("prev_source"))
    return patches.join(new, "new_node_id").join(old, "prev_node_id", "left")


def lookup_fallback(df: DataFrame, table: DataFrame, key: str, prefix: str, value: str) -> DataFrame:
    """``value`` by exact key, else of the smallest key with the same prefix, else the mean of all.

    ``level`` says which: 0, 1 or 2. A table with the same key twice is an error.
    """
    counted = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_v"))
    exact = counted.select(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key twice: "), F.col(key)))).otherwise(F.col("_v")).alias("_exact"))
    near = table.groupBy(prefix).agg(F.min_by(value, key).alias("_near"))
    mean = table.agg(F.avg(value).alias("_mean"))
    both = df.join(exact, key, "left").join(near, prefix, "left").crossJoin(F.broadcast(mean))
    level = F.when(F.col("_exact").isNotNull(), 0).when(F.col("_near").isNotNull(), 1).otherwise(2)
    return both.withColumns({value: F.coalesce("_exact", "_near", "_mean"), "level": level.cast("long")}).drop("_exact", "_near", "_mean")


def join_chart(df: DataFrame, charts: DataFrame, keys: list[str], guard: Column) -> DataFrame:
    """Chart frequencies for the rows that ``guard`` admits; ``hit`` says whether a chart has them."""
    found = charts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "freq")))).alias("chart"))
    return df.join(found, keys, "left").withColumn("chart", F.when(guard, F.col("chart"))).withColumn("hit", F.col("chart").isNotNull())


def first_candidate(df: DataFrame, row_id: str, candidates: Column, table: DataFrame, name: str, value: str) -> DataFrame:
    """The value of the first of a row's candidate names that ``table`` has: row_id, name, value."""
    tried = df.select(row_id, F.posexplode(candidates).alias("_place", name)).join(table, name)
    return tried.groupBy(row_id).agg(F.min_by(F.struct(name, value), "_place").alias("_s")).select(row_id, f"_s.{name}", f"_s.{value}")


def pair_check(df: DataFrame, a: str, b: str, v: str, tolerance: float = 1e-9) -> DataFrame:
    """Pairs of a matrix whose two entries do not sum to 1, or that lack one."""
    other = df.select(F.col(b).alias(a), F.col(a).alias(b), F.col(v).alias("_w"))
    both = df.join(other, [a, b], "left")
    return both.where(F.col("_w").isNull() | (F.abs(F.col(v) + F.col("_w") - 1) > tolerance))


def side_cap(budget: int, sides: int) -> int | None:
    """Items of each side: floor(budget^(1/k)) of three or more sides, no limit of one or two."""
    return int(budget ** (1 / sides) + 1e-9) if sides > 2 else None


#: Rows of either side that one block of a product holds.
PRODUCT_ROWS = 4_000


def bounded_product(df: DataFrame, keys: list[str], side: str, item: str, w: str, budget: int = 500_000, sides: int = 2, block_rows: int = PRODUCT_ROWS) -> DataFrame:
    """Products of the sides' items within a key; from three sides on each keeps its floor(budget^(1/k)) heaviest.

    Two sides are not capped: both are cut into blocks of about ``block_rows`` within their key, and
    each pair of blocks is a join key of its own, so a key with many items is the work of many tasks.
    """
    cap = side_cap(budget, sides)
    if sides == 2:
        return spread_product(df, keys, side, item, w, block_rows)
    rank = F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc(w), item))
    top = df if cap is None else df.withColumn("_r", rank).where(F.col("_r") <= cap)
    got = top.where(F.col(side) == 0).select(*keys, F.col(item).alias("item_0"), F.col(w).alias("weight"))
    for k in range(1, sides):
        more = top.where(F.col(side) == k).select(*keys, F.col(item).alias(f"item_{k}"), F.col(w).alias("_w"))
        got = got.join(more, keys).withColumn("weight", F.col("weight") * F.col("_w")).drop("_w")
    return got


def spread_product(df: DataFrame, keys: list[str], side: str, item: str, w: str, block_rows: int) -> DataFrame:
    """Every item of side 0 with every item of side 1 of its key, by pairs of blocks: keys, item_0, weight, item_1.

    A side's items are cut by weight, so those of one weight lie together, and a block of side 1 is one
    row that an item of side 0 meets whole: its products come in order of the weight. What is
    written of such a result is runs and repeats, as an item has few bytes beside its products.
    The numbers by weight take one sort of a key's narrow rows, which its products outnumber by far.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    blocks = lambda k: F.ceil(F.count_if(F.col(side) == k) / block_rows).cast("int").alias(f"_n{k}")
    sizes = df.groupBy(*keys).agg(blocks(0), blocks(1)).where("_n0 > 0 AND _n1 > 0")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_w", "_item")) - 1

    def numbered(k: int) -> DataFrame:
        rows = df.where(F.col(side) == k).select(*keys, F.col(w).alias("_w"), F.col(item).alias("_item"))
        return rows.withColumn(f"_b{k}", F.floor(place / block_rows).cast("int"))

    def dealt(rows: DataFrame, k: int) -> DataFrame:
        rows = rows.join(sizes, keys).withColumn(f"_b{1 - k}", F.explode(F.sequence(F.lit(0), F.col(f"_n{1 - k}") - 1))).drop("_n0", "_n1")
        # a count of tasks of its own: by bytes these are few, by what they yield many
        return rows.repartition(tasks, *keys, "_b0", "_b1")

    left = numbered(0).withColumnsRenamed({"_w": "weight", "_item": "item_0"})
    right = numbered(1).groupBy(*keys, "_b1").agg(F.array_sort(F.collect_list(F.struct("_w", "_item"))).alias("_rows"))  # at most block_rows
    both = dealt(left, 0).join(dealt(right, 1), [*keys, "_b0", "_b1"])
    both = both.select(*keys, "item_0", "weight", F.inline("_rows").alias("_w", "item_1"))
    return both.select(*keys, "item_0", (F.col("weight") * F.col("_w")).alias("weight"), "item_1")


def product_distribution(df: DataFrame, keys: list[str], side: str, x: str, w: str, sides: int = 2, budget: int = 500_000) -> DataFrame:
    """The weighted distribution of the product of one value of each side: keys, x, w.

    A side's equal values are added up first, and equal products after every side, so what
    is held for a key are distinct products, not tuples. Exact for two sides; from three on
    each side keeps its heaviest values (see :func:`side_cap`). Weights that are not
    positive are out; a key that lacks a side has no rows.
    """
    folded = df.where(F.col(w) > 0).groupBy(*keys, side, F.col(x).alias("x")).agg(F.sum(w).alias("w"))
    cap = side_cap(budget, sides)
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("w"), "x"))
        folded = folded.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")
    of = lambda k: folded.where(F.col(side) == k).drop(side)
    got = of(0)
    for k in range(1, sides):
        both = got.join(of(k).withColumnsRenamed({"x": "_x", "w": "_w"}), keys)
        got = both.groupBy(*keys, (F.col("x") * F.col("_x")).alias("x")).agg(F.sum(F.col("w") * F.col("_w")).alias("w"))
    return got


def enrich(neighbours: DataFrame, obs: DataFrame, nodes: DataFrame, cluster: str = "cluster_key") -> DataFrame:
    """Neighbour rows with their cluster's observation count, newest active node and smallest observation id."""
    counts = obs.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_obs"), F.min("obs_id").alias("sample_obs"))
    return neighbours.join(counts, cluster, "left").join(newest_active(nodes), cluster, "left").fillna(0, ["n_obs"])
