"""Divergences, shrinkage, intervals and shares over long tables.

A distribution is in long form: key columns, an action and a weight or probability.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-6


def action_freq(df: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """Share of each action within its keys: keys, action, n, p."""
    counted = df.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def _aligned(p: DataFrame, q: DataFrame, keys: list[str], action: str) -> DataFrame:
    """Both distributions over the union of their actions; missing probabilities are 0."""
    left = p.select(*keys, action, F.col("p").alias("pp"))
    right = q.select(*keys, action, F.col("p").alias("qq"))
    known = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)
    both = left.join(right, [*keys, action], "full").join(known, keys, "left_semi")
    return both.fillna(0.0, ["pp", "qq"])


def kl(p: DataFrame, q: DataFrame, keys: list[str], action: str = "action", eps: float = EPSILON) -> DataFrame:
    """KL(p || q) per key after adding ``eps`` to every entry of the union and renormalising."""
    w = Window.partitionBy(*keys)
    both = _aligned(p, q, keys, action).withColumns({"pp": F.col("pp") + eps, "qq": F.col("qq") + eps})
    both = both.withColumns({"pp": F.col("pp") / F.sum("pp").over(w), "qq": F.col("qq") / F.sum("qq").over(w)})
    return both.groupBy(*keys).agg(F.sum(F.col("pp") * F.log(F.col("pp") / F.col("qq"))).alias("kl"))


def kl_floor(p: DataFrame, q: DataFrame, keys: list[str], action: str = "action", eps: float = EPSILON) -> DataFrame:
    """KL(p || q) per key with both sides raised to ``eps``, not renormalised."""
    both = _aligned(p, q, keys, action).withColumns({c: F.greatest(c, F.lit(eps)) for c in ("pp", "qq")})
    return both.groupBy(*keys).agg(F.sum(F.col("pp") * F.log(F.col("pp") / F.col("qq"))).alias("kl_floor"))


def tvd(p: DataFrame, q: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """Total variation distance per key."""
    return _aligned(p, q, keys, action).groupBy(*keys).agg((0.5 * F.sum(F.abs(F.col("pp") - F.col("qq")))).alias("tvd"))


def eb_shrink(df: DataFrame, bucket: str, xbar: str, n: str, sigma2: float = 0.05) -> DataFrame:
    """Normal-normal empirical Bayes within ``bucket``: mu, tau2, b, post_mean, post_var.

    tau2 is the sample variance of the means less their mean sampling variance, at
    least 0. A row alone in its bucket keeps its mean and variance; with tau2 = 0 all
    means become mu and the variance vanishes.
    """
    w = Window.partitionBy(bucket)
    s = F.lit(sigma2) / F.col(n)
    df = df.withColumns({"mu": F.avg(xbar).over(w), "_k": F.count(F.lit(1)).over(w), "_v": F.var_samp(xbar).over(w), "_s": F.avg(s).over(w)})
    df = df.withColumn("tau2", F.when(F.col("_k") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_v") - F.col("_s"))))
    df = df.withColumn("b", F.when((F.col("_k") < 2), 0.0).when(F.col("tau2") == 0, 1.0).otherwise(s / (s + F.col("tau2"))))
    mean = F.when(F.col("_k") < 2, F.col(xbar)).otherwise(F.col("b") * F.col("mu") + (1 - F.col("b")) * F.col(xbar))
    var = F.when(F.col("_k") < 2, s).otherwise((1 - F.col("b")) * s)
    return df.withColumns({"post_mean": mean, "post_var": var}).drop("_k", "_v", "_s")


def with_ci(df: DataFrame, mean: str = "post_mean", var: str = "post_var") -> DataFrame:
    """The 95 % interval ``mean`` +- 1.96 sqrt(``var``): ci_low, ci_high."""
    half = 1.96 * F.sqrt(var)
    return df.withColumns({"ci_low": F.col(mean) - half, "ci_high": F.col(mean) + half})


def is_shrunk(n: Column, tau2: Column, sigma2: float = 0.05) -> Column:
    """Whether shrinkage is material: b over 0.1, and always when tau2 is 0."""
    s = F.lit(sigma2) / n
    return F.when(tau2 == 0, True).otherwise(s / (s + tau2) > 0.1)


def fit_zscore(df: DataFrame, vec: str, floor: float = 1e-6) -> DataFrame:
    """One row per dimension: dim, mean, std (population), guarded.

    A std under ``floor`` becomes 1 and is reported by ``guarded``.
    """
    long = df.select(F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    fit = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return fit.withColumns({"guarded": F.col("std") < floor, "std": F.when(F.col("std") < floor, 1.0).otherwise(F.col("std"))})


def manifest(fit: DataFrame) -> DataFrame:
    """A fit as one row of two arrays: means, stds."""
    got = fit.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    return got.select(F.col("s.mean").alias("means"), F.col("s.std").alias("stds"))


def normalise(df: DataFrame, vec: str, manifest_row: DataFrame, weights: list[float] | None = None, out: str = "z") -> DataFrame:
    """(x - mean) / std per dimension, times ``weights``; the manifest is one row."""
    z = F.zip_with(F.zip_with(vec, "means", lambda x, m: x.cast("double") - m), "stds", lambda x, s: x / s)
    if weights is not None:
        z = F.zip_with(z, F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return df.crossJoin(F.broadcast(manifest_row)).withColumn(out, z).drop("means", "stds")


def weighted_mean(df: DataFrame, keys: list[str], x: str, w: str, empty: float = 0.5) -> DataFrame:
    """Weighted mean per key; ``empty`` where no weight is left."""
    total = F.sum(w)
    return df.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(x) * F.col(w)) / total).otherwise(empty).alias("mean"))


def rates_with_fallback(df: DataFrame, levels: list[str], flags: dict[str, Column], min_n: int = 30) -> DataFrame:
    """Rates by all ``levels``, then by the last alone, then over everything.

    The first with at least ``min_n`` rows counts; ``level`` (0, 1, 2) says which.
    """
    rates = [F.avg(c.cast("double")) for c in flags.values()]
    cut = lambda keys, tag: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{tag}"), *[r.alias(f"{k}{tag}") for r, k in zip(rates, flags)])
    fine, mid, top = cut(levels, "_0"), cut(levels[-1:], "_1"), cut([], "_2")
    df = fine.join(mid, levels[-1:]).crossJoin(F.broadcast(top))
    use = F.when(F.col("n_0") >= min_n, 0).when(F.col("n_1") >= min_n, 1).otherwise(2)
    pick = {k: F.when(use == 0, F.col(f"{k}_0")).when(use == 1, F.col(f"{k}_1")).otherwise(F.col(f"{k}_2")) for k in flags}
    return df.select(*levels, use.cast("long").alias("level"), *[c.alias(k) for k, c in pick.items()])


def rank_by_rate(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Keys by the share of ``flag``, scaled to [0, 1] by rank: key, rate, scaled. Few keys."""
    got = df.groupBy(key).agg(F.avg(flag.cast("double")).alias("rate"))
    w = Window.orderBy("rate", key)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return got.withColumn("scaled", (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)))


def pair_similarity(df: DataFrame, key: str, action: str) -> DataFrame:
    """1 - Jensen-Shannon divergence (base 2) of the action shares of each two keys."""
    p = action_freq(df, [key], action).select(key, action, "p")
    keys = p.select(key).distinct()
    actions = p.select(action).distinct()
    full = keys.crossJoin(F.broadcast(actions)).join(p, [key, action], "left").fillna(0.0, ["p"])
    a, b = full.select(F.col(key).alias("a"), action, F.col("p").alias("x")), full.select(F.col(key).alias("b"), action, F.col("p").alias("y"))
    m = (F.col("x") + F.col("y")) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = a.join(b, action).where("a < b")
    return both.groupBy("a", "b").agg((1 - F.sum(half(F.col("x")) + half(F.col("y"))) / 2).alias("similarity"))


def modal(df: DataFrame, keys: list[str], action: str) -> DataFrame:
    """The most frequent action per key; ties go to the smaller name."""
    got = df.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("n"))
    return got.groupBy(*keys).agg(F.min_by(action, F.struct(-F.col("n"), F.col(action))).alias("modal"), F.max("n").alias("n"))


def weighted_quantiles(df: DataFrame, keys: list[str], x: str, w: str, ps: list[float]) -> DataFrame:
    """Quantiles of ``x`` by linear interpolation of the cumulative weight share.

    Below the first point the first value holds, above the last the last one. Rows
    without positive weight are out. keys, p, q.
    """
    order = Window.partitionBy(*keys).orderBy(x, w)
    whole = Window.partitionBy(*keys)
    df = df.where(F.col(w) > 0).withColumn("_c", F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(w).over(whole))
    df = df.withColumns({"_c0": F.lag("_c").over(order), "_x0": F.lag(x).over(order), "_last": F.max("_c").over(whole)})
    df = df.withColumn("p", F.explode(F.array(*map(F.lit, ps))))
    inside = (F.col("p") <= F.col("_c")) & (F.col("_c0").isNull() | (F.col("p") > F.col("_c0")))
    beyond = (F.col("p") > F.col("_last")) & (F.col("_c") == F.col("_last"))
    line = F.col("_x0") + (F.col(x) - F.col("_x0")) * (F.col("p") - F.col("_c0")) / (F.col("_c") - F.col("_c0"))
    q = F.when(F.col("_c0").isNull() | beyond, F.col(x)).otherwise(line)
    return df.where(inside | beyond).groupBy(*keys, "p").agg(F.max(q).alias("q"))


#: Equal-width bins that a key's values are folded to before they are resampled.
BOOTSTRAP_BINS = 256


def bootstrap_ci(df: DataFrame, keys: list[str], x: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42, bins: int = BOOTSTRAP_BINS) -> DataFrame:
    """Mean and percentile interval of the mean per key: mean, n, ci_low, ci_high.

    A key's values are folded to at most ``bins`` bins of equal width, each with its count,
    mean and variance: a summary of bounded size that partial aggregation merges. Each of
    ``resamples`` draws of n values is one multinomial draw of the bins' counts, with the bins'
    means and one normal draw of the variance inside them. So the mean and the variance
    of a resampled mean are those of the full bootstrap at any n; where a bin has one
    distinct value its law is too, else only the skew inside bins is lost. Nulls do not
    count; a key without values has n = 0 and the interval (0, 0), rows with a null key are left
    out. Draws depend on the
    key and the seed alone.
    """
    value = F.col(x).cast("double")
    ends = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    ends = ends.dropna(subset=keys) if keys else ends
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((value - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    near = df.where(value.isNotNull()).join(ends, keys) if keys else df.where(value.isNotNull()).join(F.broadcast(ends), how="cross")
    folded = near.groupBy(*keys, place.alias("_bin")).agg(F.count(F.lit(1)).alias("_k"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    if not keys:
        folded = folded.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    folded = folded.withColumn("_seed", F.xxhash64(*by, F.lit(seed)))
    schema = T.StructType([*[folded.schema[c] for c in by], T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())])

    def resample(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_bin")
        count, mean, spread = (part[c].to_numpy(float) for c in ("_k", "_m", "_v"))
        rng, n = np.random.default_rng(int(part["_seed"].iloc[0]) & (1 << 63) - 1), int(count.sum())
        drawn = rng.multinomial(n, count / count.sum(), size=resamples)
        means = (drawn @ mean + np.sqrt(drawn @ spread) * rng.standard_normal(resamples)) / n
        low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return part[by].head(1).assign(ci_low=low, ci_high=high)

    found = folded.groupBy(*by).applyInPandas(resample, schema)
    got = ends.select(*keys, "mean", "n").join(found, keys, "left") if keys else ends.select("mean", "n").join(found.drop("_all"), F.lit(True), "left")  # one row each
    return got.fillna(0.0, ["ci_low", "ci_high"])


def pair_runs(base: DataFrame, cand: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of two runs paired by their occurrence number within ``key``: key, occurrence, base, cand."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    left = base.select(key, number.alias("occurrence"), F.col("action").alias("base"))
    right = cand.select(key, number.alias("occurrence"), F.col("action").alias("cand"))
    return left.join(right, [key, "occurrence"])


def paired_deltas(pairs: DataFrame, q: DataFrame, key: str, eps: float = EPSILON) -> DataFrame:
    """Per key: mean of ln(q[cand] + eps) - ln(q[base] + eps) and its variance, n, hits (both actions known to q)."""
    side = lambda c: q.select(key, F.col("action").alias(c), F.col("p").alias(f"q_{c}"))
    both = pairs.join(side("base"), [key, "base"], "left").join(side("cand"), [key, "cand"], "left")
    delta = F.log(F.coalesce("q_cand", F.lit(0.0)) + eps) - F.log(F.coalesce("q_base", F.lit(0.0)) + eps)
    hit = F.col("q_base").isNotNull() & F.col("q_cand").isNotNull()
    got = both.groupBy(key).agg(F.avg(delta).alias("mean_delta"), (F.var_samp(delta) / F.count(F.lit(1))).alias("var_delta"), F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return got.withColumn("zero_hits", F.col("hits") == 0)


def with_verdict(df: DataFrame, mean: str = "mean", low: str = "ci_low", high: str = "ci_high", regression: Column | None = None) -> DataFrame:
    """bb_per_100 = mean x 100, and the verdict by the interval.

    won above 0; below 0 lost, or regression where ``regression`` holds (a match
    against an earlier version); else inconclusive.
    """
    down = F.lit("lost") if regression is None else F.when(regression, "regression").otherwise("lost")
    verdict = F.when(F.col(low) > 0, "won").when(F.col(high) < 0, down).otherwise("inconclusive")
    return df.withColumns({"bb_per_100": F.col(mean) * 100, "verdict": verdict})


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means of several columns, one row."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
