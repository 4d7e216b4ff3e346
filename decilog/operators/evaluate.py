"""Evaluation of encodings and corpora by their neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.operators import blend as B
from decilog.operators import knn as K
from decilog.operators.blend import uniform


def loo_eval(df: DataFrame, keys: list[str], k: int = 10, group: str | None = None, eps: float = 1e-6) -> DataFrame:
    """Leave-one-out: how much probability the other rows' blend gives to a row's own action.

    Partitions with fewer than k + 1 rows are skipped; ``coverage`` is the share of
    rows that are not. loss = mean of 1 - p, log_loss = mean of -ln(p + eps), fidelity
    = share of rows whose most likely action is their own.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    sized = df.withColumn("_n", n)
    used = sized.where(F.col("_n") >= k + 1).drop("_n")
    dist = B.blend(K.knn(used, used, keys, k), used)
    top = dist.groupBy("query").agg(F.max_by("action", F.struct("prob", "action")).alias("top"))
    own = used.select(F.col("id").alias("query"), "action", *([group] if group else []))
    scored = own.join(dist, ["query", "action"], "left").join(top, "query").fillna(0.0, ["prob"])
    by = [group] if group else []
    got = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(1 - F.col("prob")).alias("loss"), F.avg(-F.log(F.col("prob") + eps)).alias("log_loss"),
        F.avg((F.col("top") == F.col("action")).cast("double")).alias("fidelity"),
    )
    if group:
        return got
    return got.crossJoin(sized.agg(F.avg((F.col("_n") >= k + 1).cast("double")).alias("coverage")))


def same_action_at_k(df: DataFrame, keys: list[str], tag: str, k: int = 10) -> DataFrame:
    """Per tag: the mean share of a row's neighbours with its action."""
    nb = K.knn(df, df, keys, k)
    a = df.select(F.col("id").alias("query"), F.col("action").alias("own"), tag)
    b = df.select(F.col("id").alias("nb"), "action")
    hit = nb.join(a, "query").join(b, "nb").groupBy("query", tag).agg(F.avg((F.col("own") == F.col("action")).cast("double")).alias("share"))
    return hit.groupBy(tag).agg(F.count(F.lit(1)).alias("rows"), F.avg("share").alias("same_action"))


def enough(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``df`` with ``_used``: whether its partition has more than ``k`` rows."""
    return df.withColumn("_used", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > k)


def masked_loo(
    df: DataFrame, keys: list[str], legal: dict[bool, list[str]], passive: dict[bool, str], facing: str = "facing", pair: str = "pair", pair_sims: DataFrame | None = None, k: int = 10,
) -> DataFrame:
    """Leave-one-out with the actions that a row's state allows: one row.

    Neighbours vote with their similarity; votes for actions that are not ``legal`` for the
    query's ``facing`` do not count, and a query without a vote left takes the ``passive``
    one. loss = mean of 1 - p of the own action, log_loss = mean of -ln(max(p, 1e-12)); the
    same loss over the position-sensitive rows, whose action is not the most frequent of
    their partition (of equally frequent ones the last name is); fidelity = mean similarity
    of a row's ``pair`` to its neighbours' by ``pair_sims`` (a, b, sim; missing pairs are 0).
    Partitions of at most ``k`` rows are skipped; coverage is the share of rows that are not.
    """
    sized = enough(df, keys, k)
    used = sized.where("_used").drop("_used")
    near = K.knn(used, used, keys, k)
    allowed = lambda a: F.when(F.col(facing), a.isin(legal[True])).otherwise(a.isin(legal[False]))
    votes = near.select("query", "nb", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("w")).where("w > 0")
    votes = votes.join(used.select(F.col("id").alias("nb"), "action"), "nb").join(used.select(F.col("id").alias("query"), facing, F.col("action").alias("own")), "query").where(allowed(F.col("action")))
    got = votes.groupBy("query").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("action") == F.col("own"), F.col("w")).otherwise(0.0)).alias("hit"))
    modal = used.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max_by("action", F.struct("n", "action")).alias("modal"))
    default = F.when(F.col(facing), F.lit(passive[True])).otherwise(F.lit(passive[False]))
    p = F.when(F.col("total") > 0, F.col("hit") / F.col("total")).otherwise((F.col("action") == default).cast("double"))
    scored = used.withColumnRenamed("id", "query").join(got, "query", "left").join(modal, keys).withColumn("p", p)
    if pair_sims is not None:
        own, theirs = used.select(F.col("id").alias("query"), F.col(pair).alias("a")), used.select(F.col("id").alias("nb"), F.col(pair).alias("b"))
        close = near.join(own, "query").join(theirs, "nb").join(pair_sims, ["a", "b"], "left").groupBy("query").agg(F.avg(F.coalesce("sim", F.lit(0.0))).alias("fidelity"))
        scored = scored.join(close, "query", "left")
    else:
        scored = scored.withColumn("fidelity", F.lit(None).cast("double"))
    sensitive = F.col("action") != F.col("modal")
    whole = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(1 - F.col("p")).alias("loss"), F.avg(-F.log(F.greatest("p", F.lit(1e-12)))).alias("log_loss"),
        F.avg(F.when(sensitive, 1 - F.col("p"))).alias("sensitive_loss"), F.count_if(sensitive).alias("n_sensitive"), F.avg("fidelity").alias("fidelity"),
    )
    return whole.crossJoin(sized.agg(F.avg(F.col("_used").cast("double")).alias("coverage")))  # one row each


def archetypes(df: DataFrame, keys: list[str], tags: Column, pair: str, member: Column, k: int = 10) -> DataFrame:
    """Same-action share of the ``k`` neighbours by tag, and how pure the neighbourhoods are: part, name, n, mean.

    ``tags``: each row's array of tags; every row is also ``overall``, and ``sensitive`` if its action is
    not the most frequent of its partition. ``pool`` rows: exact_pair, the share of
    neighbours with the row's ``pair``; purity, over rows that are a ``member``, the share
    of neighbours that are. Partitions of at most ``k`` rows are skipped.
    """
    used = enough(df, keys, k).where("_used").drop("_used").withColumns({"_tags": tags, "_member": member})
    modal = used.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max_by("action", F.struct("n", "action")).alias("modal"))
    more = F.array_compact(F.array(F.lit("overall"), F.when(F.col("action") != F.col("modal"), "sensitive")))
    own = used.join(modal, keys).select(F.col("id").alias("query"), "action", F.col(pair).alias("_pair"), "_member", F.array_union("_tags", more).alias("_tags"))
    theirs = used.select(F.col("id").alias("nb"), F.col("action").alias("_a"), F.col(pair).alias("_p"), F.col("_member").alias("_m"))
    share = lambda test: F.avg(test.cast("double"))
    by = K.knn(used, used, keys, k).select("query", "nb").join(own.drop("_tags"), "query").join(theirs, "nb").groupBy("query", "_member").agg(
        share(F.col("_a") == F.col("action")).alias("same"), share(F.col("_p").eqNullSafe(F.col("_pair"))).alias("pair"), share(F.col("_m")).alias("pure"),
    )
    sliced = by.join(own.select("query", F.explode("_tags").alias("name")), "query").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("same").alias("mean")).select(F.lit("tag").alias("part"), "name", "n", "mean")
    pools = F.array(F.struct(F.lit("exact_pair").alias("name"), F.col("pair").alias("x")), F.struct(F.lit("purity").alias("name"), F.when(F.col("_member"), F.col("pure")).alias("x")))
    pooled = by.select(F.explode(pools).alias("s")).where("s.x IS NOT NULL").groupBy("s.name").agg(F.count(F.lit(1)).alias("n"), F.avg("s.x").alias("mean")).select(F.lit("pool").alias("part"), "name", "n", "mean")
    return sliced.unionByName(pooled)


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with its array columns z-scored, each dimension by its mean and standard deviation over all rows."""
    from decilog.operators import stats as S

    for c in columns:
        df = S.normalise(df, c, S.manifest(S.fit_zscore(df, c)), out=c)
    return df


def weight_sweep(df: DataFrame, keys: list[str], variants: dict[str, Column], weights: list[float], k: int = 10, zscore: bool = False) -> DataFrame:
    """Leave-one-out for every variant (arrays appended to the vector) at every weight: variant, weight, rows, loss, log_loss, fidelity.

    One neighbour search serves all settings (see :func:`knn_sweep`). ``zscore``: the vector
    and each block are scaled first, by one fit whatever the weights. The k-th neighbour's
    blend counts as in :func:`loo_eval`.
    """
    wide = df.withColumns({f"_b_{name}": F.transform(block, lambda x: x.cast("double")) for name, block in variants.items()})
    if zscore:
        wide = scaled(wide, ["vec", *[f"_b_{name}" for name in variants]])
    settings = [(name, float(w)) for name in variants for w in weights]
    searched = list(dict.fromkeys(s if s[1] else (next(iter(variants)), 0.0) for s in settings))  # without a weight all variants are alike
    used = wide.join(wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k), keys, "left_semi")
    near = K.knn_sweep(used, keys, {name: [f"_b_{name}"] for name in variants}, searched, k)
    dist = B.blend(near.select(F.struct("setting", "query").alias("query"), "nb", "distance"), used)
    own = used.select(F.col("id").alias("_id"), F.col("action").alias("own"))
    hit = dist.join(own, F.col("query.query") == F.col("_id")).groupBy("query", "own").agg(
        F.coalesce(F.max(F.when(F.col("action") == F.col("own"), F.col("prob"))), F.lit(0.0)).alias("prob"), F.max_by("action", F.struct("prob", "action")).alias("top"),
    )
    got = hit.groupBy(F.col("query.setting").alias("setting")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(1 - F.col("prob")).alias("loss"), F.avg(-F.log(F.col("prob") + 1e-6)).alias("log_loss"), F.avg((F.col("top") == F.col("own")).cast("double")).alias("fidelity"),
    )
    alike = lambda s, t: s == t or s[1] == t[1] == 0
    named = F.array(*[F.array(*[F.struct(F.lit(name).alias("variant"), F.lit(w).alias("weight")) for name, w in settings if alike(s, (name, w))]) for s in searched])
    return got.withColumn("_s", F.explode(named[F.col("setting")])).select("_s.variant", "_s.weight", "rows", "loss", "log_loss", "fidelity")


def compare_variants(results: DataFrame, baseline: str, tolerance: float = 1e-3) -> DataFrame:
    """Each variant's loss and fidelity against the baseline's, with a verdict. One baseline row."""
    base = results.where(F.col("variant") == baseline).agg(F.min("loss").alias("_l"), F.max("fidelity").alias("_f"))
    df = results.crossJoin(F.broadcast(base)).withColumns({"d_loss": F.col("loss") - F.col("_l"), "d_fidelity": F.col("fidelity") - F.col("_f")})
    verdict = F.when(F.col("d_loss") < -tolerance, "better").when(F.col("d_loss") > tolerance, "worse").otherwise("same")
    return df.withColumn("verdict", verdict).drop("_l", "_f")


def knn_jaccard(df: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Jaccard of each row's neighbours with those of its nearest neighbour: query, jaccard."""
    nb = K.knn(df, df, keys, k)
    sets = nb.groupBy("query").agg(F.collect_set("nb").alias("s"))  # at most k ids
    first = nb.where("rank = 1").select("query", F.col("nb").alias("near"))
    other = sets.select(F.col("query").alias("near"), F.col("s").alias("t"))
    both = first.join(sets, "query").join(other, "near")
    return both.select("query", (F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("jaccard"))


def precision_vs_bucket(df: DataFrame, keys: list[str], bucket: str, k: int = 10, seed: int = 1) -> DataFrame:
    """Share of neighbours with the query's action, against ``k`` rows drawn from its bucket by hash order. One row."""
    own = df.select(F.col("id").alias("query"), F.col("action").alias("own"), F.col(bucket).alias("_b"))
    nb = K.knn(df, df, keys, k).select("query", "nb")
    order = F.row_number().over(Window.partitionBy("_b").orderBy(uniform(F.col("nb"), seed), "nb"))
    drawn = df.select(F.col("id").alias("nb"), F.col(bucket).alias("_b")).withColumn("_r", order).where(F.col("_r") <= k + 1)
    drawn = own.join(drawn, "_b").where("query <> nb").withColumn("_p", F.row_number().over(Window.partitionBy("query").orderBy("_r"))).where(F.col("_p") <= k)
    action = df.select(F.col("id").alias("nb"), "action")
    rate = lambda pairs, name: pairs.join(own.select("query", "own"), "query").join(action, "nb").agg(F.avg((F.col("own") == F.col("action")).cast("double")).alias(name))
    return rate(nb, "knn").crossJoin(rate(drawn.select("query", "nb"), "bucket"))


def separation(df: DataFrame, vec: str, group: str) -> DataFrame:
    """Mean cosine of two rows of one group, and of two rows of different groups, from sums of unit vectors.

    No pairs are made: the sum over pairs of a group is (|s|^2 - n) / 2 with s its sum of
    unit vectors. One row: intra, inter, margin.
    """
    v = F.transform(vec, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    long = df.select(group, F.posexplode(F.transform(v, lambda x: x / length)).alias("dim", "x"))
    by = long.groupBy(group, "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    groups = by.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    whole = by.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("all_ss"), F.max("n").alias("all_n"))
    inside = groups.agg(F.sum(F.col("ss") - F.col("n")).alias("in_sum"), F.sum(F.col("n") * (F.col("n") - 1)).alias("in_pairs"), F.sum("ss").alias("group_ss"), F.sum(F.col("n") * F.col("n")).alias("group_nn"))
    both = inside.crossJoin(whole)
    intra = F.col("in_sum") / F.col("in_pairs")
    inter = (F.col("all_ss") - F.col("group_ss")) / (F.col("all_n") * F.col("all_n") - F.col("group_nn"))
    return both.select(intra.alias("intra"), inter.alias("inter"), (intra - inter).alias("margin"))


def l2(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def rank_order(triplets: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of triplets whose twin is nearer to the anchor than a stranger is. One row."""
    near = l2("anchor", "twin") < l2("anchor", "stranger")
    return triplets.agg(F.count(F.lit(1)).alias("n"), F.avg(near.cast("double")).alias("share")).withColumn("passed", F.col("share") >= least)


def seeded_folds(df: DataFrame, id_col: str, folds: int, seed: int) -> DataFrame:
    """``df`` with a fold that depends on the id and the seed alone."""
    return df.withColumn("fold", F.floor(uniform(F.col(id_col), seed) * folds).cast("long"))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by hash order."""
    return df.orderBy(uniform(F.col(id_col), seed), id_col).limit(n)


def out_of_fold_rates(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Each fold's rate of ``flag`` per key over the other folds: key, fold, n, rate."""
    by = df.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(flag.cast("long")).alias("s"))
    w = Window.partitionBy(key)
    n, s = F.sum("n").over(w) - F.col("n"), F.sum("s").over(w) - F.col("s")
    return by.select(key, "fold", n.alias("n"), F.when(n > 0, s / n).alias("rate"))


def sigma_separation(df: DataFrame, vec: str, group: str, id_col: str = "id", sample: int = 60, seed: int = 3) -> DataFrame:
    """Distances within and between groups over a bounded sample; separated if their means differ by over 2 sigma. One row."""
    some = seeded_sample(df, id_col, sample, seed).select(F.col(id_col).alias("a"), F.col(vec).alias("va"), F.col(group).alias("ga"))
    other = some.select(F.col("a").alias("b"), F.col("va").alias("vb"), F.col("ga").alias("gb"))
    pairs = some.join(F.broadcast(other), F.col("a") < F.col("b")).select((F.col("ga") == F.col("gb")).alias("same"), l2("va", "vb").alias("x"))
    side = lambda same, f: f(F.when(F.col("same") == same, F.col("x")))
    got = pairs.agg(side(True, F.avg).alias("m_in"), side(False, F.avg).alias("m_out"), side(True, F.stddev_pop).alias("s_in"), side(False, F.stddev_pop).alias("s_out"))
    return got.withColumn("separated", F.col("m_out") - F.col("m_in") > 2 * F.sqrt(F.col("s_in") * F.col("s_in") + F.col("s_out") * F.col("s_out")))


def newest_spots(obs: DataFrame, by: list[str], keys: list[str], more: list[str], least: int) -> DataFrame:
    """One row for each group of ``by`` with at least ``least`` observations: id (``by`` joined), vec, keys and more of the newest, n."""
    kept = [c for c in dict.fromkeys(["vec", *keys, *more]) if c not in by]
    newest = obs.groupBy(*by).agg(F.max_by(F.struct(*kept), F.struct("ts", "id")).alias("_s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return newest.select(*by, F.concat_ws("|", F.lit("spot"), *by).alias("id"), "_s.*", "n")


def ev_loss(obs: DataFrame, corpus: DataFrame, by: list[str], keys: list[str], k: int = 10, min_obs: int = 10, valid: tuple[str, str, str] | None = None, eps: float = 1e-6) -> DataFrame:
    """KL divergence of what is done from what neighbours would do, for each group of ``by``: by, n, ev_loss.

    obs: by, id, ts, vec, action and the keys; ``valid``: the column of obs with the time whose
    corpus counts (such as the session's start), and the corpus's columns added and
    removed, so that all sessions go through one search, each against the corpus of its
    time. Groups of fewer than ``min_obs`` observations, and those whose newest one has no
    neighbour with a vote, are left out.
    """
    from decilog.operators import stats as S

    spots = newest_spots(obs, by, keys, list(valid or [])[:1], min_obs)
    held = corpus.withColumn("id", F.col("id").cast("string"))
    dist = B.blend(K.knn(spots, held, keys, k, valid=valid), held).select(F.col("query").alias("id"), "action", F.col("prob").alias("p"))
    names = spots.select("id", *by, "n")
    freq = S.action_freq(obs.join(names.select(*by), by, "left_semi"), by).join(names, by).select("id", "action", "p")
    return S.kl(freq, dist, ["id"], eps=eps).join(names, "id").select(*by, "n", F.col("kl").alias("ev_loss"))


def loo_gate(
    spots: DataFrame, corpus: DataFrame, targets: DataFrame, visits: DataFrame, keys: list[str], own: list[str], runs: DataFrame | None = None,
    k: int = 10, floor: float = 0.15, delta: float = 0.05, least: int = 5,
) -> DataFrame:
    """Leave-one-cluster-out: can the other clusters' rows rebuild each cluster's solved distribution? One row.

    spots: id (the cluster), vec, keys and the columns ``own`` that make the cluster; corpus
    rows with the same ``own`` are no neighbours. targets: id, action, p. visits: id, n.
    runs: at, tvd of the runs before. Clusters without a target, a visit or a neighbour
    with a vote are left out. tvd and top1 are weighted by visits; passed if at least
    ``least`` clusters count, tvd is under ``floor`` and not over the newest run's by more
    than ``delta``.
    """
    from decilog.operators import stats as S

    asked = spots.join(targets.select("id").distinct(), "id", "left_semi").join(visits.where("n > 0").select("id"), "id", "left_semi")
    held = corpus.withColumn("id", F.concat_ws("|", F.lit("row"), F.col("id").cast("string")))
    dist = B.blend(K.knn(asked, held, keys, k, apart=own), held).select(F.col("query").alias("id"), "action", F.col("prob").alias("p"))
    gap = S.tvd(dist, targets.select("id", "action", "p"), ["id"])
    best = lambda df, name: df.groupBy("id").agg(F.max_by("action", F.struct("p", "action")).alias(name))
    both = gap.join(best(dist, "x"), "id").join(best(targets, "y"), "id").join(visits.groupBy("id").agg(F.sum("n").alias("w")), "id")
    w = F.sum("w")
    got = both.agg(F.coalesce(F.sum(F.col("tvd") * F.col("w")) / w, F.lit(0.0)).alias("tvd"), F.coalesce(F.sum((F.col("x") == F.col("y")).cast("double") * F.col("w")) / w, F.lit(0.0)).alias("top1"), F.count(F.lit(1)).alias("clusters"))
    last = runs.agg(F.max_by("tvd", "at").alias("last_tvd")) if runs is not None else corpus.limit(0).agg(F.max(F.lit(None).cast("double")).alias("last_tvd"))
    got = got.crossJoin(last).withColumns({"coverage_ok": F.col("clusters") >= least, "regression": F.coalesce(F.col("tvd") - F.col("last_tvd"), F.lit(0.0))})  # one row each
    return got.withColumn("passed", F.col("coverage_ok") & (F.col("tvd") < floor) & (F.col("regression") <= delta))
