"""State tables as copy-on-write DataFrames: patches, rollback, locks, suppressions, versions, gaps.

Every operation takes tables and a table of requests and returns the new tables; rows
that cannot be served come back with a reason instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decilog.functions import predicates as P
from decilog.operators import blend as B
from decilog.operators import stats as S
from decilog.operators.rank import coverage_gaps


def upsert_latest(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: of the new rows the last by ``order``, else the base row."""
    both = base.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc(order)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_side")


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``base`` and the new rows whose key it lacks; nulls in keys are equal. Of equal new keys the first by ``order``."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
    b, n = base.alias("b"), first.alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}"))
    return base.unionByName(n.join(b, same, "left_anti").select("n.*"))


def replace_slice(base: DataFrame, new: DataFrame, in_slice: Column) -> DataFrame:
    """The base rows outside the slice, and the new rows inside it."""
    return base.where(~F.coalesce(in_slice, F.lit(False))).unionByName(new.where(in_slice))


def apply_retention(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def apply_patches(corpus: DataFrame, requests: DataFrame, now: int, quality: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, nodes and audit rows after patches.

    corpus: id, vec, action, confidence, added_at, removed_at, active, and ``dist`` where it has
    distributions. requests: patch_id, id, cluster_key, vec, dist (action -> probability).
    A later patch of an id replaces its row; the row keeps its distribution, which blends
    split it by, and its action is the likeliest (ties: the first name).
    """
    best = F.array_sort(F.transform(F.map_entries("dist"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))[0]["k"]
    rows = requests.select(
        "id", "vec", best.alias("action"), F.lit(quality).alias("confidence"), F.lit(now).cast("long").alias("added_at"), F.lit(0).cast("long").alias("removed_at"), F.lit(True).alias("active"), "dist", F.col("patch_id").alias("_order"),
    )
    held = F.col("dist") if "dist" in corpus.columns else F.lit(None).cast(requests.schema["dist"].dataType)
    base = corpus.select("id", "vec", "action", "confidence", "added_at", "removed_at", "active", held.alias("dist"), F.lit(None).cast(requests.schema["patch_id"].dataType).alias("_order"))
    merged = upsert_latest(base, rows, ["id"], "_order").drop("_order")
    nodes = requests.select(F.concat(F.lit("p"), F.col("patch_id").cast("string")).alias("node_id"), "cluster_key", "dist", F.lit(True).alias("active"), F.lit(now).cast("long").alias("created_at"))
    audit = requests.select("patch_id", "cluster_key", "id", F.lit("applied").alias("status"), F.lit(now).cast("long").alias("ts"))
    return merged, nodes, audit


def rollback(patches: DataFrame, nodes: DataFrame, corpus: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Patches, nodes and corpus after taking patches back, and the rejected requests with a reason."""
    asked = requests.select("patch_id").distinct().join(patches.select("patch_id", "status", "new_node_id", "id"), "patch_id", "left")
    reason = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "rolled_back", "already rolled back")
    rejected = asked.withColumn("reason", reason).where("reason IS NOT NULL").select("patch_id", "reason")
    good = asked.where(F.col("status") == "applied")
    hit = good.select("patch_id").withColumn("_hit", F.lit(True))
    patches = patches.join(hit, "patch_id", "left").withColumn("status", F.when(F.col("_hit"), "rolled_back").otherwise(F.col("status"))).drop("_hit")
    off = good.select(F.col("new_node_id").alias("node_id")).distinct().withColumn("_hit", F.lit(True))
    nodes = nodes.join(off, "node_id", "left").withColumn("active", F.col("active") & F.col("_hit").isNull()).drop("_hit")
    gone = good.select("id").distinct().withColumn("_hit", F.lit(True))
    corpus = corpus.join(gone, "id", "left").withColumns({"active": F.col("active") & F.col("_hit").isNull(), "removed_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("removed_at"))}).drop("_hit")
    return patches, nodes, corpus, rejected


def set_lock(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Locks of active nodes set as asked (cluster_key, lock); the last request of a cluster counts by its number ``k``."""
    want = requests.groupBy("cluster_key").agg(F.max_by("lock", "k").alias("_lock"))
    return nodes.join(want, "cluster_key", "left").withColumn("locked", F.when(F.col("active") & F.col("_lock").isNotNull(), F.col("_lock")).otherwise(F.col("locked"))).drop("_lock")


def is_suppressed(clusters: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Clusters with whether an active suppression covers them."""
    hit = suppressions.where("active").select("cluster_key").distinct().withColumn("suppressed", F.lit(True))
    return clusters.join(hit, "cluster_key", "left").fillna(False, ["suppressed"])


def unsuppress(suppressions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Suppressions with those of the named clusters made inactive."""
    hit = clusters.select("cluster_key").distinct().withColumn("_hit", F.lit(True))
    return suppressions.join(hit, "cluster_key", "left").withColumn("active", F.col("active") & F.col("_hit").isNull()).drop("_hit")


def snapshot(versions: DataFrame, cutoff: int, source: str, label: str) -> DataFrame:
    """Versions with one more: the next number, its cutoff, source and label."""
    new = versions.agg((F.coalesce(F.max("version"), F.lit(-1)) + 1).alias("version"), F.lit(cutoff).cast("long").alias("cutoff_ts"), F.lit(source).alias("source"), F.lit(label).alias("label"))
    return versions.unionByName(new)


def resolve(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """Cutoffs of the asked versions; ``known`` is false for numbers that do not exist."""
    return asked.join(versions.select("version", "cutoff_ts"), "version", "left").withColumn("known", F.col("cutoff_ts").isNotNull())


def present_at(t: int) -> Column:
    return (F.col("added_at") <= t) & ((F.col("removed_at") == 0) | (F.col("removed_at") > t))


def version_diff(corpus: DataFrame, t_old: int, t_new: int) -> DataFrame:
    """Ids that came or went between two times: id, change."""
    old, new = F.coalesce(present_at(t_old), F.lit(False)), F.coalesce(present_at(t_new), F.lit(False))
    return corpus.withColumn("change", F.when(~old & new, "added").when(old & ~new, "removed")).where("change IS NOT NULL").select("id", "change")


def gap_queue(obs: DataFrame, resolved: DataFrame, multiway: Column | None = None, limit: int = 50) -> DataFrame:
    """Sparse, unresolved rows, one per decision, by distance; filters come before the limit."""
    df = obs.where("decision_id IS NOT NULL").join(resolved.select("decision_id").distinct(), "decision_id", "left_anti")
    if multiway is not None:
        df = df.where(~multiway)
    first = F.row_number().over(Window.partitionBy("decision_id").orderBy(F.desc_nulls_last("distance"), "obs_id"))
    return coverage_gaps(df.withColumn("_r", first).where("_r = 1").drop("_r"), limit=limit)


def requeue(markers: DataFrame, requests: DataFrame, multiway: Column) -> tuple[DataFrame, DataFrame]:
    """Human markers without the requested ones, and the rejected (multiway) requests."""
    rejected = requests.where(multiway)
    return markers.join(requests.where(~multiway).select("decision_id"), "decision_id", "left_anti"), rejected


def spot_items(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """Every work item of every spot as a row: key, place (from 1, by item), item."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last(item)))
    return rows.select(*key, place.cast("long").alias("place"), F.col(item).alias("item"))


def group_spots(rows: DataFrame, key: list[str], item: str, size: int = 1000) -> DataFrame:
    """Work items by spot in chunks that together hold all of them: key, n (of the spot), chunk (from 0), items in order.

    A chunk has at most ``size`` items; null items are counted and not listed.
    """
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    of = F.floor((F.col("place") - 1) / size)
    chunks = spot_items(rows, key, item).withColumn("chunk", of).groupBy(*key, "chunk").agg(F.array_sort(F.collect_list("item")).alias("items"))
    c, n = chunks.alias("c"), counts.alias("n")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
    return c.join(n, same).select(*[f"c.{k}" for k in key], "n.n", "c.chunk", "c.items")


def accept(candidates: DataFrame) -> DataFrame:
    """Candidates whose runs hit known actions and whose interval is over 0."""
    return candidates.where(~F.col("zero_hits") & (F.col("ci_low") > 0))


def pause_flags(trend: DataFrame, x: str, order: str, floor: float = 0.15, jump: float = 0.15) -> DataFrame:
    """Runs to pause at: over twice the floor, or up by more than ``jump`` on the run before."""
    up = F.col(x) - F.lag(x).over(Window.orderBy(order))
    return trend.withColumn("pause", (F.col(x) > 2 * floor) | F.coalesce(up > jump, F.lit(False)))


def backlog(obs: DataFrame, solved: DataFrame) -> DataFrame:
    """Number of sparse rows whose cluster is not solved. One row."""
    return obs.where("sparse").join(solved.select("cluster_key").distinct(), "cluster_key", "left_anti").agg(F.count(F.lit(1)).alias("backlog"))


def manual_edits(requests: DataFrame, nodes: DataFrame, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of clusters with an active node and an observation, and the rest with a reason."""
    has = lambda df, name: df.select("cluster_key").distinct().withColumn(name, F.lit(True))
    df = requests.join(has(nodes.where("active"), "_node"), "cluster_key", "left").join(has(obs, "_obs"), "cluster_key", "left")
    df = df.withColumn("reason", F.when(F.col("_node").isNull(), "no active node").when(F.col("_obs").isNull(), "no observation")).drop("_node", "_obs")
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")


def patch_ab_input(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Patches with whether they can be replayed: the node exists and belongs to the patch's cluster."""
    n = nodes.select(F.col("node_id").alias("new_node_id"), F.col("cluster_key").alias("_c"))
    df = patches.join(n, "new_node_id", "left")
    return df.withColumn("check", F.when(F.col("_c").isNull(), "no node").when(F.col("_c") != F.col("cluster_key"), "other cluster").otherwise("ok")).drop("_c")


def resolve_gaps(requests: DataFrame, obs: DataFrame, corpus: DataFrame, manifest_row: DataFrame, vocabulary: list[str], now: int, quality: float = 0.911) -> dict[str, DataFrame]:
    """Human answers to coverage gaps, as tables to write.

    requests: patch_id, decision_id, dist; obs: decision_id, cluster_key, vec, sparse.
    ``corpus``, ``nodes`` and ``audit`` are those of :func:`apply_patches`; ``obs`` has the
    answered rows' flags cleared, ``markers`` names the answered decisions, and ``rejected``
    has the other requests with a reason. Vectors are normalised by the fit; one of
    another size than the fit's gives a node, but no row of the corpus.
    """
    errors = F.array_join(P.dist_errors(F.col("dist"), vocabulary), ",")
    asked = requests.join(obs.select("decision_id", "cluster_key", "vec"), "decision_id", "left").withColumn("_e", errors)
    asked = asked.withColumn("reason", F.when(F.col("_e") != "", F.col("_e")).when(F.col("cluster_key").isNull(), "no observation")).drop("_e")
    good = asked.where("reason IS NULL").drop("reason").join(F.broadcast(manifest_row.select(F.size("means").alias("_d"))), how="cross")
    fits = S.normalise(good.where(F.size("vec") == F.col("_d")), "vec", manifest_row).withColumn("vec", F.col("z").cast("array<float>"))
    rows = fits.select("patch_id", F.col("decision_id").alias("id"), "cluster_key", "vec", "dist")
    merged, _, _ = apply_patches(corpus, rows, now, quality)
    every = good.select("patch_id", F.col("decision_id").alias("id"), "cluster_key", "vec", "dist")
    _, nodes, audit = apply_patches(corpus.limit(0), every, now, quality)
    markers = good.select("decision_id").distinct()
    cleared = obs.join(markers.withColumn("_hit", F.lit(True)), "decision_id", "left").withColumn("sparse", F.col("sparse") & F.col("_hit").isNull()).drop("_hit")
    return {"corpus": merged, "nodes": nodes, "audit": audit, "obs": cleared, "markers": markers, "rejected": asked.where("reason IS NOT NULL").select("patch_id", "decision_id", "reason")}


def improve_cycle(candidates: DataFrame, blends: DataFrame, deltas: DataFrame, vectors: DataFrame, corpus: DataFrame, versions: DataFrame, now: int, label: str) -> dict[str, DataFrame]:
    """One improvement cycle over all clusters, as tables to write.

    candidates: cluster_key; blends: cluster_key, action, prob; deltas: cluster_key,
    mean_delta, ci_low, zero_hits; vectors: cluster_key, id, vec (the representative).
    Candidates with a blend and a gain whose interval is over 0 become patches of source
    autoloop with middling quality. A version is added only if one was applied.
    """
    good = accept(candidates.select("cluster_key").distinct().join(deltas, "cluster_key")).select("cluster_key", "mean_delta", "ci_low")
    dist = blends.groupBy("cluster_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "prob")))).alias("dist"))  # a cluster's few actions
    patches = good.join(dist, "cluster_key").join(vectors, "cluster_key").withColumn("patch_id", F.xxhash64("cluster_key", F.lit(now)))
    merged, nodes, audit = apply_patches(corpus, patches, now, 0.5)
    some = patches.agg(F.count(F.lit(1)).alias("_n"))  # one row
    new = snapshot(versions, now, "autoloop", label).join(versions.select("version"), "version", "left_anti").join(F.broadcast(some), how="cross").where("_n > 0").drop("_n")
    return {"patches": patches.withColumn("source", F.lit("autoloop")), "corpus": merged, "nodes": nodes, "audit": audit, "versions": versions.unionByName(new)}


def probe(clusters: DataFrame, nodes: DataFrame, charts: DataFrame, spots: DataFrame, chart_keys: list[str], neighbours: DataFrame, blended: DataFrame, solved: DataFrame, legal: Column | None = None) -> DataFrame:
    """What answers each cluster, and how far it is from the solver.

    clusters: cluster_key; nodes: cluster_key, dist (newest active); spots: cluster_key
    and the chart keys, for clusters that a chart may cover; charts: keys, action, freq;
    neighbours: query, nb, distance; blended: query, action, prob; solved: cluster_key,
    dist. A node answers first, then the chart, then the blend (its legal actions alone,
    with ``legal`` an array column of ``clusters``). Result: cluster_key, source (node,
    chart, knn or none), dist, n_neighbours, max_distance, neighbours, kl (from the answer to
    the solver, both floored).
    """
    as_map = lambda df, key: df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "prob")))).alias("dist"))
    chart = as_map(B.decide(spots, charts, chart_keys, blended.limit(0), "cluster_key"), "cluster_key").withColumnRenamed("dist", "_chart")
    voted = as_map(blended.withColumnRenamed("query", "cluster_key"), "cluster_key").withColumnRenamed("dist", "_blend")
    near = neighbours.groupBy(F.col("query").alias("cluster_key")).agg(F.count(F.lit(1)).alias("n_neighbours"), F.max("distance").alias("max_distance"), F.array_sort(F.collect_list(F.struct("distance", "nb"))).alias("neighbours"))  # k a cluster
    df = clusters.join(nodes.select("cluster_key", F.col("dist").alias("_node")), "cluster_key", "left").join(chart, "cluster_key", "left").join(voted, "cluster_key", "left").join(near, "cluster_key", "left")
    blend = F.col("_blend") if legal is None else F.when(F.col("_blend").isNotNull(), P.filter_legal(F.col("_blend"), legal, F.lit("check")))
    df = df.withColumns({"dist": F.coalesce("_node", "_chart", blend), "source": F.when(F.col("_node").isNotNull(), "node").when(F.col("_chart").isNotNull(), "chart").when(F.col("_blend").isNotNull(), "knn").otherwise("none")})
    df = df.join(solved.select("cluster_key", F.col("dist").alias("_solver")), "cluster_key", "left")
    least = lambda m, k: F.greatest(F.coalesce(F.try_element_at(m, k), F.lit(0.0)), F.lit(S.EPSILON))
    names = F.array_union(F.map_keys("dist"), F.map_keys("_solver"))
    kl = F.aggregate(names, F.lit(0.0), lambda s, k: s + least(F.col("dist"), k) * F.log(least(F.col("dist"), k) / least(F.col("_solver"), k)))
    return df.select("cluster_key", "source", "dist", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), "max_distance", "neighbours", F.when(F.col("_solver").isNotNull(), kl).alias("kl"))
