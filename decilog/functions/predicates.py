"""Boolean column expressions for filters and join conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decilog.operators.stats import all_of


def same_partition(left: str, right: str, keys: list[str]) -> Column:
    """Equality on all hard-filter keys of two aliased sides."""
    return all_of([F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def not_same_cluster(left: str, right: str, keys: list[str]) -> Column:
    """Not all hard-filter keys equal; unknown equality counts as different."""
    return ~F.coalesce(same_partition(left, right, keys), F.lit(False))


def is_live(active: Column) -> Column:
    return F.coalesce(active, F.lit(False))


def as_of(added: Column, removed: Column, t: Column) -> Column:
    """Present at ``t``: added by then, and not removed by then (0: never)."""
    return (added <= t) & ((removed == 0) | (removed > t))


def in_spr_band(q: Column, x: Column) -> Column:
    """``x`` within [max(0, floor(0.5 q)), floor(1.5 q)]; any ``x`` if ``q`` is -1."""
    return (q == -1) | x.between(F.greatest(F.lit(0), F.floor(q * 0.5)), F.floor(q * 1.5))


def since(ts: Column, as_of_ts: Column, days: int) -> Column:
    """Later than ``days`` before ``as_of_ts``."""
    return ts > as_of_ts - F.make_dt_interval(F.lit(days))


def is_multiway(n_opponents: Column) -> Column:
    return n_opponents + 1 >= 3


def dist_errors(dist: Column, vocabulary: list[str], tolerance: float = 1e-4) -> Column:
    """What is wrong with a map action -> probability: unknown, negative, sum; an empty array if nothing."""
    known = F.array(*map(F.lit, vocabulary))
    total = F.aggregate(F.map_values(dist), F.lit(0.0), lambda a, x: a + x)
    return F.filter(
        F.array(
            F.when(F.exists(F.map_keys(dist), lambda k: ~F.array_contains(known, k)), "unknown"),
            F.when(F.exists(F.map_values(dist), lambda v: v < 0), "negative"),
            F.when(F.abs(total - 1) > tolerance, "sum"),
        ),
        lambda e: e.isNotNull(),
    )


def filter_legal(dist: Column, legal: Column, passive: Column) -> Column:
    """The legal part of a distribution, renormalised; all of it on ``passive`` if none is left."""
    kept = F.map_filter(dist, lambda k, v: F.array_contains(legal, k) & (v > 0))
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform_values(kept, lambda k, v: v / total)).otherwise(F.create_map(passive, F.lit(1.0)))
