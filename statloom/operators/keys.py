"""Joins on keys that may be null, and statistics joined back to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import cut


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join in which null keys match each other; keys appear once, right columns follow.

    No hint is given: the size of the right side decides between broadcast and sort-merge, and a hot
    key of a sort-merge join is split at run time. A right side that was written with session.cut has
    a known size, so a small one is broadcast without a shuffle of the left side.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], once: bool = False, **aggregates: Column) -> DataFrame:
    """Adds group aggregates to every row: partial aggregation first, then a join back.

    An aggregate over a window would bring a whole group into one task. The statistics are written first, so their
    size is known and rows do not move to meet a few of them. once: df is itself an aggregate or otherwise smaller than what it is made from;
    it is then written instead, and made once for both sides of the join.
    """
    if once:
        df = cut(df, "group-rows")
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return lookup(df, stats if once else cut(stats, "group-stats"), keys)


def with_table_stats(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds whole-table aggregates to every row through a one-row scalar subquery."""
    one = df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("s"))
    out = df.withColumn("__s", one.scalar())
    return out.withColumns({n: F.col("__s")[n] for n in aggregates}).drop("__s")


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under a total order.

    The row_number filter is applied before the shuffle too, so each task sends one row per key.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key with their 1-based rank; tasks send at most n rows per key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
