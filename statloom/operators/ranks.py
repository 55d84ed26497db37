"""Ranks, percentiles and exact quantiles within pools of any size.

Equal values are counted first, so a value shared by many rows is one row in what follows. The
counts are dealt by ranges of (pool, value) and written once (operators.segments); a value's place in its part and the sums of
earlier parts give its place in the pool. No task ever holds a whole pool, and the plan is the same for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import as_col
from statloom.functions.numeric import round_half_even
from statloom.operators.keys import lookup
from statloom.operators.segments import PART, add_earlier_parts, deal, row_index
from statloom.session import cut


def value_counts(df: DataFrame, value: str, pool: list[str]) -> DataFrame:
    """(pool, value, n_ties, part) of the values that are not null or NaN, written once in ranges of pool and value."""
    present = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        present = present & ~F.isnan(value)
    return deal(df.filter(present).groupBy(*pool, value).agg(F.count(F.lit(1)).alias("n_ties")), pool, [value], "value-counts")


def place_counts(counts: DataFrame, value: str, pool: list[str]) -> DataFrame:
    """(pool, value, n_ties, n_below, n_pool) from counted values."""
    part = Window.partitionBy(*pool, PART)
    before = part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumns({
        "__vp_b": F.coalesce(F.sum("n_ties").over(before), F.lit(0)),
        "__vp_n": F.sum("n_ties").over(part),
    })
    placed = add_earlier_parts(local, counts, pool, __vp_e=F.sum("n_ties"))
    return placed.select(
        *pool,
        value,
        "n_ties",
        (F.col("__vp_b") + F.coalesce("__vp_e", F.lit(0))).alias("n_below"),
        F.coalesce("__vp_e_all", "__vp_n").alias("n_pool"),
    )


def value_positions(df: DataFrame, value: str, pool: list[str]) -> DataFrame:
    """(pool, value, n_ties, n_below, n_pool) for every distinct value that is not null or NaN."""
    return place_counts(value_counts(df, value, pool), value, pool)


def with_positions(df: DataFrame, value: str, pool: list[str], size: str | None = None) -> DataFrame:
    """Rows with n_ties, n_below and n_pool of their value, null where the value is missing; and, if named,
    the number of values in the pool on every row."""
    counts = value_counts(df, value, pool)
    out = lookup(df, place_counts(counts, value, pool), [*pool, value])
    if size:
        sizes = cut(counts.groupBy(*pool).agg(F.sum("n_ties").alias(size)), "pool-sizes")
        out = lookup(out, sizes, pool).withColumn(size, F.coalesce(size, F.lit(0)))
    return out


def strict_percentile(lower_better: bool | Column = False) -> Column:
    """Share of the pool strictly below, 0-100, one decimal; turned round when lower is better."""
    p = F.col("n_below") / F.col("n_pool") * 100
    if isinstance(lower_better, Column):
        p = F.when(lower_better, F.lit(100) - p).otherwise(p)
    elif lower_better:
        p = F.lit(100) - p
    return round_half_even(p, 1)


def average_rank() -> Column:
    """1-based rank in which ties share their mean rank."""
    return F.col("n_below") + (F.col("n_ties") + 1) / 2


def average_tie_share() -> Column:
    """(mean rank - 1) / (n - 1); 0 for a pool of one."""
    n = F.col("n_pool")
    return F.when(n > 1, (average_rank() - 1) / (n - 1)).when(n == 1, 0.0)


def add_strict_percentile(df: DataFrame, value: str, pool: list[str], out: str = "pctile",
                          lower_better: bool | Column = False) -> DataFrame:
    ranked = with_positions(df, value, pool)
    return ranked.withColumn(out, strict_percentile(lower_better)).drop("n_ties", "n_below", "n_pool")


def add_percentile_rank(df: DataFrame, value: str, pool: list[str], out: str = "pct_rank") -> DataFrame:
    """Mean-rank percentile in [0, 1]. A pool with at most one value scores 0 on every row, missing ones too."""
    ranked = with_positions(df, value, pool, size="__lb_size").withColumn(out, average_tie_share())
    return ranked.withColumn(out, F.when(F.col("__lb_size") <= 1, 0.0).otherwise(F.col(out))).drop(
        "n_ties", "n_below", "n_pool", "__lb_size"
    )


def percentile_ranks_wide(df: DataFrame, id_cols: list[str], pool: list[str], metrics: list[str],
                          prefix: str = "p_") -> DataFrame:
    """Mean-rank percentiles of many metrics at once: long form, one ranking, back to columns.

    The result has id_cols and one prefixed column per metric.
    """
    long = df.unpivot([*id_cols, *pool], metrics, "metric", "value")
    ranked = add_percentile_rank(long, "value", [*pool, "metric"], "__p")
    wide = ranked.groupBy(*id_cols).pivot("metric", metrics).agg(F.first("__p"))
    return wide.withColumnsRenamed({m: f"{prefix}{m}" for m in metrics})


def exact_quantiles(df: DataFrame, value: str, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact quantiles per key, one column per (name: probability)."""
    pos = value_positions(df, value, keys)
    aggs = []
    for name, p in probs.items():
        h = (F.col("n_pool") - 1) * F.lit(float(p))

        def at(index):
            return F.max(F.when((F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n_ties")), F.col(value)))

        low, high = at(F.floor(h)), at(F.ceil(h))
        frac = F.max(h - F.floor(h))
        aggs.append((low + (high - low) * frac).alias(name))
    return pos.groupBy(*keys).agg(F.max("n_pool").alias("n"), *aggs)


def approximate_quantiles(df: DataFrame, value: str, keys: list[str], probs: dict[str, float],
                          accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch quantiles for callers that accept an error of 1/accuracy in rank."""
    names = list(probs)
    agg = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.percentile_approx(value, [float(probs[n]) for n in names], accuracy).alias("__q")
    )
    return agg.select(*keys, "n", *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def leaderboard(df: DataFrame, value: str, pool: list[str], tie: str, ascending: bool = True,
                rank: str = "rank") -> DataFrame:
    """1-based leaderboard place by value then tie column (numeric, unique); missing values come last."""
    placed = with_positions(df, value, pool, size="__lb_size")
    out = row_index(placed, [*pool, value], [tie], "__lb_t")
    present = F.col("n_pool").isNotNull()
    ahead = F.col("n_below") if ascending else F.col("n_pool") - F.col("n_below") - F.col("n_ties")
    place = F.when(present, ahead).otherwise(F.col("__lb_size")) + F.col("__lb_t") + 1
    return out.withColumn(rank, place.cast("long")).drop("n_ties", "n_below", "n_pool", "__lb_t", "__lb_size")


def bar_length(df: DataFrame, value: str, pool: list[str], out: str = "bar") -> DataFrame:
    """15..100 bar against the pool's range, longest for the smallest value; 50 when all are equal."""
    from statloom.operators.keys import with_group_stats

    ranged = with_group_stats(df, pool, __lo=F.min(value), __hi=F.max(value))
    span = F.col("__hi") - F.col("__lo")
    bar = F.when(span > 0, (F.col("__hi") - as_col(value)) / span * 85 + 15).otherwise(50.0)
    return ranged.withColumn(out, F.when(as_col(value).isNotNull(), bar)).drop("__lo", "__hi")
