"""Grades centred on 100 and other normalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.numeric import clip, round_half_even
from statloom.operators.keys import lookup, with_group_stats


def inverted_z_grade(df: DataFrame, value: str, kind: str, out: str = "grade") -> DataFrame:
    """100 - 10 z within each kind (lower values are better); kinds without spread give no rows."""
    g = with_group_stats(df, [kind], __m=F.avg(value), __s=F.stddev_samp(value)).filter(F.col("__s") > 0)
    return g.withColumn(out, round_half_even(F.lit(100) - (F.col(value) - F.col("__m")) / F.col("__s") * 10, 1)).drop(
        "__m", "__s"
    )


def log_grade(df: DataFrame, value: str, by: list[str], out: str = "grade") -> DataFrame:
    """100 + 15 z of the logarithm, which is floored at 1e-10."""
    logged = df.withColumn("__l", F.when(F.col(value).isNotNull(), F.ln(F.greatest(F.col(value), F.lit(1e-10)))))
    g = with_group_stats(logged, by, __m=F.avg("__l"), __s=F.stddev_samp("__l"))
    z = F.when(F.col("__s") > 0, (F.col("__l") - F.col("__m")) / F.col("__s"))
    return g.withColumn(out, round_half_even(F.lit(100) + z * 15, 0)).drop("__l", "__m", "__s")


def norm_table(df: DataFrame, components: list[str], level: str, kind: str) -> DataFrame:
    """(level, component, kind): mean and deviation; kind null holds all kinds of the level together."""
    long = df.unpivot([level, kind], components, "component", "value")
    sets = [[level, "component", kind], [level, "component"]]
    out = long.groupingSets(sets, level, "component", kind).agg(
        F.grouping(kind).alias("is_all"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return out


def component_grades(df: DataFrame, norms: DataFrame, ids: list[str], components: dict[str, str], level: str, kind: str,
                     sign: float = -1.0) -> DataFrame:
    """Grade of each component under its mode: per-type, global, or hybrid (all-kind mean, own-kind deviation)."""
    own = norms.filter("is_all = 0").select(level, "component", kind, F.col("mean").alias("__tm"), F.col("std").alias("__ts"))
    whole = norms.filter("is_all = 1").select(level, "component", F.col("mean").alias("__gm"), F.col("std").alias("__gs"))
    long = df.unpivot([*ids, level, kind], list(components), "component", "value")
    j = lookup(lookup(long, own, [level, "component", kind]), whole, [level, "component"])
    mode = F
    for c, m in components.items():
        mode = mode.when(F.col("component") == c, m)
    j = j.withColumn("mode", mode.otherwise(None))
    mean = F.when(F.col("mode") == "per-type", F.col("__tm")).otherwise(F.col("__gm"))
    std = F.when(F.col("mode") == "global", F.col("__gs")).otherwise(F.col("__ts"))
    grade = F.when(std > 0, F.lit(100) + F.lit(sign) * (F.col("value") - mean) / std * 10)
    return j.select(*ids, level, kind, "component", "mode", "value", grade.alias("grade"))


def deployment_factor(df: DataFrame, share: str, group: str, out: str = "deployment_factor") -> DataFrame:
    """z of the zone-start share within the group, held to +-1; 0 where the group has no spread."""
    g = with_group_stats(df, [group], __m=F.avg(share), __s=F.stddev_samp(share))
    z = clip((F.col(share) - F.col("__m")) / F.col("__s"), -1.0, 1.0)
    return g.withColumn(out, F.when(F.col("__s") > 0, z).otherwise(0.0)).drop("__m", "__s")


def zone_start_share(part: str, parts: list[str], default: float = 33.3) -> Column:
    def known(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    total = sum((known(c) for c in parts[1:]), known(parts[0]))
    return F.when(total > 0, known(part) / total * 100).otherwise(default)


def equal_width_bin(df: DataFrame, value: str, bins: int = 20, out: str = "bin") -> DataFrame:
    """1..bins over the observed range, right-closed; the lowest value belongs to bin 1."""
    from statloom.operators.keys import with_table_stats

    r = with_table_stats(df, __lo=F.min(value), __hi=F.max(value))
    width = (F.col("__hi") - F.col("__lo")) / bins
    number = F.ceil((F.col(value) - F.col("__lo")) / width)
    return r.withColumn(
        out, F.when(width > 0, F.least(F.greatest(number, F.lit(1)), F.lit(bins)).cast("int"))
        .when(F.col(value).isNotNull(), F.lit((bins + 1) // 2)),
    ).withColumn(out, F.when(F.col(value).isNotNull(), F.col(out))).drop("__lo", "__hi")


def over_expected(df: DataFrame, value: str, by: str, bins: int = 20, out: str = "over_expected") -> DataFrame:
    """Value minus the mean of its equal-width bin of `by`; 0 where either is missing."""
    binned = equal_width_bin(df, by, bins, "__bin")
    # one row per bin: small whatever the table's size
    means = F.broadcast(binned.groupBy("__bin").agg(F.avg(value).alias("__m")))
    g = lookup(binned, means, ["__bin"])
    diff = F.when(F.col("__bin").isNotNull(), F.col(value) - F.col("__m"))
    return g.withColumn(out, F.coalesce(diff, F.lit(0.0))).drop("__bin", "__m")
