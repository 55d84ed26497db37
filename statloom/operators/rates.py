"""Rate tables, batting and pitching lines, weighted means and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import as_col
from statloom.functions.buckets import ZONE_DISPLAY, ZONE_RULEBOOK, in_zone, is_swing, is_whiff
from statloom.functions.numeric import (
    round_half_even, round_half_up, safe_percent, safe_ratio, zero_to_null,
)
from statloom.operators.keys import lookup, with_group_stats

# Event names of plate appearances.
HIT_BASES = {"Single": 1, "Double": 2, "Triple": 3, "Home Run": 4}
WALK_EVENTS = ("Walk", "Intent Walk")
STRIKEOUT_EVENTS = ("Strikeout", "Strikeout Double Play")
SAC_FLY_EVENTS = ("Sac Fly", "Sacrifice Fly", "Sac Fly DP")
NO_AT_BAT_EVENTS = (
    "Walk", "Intent Walk", "Hit By Pitch", "Sacrifice Fly", "Sacrifice Bunt", "Sac Fly", "Sac Bunt",
    "Sac Fly DP", "Catcher Interference", "Batter Interference",
)
# Additive constant of fielding-independent pitching, by season.
FIP_CONSTANTS = {2023: 3.107, 2024: 3.102, 2025: 3.150, 2026: 3.150}
FIP_DEFAULT = 3.150


def _share(flag: Column, of: Column) -> Column:
    """Percent of the rows in `of` that also meet `flag`."""
    return safe_percent(F.count_if(flag & of), F.count_if(of))


def grade_means(scored: DataFrame, by: list[str], grades: list[str], scale: int = 100) -> DataFrame:
    """Count and mean grades per group, on a per-100 scale."""
    return scored.groupBy(*by).agg(
        F.count(grades[0]).alias("n"), *[round_half_even(F.avg(g) * scale, 3).alias(g) for g in grades]
    )


def grade_means_two_levels(scored: DataFrame, player: str, kind: str, grades: list[str]) -> DataFrame:
    """Per (player, kind) and per player in one pass; `level` tells them apart (kind is null on player rows)."""
    out = scored.groupingSets([[player, kind], [player]], player, kind).agg(
        F.grouping(kind).alias("g"), F.count(grades[0]).alias("n"),
        *[round_half_even(F.avg(x) * 100, 3).alias(x) for x in grades],
    )
    return out.withColumn("level", F.when(F.col("g") == 1, "player").otherwise("kind")).drop("g")


def league_rates(pitches: DataFrame, by: list[str], minimum: int = 500) -> DataFrame:
    """Pitch-type averages: count, speed, spin, extension, zone and whiff percent, types with enough pitches."""
    zone = in_zone("plate_x", "plate_z", "sz_top", "sz_bot", ZONE_RULEBOOK)
    swing, whiff = is_swing("description"), is_whiff("description")
    return (
        pitches.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("count"),
            round_half_even(F.avg("release_speed"), 1).alias("velo"),
            round_half_even(F.avg("release_spin_rate"), 0).alias("spin"),
            round_half_even(safe_percent(F.count_if(zone), F.count(zone)), 1).alias("zone_pct"),
            round_half_even(safe_percent(F.count_if(whiff), F.count_if(swing)), 1).alias("whiff_pct"),
            round_half_even(F.avg("release_extension"), 2).alias("extension"),
        )
        .filter(F.col("count") >= minimum)
    )


def pitch_mix(pitches: DataFrame, player: list[str], kind: str = "pitch_type") -> DataFrame:
    """Per player and pitch type: n, usage, means, zone and whiff percent."""
    zone = in_zone("plate_x", "plate_z", "sz_top", "sz_bot", ZONE_DISPLAY)
    swing, whiff = is_swing("description"), is_whiff("description")
    per = pitches.groupBy(*player, kind).agg(
        F.count(F.lit(1)).alias("n"),
        round_half_up(F.avg(zero_to_null("release_speed")), 1).alias("velo"),
        round_half_up(F.avg(zero_to_null("release_spin_rate")), 0).alias("spin"),
        round_half_up(F.avg("pfx_x"), 1).alias("h_break"),
        round_half_up(F.avg("pfx_z"), 1).alias("v_break"),
        round_half_up(F.avg(zero_to_null("release_pos_z")), 2).alias("release_height"),
        round_half_up(F.avg(zero_to_null("release_extension")), 1).alias("extension"),
        round_half_up(safe_percent(F.count_if(zone), F.count(F.lit(1))), 1).alias("zone_pct"),
        round_half_up(safe_percent(F.count_if(whiff), F.count_if(swing)), 1).alias("whiff_pct"),
    )
    usage = round_half_up(safe_percent("n", "__total"), 1)
    return with_group_stats(per, player, True, __total=F.sum("n")).withColumn("usage_pct", usage).drop("__total")


def weighted_means(df: DataFrame, by: list[str], rates: list[str], weight: str, totals: dict[str, Column] | None = None,
                   floor: float | None = None) -> DataFrame:
    """Null-skipping weighted means and any further aggregates, all algebraic (no group function)."""
    w = F.greatest(F.col(weight), F.lit(floor)) if floor is not None else F.col(weight)
    aggs = [
        (F.sum(F.col(r) * w) / F.nullif(F.sum(F.when(F.col(r).isNotNull(), w)), F.lit(0.0))).alias(r) for r in rates
    ]
    aggs += [c.alias(n) for n, c in (totals or {}).items()]
    return df.groupBy(*by).agg(*aggs)


def share_of_total(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    """Value over its group total; a total below one counts as one."""
    t = with_group_stats(df, keys, __t=F.sum(value))
    return t.withColumn(out, F.col(value) / F.greatest(F.col("__t"), F.lit(1))).drop("__t")


def batting_lines(appearances: DataFrame, by: list[str], event: str = "event") -> DataFrame:
    """PA, AB, H, TB, K, BB, HBP, SF with OBP, SLG, K% and BB%."""
    e = F.col(event)
    bases = F
    for name, b in HIT_BASES.items():
        bases = bases.when(e == name, b)
    out = appearances.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pa"),
        F.count_if(~F.coalesce(e, F.lit("")).isin(*NO_AT_BAT_EVENTS)).alias("ab"),
        F.count_if(e.isin(*HIT_BASES)).alias("h"),
        F.sum(bases.otherwise(0)).cast("long").alias("tb"),
        F.count_if(e.contains("Strikeout")).alias("k"),
        F.count_if(e.isin(*WALK_EVENTS)).alias("bb"),
        F.count_if(e == "Hit By Pitch").alias("hbp"),
        F.count_if(e.isin(*SAC_FLY_EVENTS)).alias("sf"),
    )
    return batting_rates(out)


def batting_rates(lines: DataFrame) -> DataFrame:
    reach = F.col("h") + F.col("bb") + F.col("hbp")
    chances = F.col("ab") + F.col("bb") + F.col("hbp") + F.col("sf")
    zero = F.lit(0.0)
    return lines.withColumns({
        "obp": round_half_up(F.coalesce(safe_ratio(reach, chances), zero), 3),
        "slg": round_half_up(F.coalesce(safe_ratio("tb", "ab"), zero), 3),
        "k_pct": round_half_up(F.coalesce(safe_percent("k", "pa"), zero), 1),
        "bb_pct": round_half_up(F.coalesce(safe_percent("bb", "pa"), zero), 1),
    })


def total_bases(hits, doubles, triples, homers) -> Column:
    h, d, t, r = (as_col(c) for c in (hits, doubles, triples, homers))
    return (h - d - t - r) + d * 2 + t * 3 + r * 4


def contact_and_discipline(pitches: DataFrame, by: list[str], half_width: float = ZONE_DISPLAY) -> DataFrame:
    """Mean and top exit speed on balls in play, whiff and chase percent."""
    swing, whiff = is_swing("description"), is_whiff("description")
    zone = in_zone("plate_x", "plate_z", "sz_top", "sz_bot", half_width)
    outside = F.coalesce(~zone, F.lit(False))
    zero = F.lit(0.0)
    return pitches.groupBy(*by).agg(
        round_half_up(F.avg("launch_speed"), 1).alias("avg_ev"),
        round_half_up(F.max("launch_speed"), 1).alias("max_ev"),
        round_half_up(F.coalesce(safe_percent(F.count_if(whiff), F.count_if(swing)), zero), 1).alias("whiff_pct"),
        round_half_up(F.coalesce(_share(swing, outside), zero), 1).alias("chase_pct"),
    )


def prefer_box(box: DataFrame, pbp: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """One line per key: the official line where there is one, else the line built from plays."""
    b = box.select(*keys, F.lit(True).alias("__box"), *[F.col(s).alias(f"__{s}") for s in stats])
    both = pbp.select(*keys, *stats).join(b, keys, "full")
    return both.select(
        *keys,
        F.coalesce("__box", F.lit(False)).alias("from_box"),
        *[F.when(F.col("__box"), F.coalesce(f"__{s}", F.lit(0))).otherwise(F.col(s)).alias(s) for s in stats],
    )


def pitching_rates(lines: DataFrame, season: str = "season") -> DataFrame:
    """ERA, FIP, K% and BB% of season lines with outs, er, hr, bb, hbp, k and bf."""
    from statloom.functions.dates import actual_innings, outs_to_innings

    ip = actual_innings("outs")
    const = F
    for year, c in FIP_CONSTANTS.items():
        const = const.when(F.col(season) == year, c)
    fip = safe_ratio(F.lit(13) * F.col("hr") + F.lit(3) * (F.col("bb") + F.col("hbp")) - F.lit(2) * F.col("k"), ip)
    return lines.withColumns({
        "ip": outs_to_innings("outs"),
        "era": safe_ratio(F.col("er") * 9, ip),
        "fip": fip + const.otherwise(FIP_DEFAULT),
        "k_pct": safe_percent("k", "bf"),
        "bb_pct": safe_percent("bb", "bf"),
    })


def distribution_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, sample deviation, median and the 5th, 25th, 75th and 95th percentiles, exact."""
    from statloom.operators.ranks import exact_quantiles

    moments = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    cuts = exact_quantiles(df, value, by, {"median": 0.5, "p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95})
    return lookup(moments, cuts, by)


def impute_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Fills each feature's gaps with its exact median over all rows."""
    from statloom.operators.ranks import exact_quantiles

    long = df.unpivot([], features, "feature", "value").withColumn("value", F.col("value").cast("double"))
    medians = exact_quantiles(long, "value", ["feature"], {"median": 0.5})
    one = medians.agg(
        F.struct(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f) for f in features]).alias("m")
    )
    filled = df.withColumn("__m", one.scalar())
    return filled.withColumns({f: F.coalesce(F.col(f), F.col("__m")[f]) for f in features}).drop("__m")


def player_summary(swings: DataFrame, by: list[str], means: dict[str, str], minimum: int) -> DataFrame:
    """Mean of several measures and the number of rows, groups with enough rows."""
    return (
        swings.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in means.items()])
        .filter(F.col("n") >= minimum)
    )


def validate_against(df: DataFrame, by: list[str], score: str, outcome: str) -> DataFrame:
    """Pairs, correlation and R-squared over rows that have both values."""
    pairs = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.corr(score, outcome).alias("r"),
        F.regr_r2(F.col(outcome), F.col(score)).alias("r2"),
    )


def linear_fit(df: DataFrame, by: list[str], y: str, x: str, prefix: str = "") -> DataFrame:
    """Slope and intercept of y on x per group."""
    return df.groupBy(*by).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias(f"{prefix}n"),
        F.regr_slope(F.col(y), F.col(x)).alias(f"{prefix}slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias(f"{prefix}intercept"),
    )


def plane_fit(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """Least squares of y on two predictors per group, in closed form from the covariances."""
    full = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    m = full.groupBy(*by).agg(
        F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_samp(a).alias("vaa"), F.var_samp(b).alias("vbb"), F.covar_samp(a, b).alias("vab"),
        F.covar_samp(a, y).alias("vay"), F.covar_samp(b, y).alias("vby"),
    )
    det = F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab")
    sa = F.when(det != 0, (F.col("vay") * F.col("vbb") - F.col("vby") * F.col("vab")) / det)
    sb = F.when(det != 0, (F.col("vby") * F.col("vaa") - F.col("vay") * F.col("vab")) / det)
    return m.select(
        *by, sa.alias("slope_a"), sb.alias("slope_b"),
        (F.col("my") - sa * F.col("ma") - sb * F.col("mb")).alias("intercept"),
    )


def histogram(df: DataFrame, value: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Rows and share per equal-width bin; bins 0 and bins+1 hold what lies outside."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(
        *by, F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    return with_group_stats(counts, by, True, __t=F.sum("n")).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def trend_series(df: DataFrame, by: list[str], season: str, metrics: list[str], out: str = "series") -> DataFrame:
    """Season-ordered list of metric structs per key; as long as a key has seasons."""
    per = df.groupBy(*by, season).agg(*[F.max(m).alias(m) for m in metrics])
    return per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(season, *metrics))).alias(out))


def run_summary(df: DataFrame, by: list[str], value: str, qualified: Column) -> DataFrame:
    """Rows in, rows qualified and the range of a value."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(qualified).alias("qualified"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"),
    )


def yearly_counts(df: DataFrame, year: str, player: str) -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(player).alias("players"))


def rolling_day_means(df: DataFrame, key: str, date: str, values: list[str], days: int = 60) -> DataFrame:
    """Trailing means per key and day, today included.

    Rows are added up per day first, so the range window sees one row per key and day.
    """
    daily = df.groupBy(key, F.col(date).alias("day")).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(v).alias(f"__s_{v}") for v in values], *[F.count(v).alias(f"__c_{v}") for v in values],
    ).withColumn("__d", F.unix_date(F.col("day")))
    w = Window.partitionBy(key).orderBy("__d").rangeBetween(-days, 0)
    return daily.select(
        key, "day", F.sum("__n").over(w).alias("n"),
        *[safe_ratio(F.sum(f"__s_{v}").over(w), F.sum(f"__c_{v}").over(w)).alias(v) for v in values],
    )


def rolling_starts(df: DataFrame, key: str, start: list[str], order: list[str], value: str, starts: int = 3) -> DataFrame:
    """Mean and sample deviation of the value over the last few starts of a key, one row per start.

    Each start adds its sums to itself and to the next starts, so no window over all starts is needed.
    """
    from statloom.operators.segments import row_index

    per = df.groupBy(key, *start).agg(
        F.count(value).alias("__n"), F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q")
    )
    at = row_index(per, [key], order, "start_no", "__total")
    spread = at.select(
        key, "__n", "__s", "__q", "__total",
        F.posexplode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("__p", "__k"), F.col("start_no").alias("__i"),
    ).withColumn("start_no", F.col("__i") + F.col("__k")).filter(F.col("start_no") < F.col("__total"))
    sums = spread.groupBy(key, "start_no").agg(F.sum("__n").alias("n"), F.sum("__s").alias("s"), F.sum("__q").alias("q"))
    mean = safe_ratio("s", "n")
    var = F.when(F.col("n") > 1, F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    stats = sums.select(key, "start_no", "n", mean.alias("mean"), F.sqrt(var).alias("std"))
    return lookup(at.select(key, *start, "start_no"), stats, [key, "start_no"])
