"""Bucket grids and density grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.buckets import (
    ANGLE_LABELS, WIDE_ANGLE_LABELS, ZONE_DISPLAY, angle_bucket, count_bucket, in_zone, is_hard_hit,
    is_swing, is_whiff, label_of, pitch_group, wide_angle_bucket,
)
from statloom.functions.numeric import round_half_even, round_half_up, safe_percent, safe_ratio
from statloom.operators.keys import lookup, with_group_stats
from statloom.session import spread

# The columns of a count grid, in display order.
GRID_BUCKETS = ["all", "first", "ahead", "even", "behind", "full"]
ANGLE_BUCKETS = 12


def _grid(pitches: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Zone, whiff, swing percent and exit speed per kind and count bucket, with an 'all' bucket."""
    zone = in_zone("plate_x", "plate_z", "sz_top", "sz_bot", ZONE_DISPLAY)
    swing, whiff = is_swing("description"), is_whiff("description")
    tagged = pitches.withColumn("bucket", count_bucket("balls", "strikes"))
    full = [*keys, kind, "bucket"]
    out = tagged.groupingSets([full, full[:-1]], *full).agg(
        F.grouping("bucket").alias("__total"),
        F.count(F.lit(1)).alias("n"),
        safe_percent(F.count_if(zone), F.count(zone)).alias("zone"),
        safe_percent(F.count_if(whiff), F.count_if(swing)).alias("whiff"),
        safe_percent(F.count_if(swing), F.count(F.lit(1))).alias("swing"),
        F.avg("launch_speed").alias("ev"),
    )
    named = out.withColumn("bucket", F.when(F.col("__total") == 1, "all").otherwise(F.col("bucket")))
    return named.filter(F.col("bucket").isNotNull()).drop("__total")


def count_grid_by_type(pitches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _grid(pitches, keys or [], "pitch_type")


def count_grid_by_group(pitches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By pitch group, with the group's share (mix) of all pitches in the bucket; ungrouped types count there too."""
    keys = keys or []
    grid = _grid(pitches.withColumn("pitch_group", pitch_group("pitch_type")), keys, "pitch_group")
    mixed = with_group_stats(grid, [*keys, "bucket"], True, __t=F.sum("n"))
    mixed = mixed.withColumn("mix", safe_percent("n", "__t")).drop("__t")
    return mixed.filter(F.col("pitch_group") != "Other")


def grid_to_columns(grid: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """One row per key, one column per count bucket."""
    return grid.groupBy(*keys).pivot("bucket", GRID_BUCKETS).agg(F.first(measure))


def angle_histogram(batted: DataFrame, player: str, minimum: int = 30) -> DataFrame:
    """Count, exit speed and hard-hit percent per launch-angle bucket: league rows (player null) and players
    with enough batted balls. Every bucket is present; an empty one has count 0 and no means."""
    b = batted.filter(F.col("launch_speed").isNotNull() & F.col("launch_angle").isNotNull())
    b = b.withColumn("bucket", angle_bucket("launch_angle"))
    sums = b.groupingSets([[player, "bucket"], ["bucket"]], player, "bucket").agg(
        F.grouping(player).alias("is_league"),
        F.count(F.lit(1)).alias("count"), F.sum("launch_speed").alias("ev_sum"),
        F.count_if(is_hard_hit("launch_speed")).alias("hard"),
    )
    totals = sums.groupBy("is_league", player).agg(F.sum("count").alias("total_bbe"))
    totals = totals.filter((F.col("is_league") == 1) | (F.col("total_bbe") >= minimum))
    frame = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(ANGLE_BUCKETS - 1))))
    return finish_angle_histogram(lookup(frame, sums, ["is_league", player, "bucket"]))


def finish_angle_histogram(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "label": label_of("bucket", ANGLE_LABELS),
        "count": F.coalesce("count", F.lit(0)),
        "avg_ev": round_half_even(safe_ratio("ev_sum", "count"), 1),
        "hard_hit_pct": round_half_even(safe_percent("hard", "count"), 1),
    }).drop("ev_sum", "hard")


def merge_angle_buckets(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve published buckets to seven: count-weighted speed, hard hits rebuilt from the percentages."""
    n = F.col("count")
    wide = hist.withColumn("wide_bucket", wide_angle_bucket("bucket")).groupBy(*keys, "wide_bucket").agg(
        F.sum(n).alias("count"),
        F.sum(F.coalesce(F.col("avg_ev") * n, F.lit(0.0))).alias("__ev"),
        F.sum(F.coalesce(round_half_up(F.col("hard_hit_pct") / 100 * n, 0), F.lit(0.0))).alias("__hard"),
    )
    return wide.select(
        *keys, "wide_bucket", label_of("wide_bucket", WIDE_ANGLE_LABELS).alias("label"), "count",
        round_half_up(safe_ratio("__ev", "count"), 1).alias("avg_ev"),
        round_half_up(safe_percent("__hard", "count"), 1).alias("hard_hit_pct"),
    )


def bucket_shares_vs_league(wide: DataFrame, player: str) -> DataFrame:
    """Share of each bucket and differences to the league rows (is_league = 1)."""
    shared = with_group_stats(wide, ["is_league", player], True, __t=F.sum("count"))
    shared = shared.withColumn("share", F.coalesce(safe_percent("count", "__t"), F.lit(0.0))).drop("__t")
    league = shared.filter("is_league = 1").select(
        "wide_bucket", F.col("share").alias("lg_share"), F.col("avg_ev").alias("lg_ev"),
        F.col("hard_hit_pct").alias("lg_hard"),
    )
    return lookup(shared.filter("is_league = 0"), league, ["wide_bucket"]).select(
        player, "wide_bucket", "count", "share",
        (F.col("share") - F.col("lg_share")).alias("share_diff"),
        (F.col("avg_ev") - F.col("lg_ev")).alias("ev_diff"),
        (F.col("hard_hit_pct") - F.col("lg_hard")).alias("hard_diff"),
    )


def density_grid(pitches: DataFrame, keys: list[str], x: str, z: str, x_range: tuple[float, float],
                 z_range: tuple[float, float], cols: int, rows: int, sigma: float = 0.35) -> DataFrame:
    """Gaussian density of locations on a grid per key, 3 sigma wide, and its share of the key's peak.

    Every location adds to the cells around it; cells are summed before and after the shuffle.
    """
    (x0, x1), (z0, z1) = x_range, z_range
    cw, ch = (x1 - x0) / cols, (z1 - z0) / rows
    sc, sr = sigma / cw, sigma / ch
    rc, rr = int(-(-3 * sc // 1)), int(-(-3 * sr // 1))
    cx, cy = (F.col(x) - x0) / cw, (F.lit(z1) - F.col(z)) / ch
    located = pitches.filter(F.col(x).isNotNull() & F.col(z).isNotNull()).select(*keys, x, z)
    here = spread(located).select(*keys, cx.alias("cx"), cy.alias("cy"))

    def reach(centre: Column, radius: int, size: int) -> Column:
        mid = F.floor(centre + 0.5).cast("int")
        low, high = F.greatest(mid - radius, F.lit(0)), F.least(mid + radius, F.lit(size - 1))
        return F.when(low <= high, F.sequence(low, high))

    cells = here.withColumn("row", F.explode(reach(F.col("cy"), rr, rows))).withColumn(
        "col", F.explode(reach(F.col("cx"), rc, cols))
    )
    dx, dy = F.col("col") - F.col("cx"), F.col("row") - F.col("cy")
    weight = F.exp(-(dx * dx / F.lit(2 * sc * sc) + dy * dy / F.lit(2 * sr * sr)))
    grid = cells.groupBy(*keys, "row", "col").agg(F.sum(weight).alias("density"))
    return with_group_stats(grid, keys, True, __peak=F.max("density")).withColumn(
        "relative", safe_ratio("density", "__peak")
    ).drop("__peak")


def versus_league(rows: DataFrame, league: DataFrame, keys: list[str], value: str, league_value: str,
                  fallback: Column, out: str) -> DataFrame:
    """Difference to the league value of the same keys, or to a fallback where the league has none."""
    joined = lookup(rows, league.select(*keys, F.col(league_value).alias("__lg")), keys)
    return joined.withColumn(out, F.col(value) - F.coalesce(F.col("__lg"), fallback)).drop("__lg")
