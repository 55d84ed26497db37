"""Buckets, zones, pitch families and event classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import as_col

# Launch-angle edges (right-closed) and labels.
ANGLE_EDGES = (-10, -5, 0, 5, 10, 15, 20, 25, 30, 35, 40)
ANGLE_LABELS = (
    "≤ -10", "-10 to -5", "-5 to 0", "0 to 5", "5 to 10", "10 to 15",
    "15 to 20", "20 to 25", "25 to 30", "30 to 35", "35 to 40", "> 40",
)
# Display labels of the seven wide buckets.
WIDE_ANGLE_LABELS = ("< -10°", "-10 to 0°", "0 to 10°", "10 to 20°", "20 to 30°", "30 to 40°", "> 40°")

# Pitch groups of the count grids and pitch families of the swing features.
PITCH_GROUPS = {
    "Fastball": ("FF", "SI", "FC", "FA"),
    "Breaking": ("SL", "CU", "KC", "CS", "SV", "ST", "KN"),
    "Offspeed": ("CH", "FS", "SC", "FO"),
}
PITCH_FAMILIES = {
    "fastball": ("FF", "SI", "FC", "FA"),
    "breaking": ("SL", "CU", "KC", "SV", "CS", "ST"),
    "offspeed": ("CH", "FS", "FO", "SC", "KN", "EP"),
}

# Pitch descriptions and call codes.
SWING_DESCRIPTIONS = (
    "swinging_strike", "swinging_strike_blocked", "foul", "foul_tip", "foul_bunt", "missed_bunt",
    "hit_into_play", "hit_into_play_no_out", "hit_into_play_score", "foul_pitchout", "swinging_pitchout",
)
WHIFF_DESCRIPTIONS = (
    "swinging_strike", "swinging_strike_blocked", "foul_tip", "missed_bunt", "swinging_pitchout",
)
CONTACT_DESCRIPTIONS = ("hit_into_play", "foul", "hit_into_play_no_out", "hit_into_play_score", "foul_bunt")
TRACKED_SWING_DESCRIPTIONS = (
    "hit_into_play", "swinging_strike", "swinging_strike_blocked", "foul", "foul_tip", "foul_bunt",
    "missed_bunt", "bunt_foul_tip", "hit_into_play_no_out", "hit_into_play_score",
)
SWING_CODES = ("S", "D", "E", "F", "L", "M", "O", "T", "W", "X")
WHIFF_CODES = ("S", "W", "T")

# Events that put a batter or runner out. Errors and interference are listed on purpose.
OUT_EVENTS = (
    "strikeout", "field_out", "grounded_into_double_play", "force_out", "fielders_choice",
    "fielders_choice_out", "sac_fly", "sac_bunt", "double_play", "triple_play", "strikeout_double_play",
    "sac_fly_double_play", "field_error", "caught_stealing_2b", "caught_stealing_3b",
    "caught_stealing_home", "pickoff_1b", "pickoff_2b", "pickoff_3b", "other_out",
    "batter_interference", "catcher_interf",
)

# Expected slugging by launch angle and exit speed,
# as (angle from, angle below, ((speed below, value), ..., (None, value))).
EXPECTED_SLUGGING = (
    (None, 10, ((70, 0.05), (85, 0.15), (95, 0.30), (None, 0.50))),
    (10, 25, ((75, 0.20), (85, 0.40), (95, 0.70), (100, 1.20), (105, 1.60), (None, 2.20))),
    (25, 40, ((85, 0.15), (95, 0.50), (100, 1.00), (105, 1.80), (None, 2.80))),
    (40, None, ((90, 0.02), (100, 0.05), (None, 0.30))),
)

# Half widths of the strike zone, in feet.
ZONE_RULEBOOK, ZONE_DISPLAY, ZONE_WIDE = 0.83, 0.88, 0.95

HARD_HIT_SPEED = 95.0


def angle_bucket(angle) -> Column:
    """0..11, right-closed five-degree buckets with open ends."""
    a = as_col(angle)
    out = F
    for i, edge in enumerate(ANGLE_EDGES):
        out = out.when(a <= edge, i)
    return out.when(a.isNotNull(), len(ANGLE_EDGES)).cast("int")


def wide_angle_bucket(bucket) -> Column:
    """0..11 to 0..6: the ends stay alone, inner buckets go in pairs."""
    b = as_col(bucket)
    return F.ceil(b / 2).cast("int")


def label_of(index, labels) -> Column:
    i = as_col(index)
    return F.array(*[F.lit(s) for s in labels])[i.cast("int")]


def count_bucket(balls, strikes) -> Column:
    """first, ahead, even, behind or full, as the pitcher sees the count."""
    b, s = as_col(balls), as_col(strikes)
    return (
        F.when((b == 0) & (s == 0), "first")
        .when((b == 3) & (s == 2), "full")
        .when((b <= 2) & (s <= 2) & (b < s), "ahead")
        .when((b <= 2) & (s <= 2) & (b == s), "even")
        .when((b <= 3) & (s <= 1) & (b > s), "behind")
    )


def hitter_bucket(bucket) -> Column:
    """The same bucket named from the hitter's side."""
    c = as_col(bucket)
    return F.when(c == "ahead", "behind").when(c == "behind", "ahead").otherwise(c)


def _member(code: Column, groups, default: str) -> Column:
    out = F
    for name, codes in groups.items():
        out = out.when(code.isin(*codes), name)
    return out.otherwise(default)


def pitch_group(code) -> Column:
    return _member(as_col(code), PITCH_GROUPS, "Other")


def pitch_family(code) -> Column:
    return _member(as_col(code), PITCH_FAMILIES, "other")


def in_zone(x, z, top=None, bottom=None, half_width: float = ZONE_RULEBOOK, pad: float = 0.0) -> Column:
    """Null without a location. Zone edges default to 3.5 and 1.5 ft; zero edges count as missing."""
    x, z = as_col(x), as_col(z)
    t = F.lit(3.5) if top is None else F.coalesce(F.nullif(as_col(top), F.lit(0.0)), F.lit(3.5))
    b = F.lit(1.5) if bottom is None else F.coalesce(F.nullif(as_col(bottom), F.lit(0.0)), F.lit(1.5))
    return F.when(
        x.isNotNull() & z.isNotNull(),
        (F.abs(x) <= half_width) & (z >= b - F.lit(pad)) & (z <= t + F.lit(pad)),
    )


def is_swing(description) -> Column:
    return F.coalesce(as_col(description).isin(*SWING_DESCRIPTIONS), F.lit(False))


def is_whiff(description) -> Column:
    return F.coalesce(as_col(description).isin(*WHIFF_DESCRIPTIONS), F.lit(False))


def is_contact(description) -> Column:
    return F.coalesce(as_col(description).isin(*CONTACT_DESCRIPTIONS), F.lit(False))


def is_hard_hit(speed) -> Column:
    return F.coalesce(as_col(speed) >= HARD_HIT_SPEED, F.lit(False))


def event_outs(event) -> Column:
    """Outs recorded by a terminal event: 0, 1, 2 (double play) or 3 (triple play)."""
    e = F.lower(F.trim(as_col(event)))
    extra = F.when(e.contains("double_play"), 1).when(e.contains("triple_play"), 2).otherwise(0)
    return F.when(e.isin(*OUT_EVENTS), 1 + extra).otherwise(0)


def expected_slugging(angle, speed) -> Column:
    a, s = as_col(angle), as_col(speed)
    rows = F
    for low, high, steps in EXPECTED_SLUGGING:
        here = F.lit(True)
        if low is not None:
            here = here & (a >= low)
        if high is not None:
            here = here & (a < high)
        value = F
        for below, v in steps[:-1]:
            value = value.when(s < below, v)
        rows = rows.when(here, value.otherwise(steps[-1][1]))
    return F.when(a.isNotNull() & s.isNotNull(), rows)


def percentile_band(p) -> Column:
    """Seven display bands of a 0-100 percentile; NA when missing."""
    p = as_col(p)
    return (
        F.when(p.isNull() | F.isnan(p.cast("double")), "NA")
        .when(p >= 90, "90-100").when(p >= 75, "75-90").when(p >= 55, "55-75")
        .when(p >= 45, "45-55").when(p >= 25, "25-45").when(p >= 10, "10-25")
        .otherwise("0-10")
    )


def rating_tier(grade) -> Column:
    """Tier of a 100-centred grade."""
    g = as_col(grade)
    return (
        F.when(g >= 130, "Elite").when(g >= 115, "Above Avg").when(g >= 100, "Average")
        .when(g >= 85, "Below Avg").when(g.isNotNull(), "Poor")
    )


def effectiveness(value, average, scale, higher_better=True, dead_band: float = 0.08) -> Column:
    """Signed distance from average in [-1, 1]; inside the dead band it is 0."""
    d = (as_col(value) - as_col(average)) / as_col(scale)
    if isinstance(higher_better, Column):
        d = F.when(higher_better, d).otherwise(-d)
    elif not higher_better:
        d = -d
    c = F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0)))
    return F.when(F.abs(c) < dead_band, 0.0).otherwise(c)


def threshold_effectiveness(value, low, mid, high, good: str, dead_band: float = 0.05) -> Column:
    """Effectiveness from three thresholds: centre and scale come from the outer two."""
    lo, hi = F.lit(float(low)), F.lit(float(high))
    return effectiveness(value, (lo + hi) / 2, (hi - lo) / 2, good == "high", dead_band)


def spray_point(hit_x, hit_y, width: float, height: float, fence: float, origin_x: float, origin_y: float) -> Column:
    """(x, y) on a drawing field, or null when the ball lies more than 20 units off it.

    160 source units are the distance home plate to the centre fence; zero coordinates mean missing.
    """
    hx, hy = F.nullif(as_col(hit_x), F.lit(0.0)), F.nullif(as_col(hit_y), F.lit(0.0))
    scale = fence / 160.0
    x = F.lit(origin_x) + (hx - 125) * F.lit(scale)
    y = F.lit(origin_y) - (F.lit(200) - hy) * F.lit(scale)
    on_field = x.between(-20, width + 20) & y.between(-20, height + 20)
    return F.when(
        on_field,
        F.struct(
            F.greatest(F.lit(2.0), F.least(F.lit(width - 2.0), x)).alias("x"),
            F.greatest(F.lit(2.0), F.least(F.lit(height - 2.0), y)).alias("y"),
        ),
    )
