"""Plate appearances: ordered pitches of one batter against one pitcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.buckets import event_outs
from statloom.functions.names import contains_any, flip_last_first
from statloom.functions.numeric import blank_to_null, round_half_even, round_half_up, safe_percent, safe_ratio
from statloom.operators.segments import carry_forward, row_index

PA_KEYS = ["pitcher", "game_pk", "at_bat_number", "inning"]
CHRONOLOGY = ["game_date", "game_pk", "at_bat_number", "pitch_number"]

# Run values used where a plate appearance has no expected value.
WALK_VALUE, HIT_BY_PITCH_VALUE = 0.696, 0.726


def pitch_index(pitches: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """0-based pitch number inside the plate appearance (idx) and its length (n_pitches)."""
    return row_index(pitches, keys or PA_KEYS, order or ["pitch_number"], "idx", "n_pitches")


def count_before(pitches: DataFrame, keys: list[str], order: list[str],
                 balls_after: str = "balls_after", strikes_after: str = "strikes_after") -> DataFrame:
    """Count before each pitch, from the counts after the pitches: starts 0-0, a missing count keeps the last."""
    out = carry_forward(pitches, keys, order, {"balls": balls_after, "strikes": strikes_after})
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("balls", "strikes")})


def two_strike_appearances(pitches: DataFrame, keys: list[str] | None = None,
                           order: list[str] | None = None) -> DataFrame:
    """One row per plate appearance: pitches needed to reach two strikes, null if never reached.

    `strikes` is the count before the pitch. An appearance that ends at one strike still gets there
    when its last pitch is a strike call or a strikeout; it then needed all its pitches.
    """
    keys = keys or PA_KEYS
    at = pitch_index(pitches, keys, order)
    before = F.coalesce(F.col("strikes"), F.lit(0))
    closing = (F.col("idx") == F.col("n_pitches") - 1) & (before == 1) & (
        contains_any("description", ["strike", "foul", "swinging"]) | contains_any("events", ["strikeout"])
    )
    return at.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when(before >= 2, F.col("idx"))),
            F.max(F.when(closing, F.col("n_pitches"))),
        ).alias("pitches_to_two_strikes"),
        F.max("n_pitches").alias("n_pitches"),
    )


def two_strike_rates(appearances: DataFrame, by: list[str]) -> DataFrame:
    """Sums and counts per pitcher plus their ratio; the sums merge over chunks."""
    out = appearances.groupBy(*by).agg(
        F.coalesce(F.sum("pitches_to_two_strikes"), F.lit(0)).alias("pitch_sum"),
        F.count("pitches_to_two_strikes").alias("qualifying_pas"),
        F.count(F.lit(1)).alias("total_pas"),
    )
    return finish_two_strike_rates(out)


def finish_two_strike_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "avg_pitches": round_half_even(safe_ratio("pitch_sum", "qualifying_pas"), 3),
        "reach_pct": round_half_even(safe_percent("qualifying_pas", "total_pas"), 1),
    })


def outs_by_pitcher(pitches: DataFrame) -> DataFrame:
    return (
        pitches.filter(blank_to_null("events").isNotNull())
        .groupBy("pitcher")
        .agg(F.sum(event_outs("events")).cast("long").alias("outs"))
    )


def game_starts(pitches: DataFrame) -> DataFrame:
    """Starts per pitcher: who threw the first pitch of each half of the first inning."""
    first = (
        pitches.filter((F.col("inning") == 1) & F.col("pitcher").isNotNull())
        .groupBy("game_pk", "inning_topbot")
        .agg(F.min_by("pitcher", F.struct("at_bat_number", "pitch_number", "pitcher")).alias("pitcher"))
    )
    return first.groupBy("pitcher").agg(F.count(F.lit(1)).alias("starts"))


def fielding_team() -> Column:
    half = F.trim("inning_topbot")
    return blank_to_null(F.when(half == "Top", F.col("home_team")).when(half == "Bot", F.col("away_team")))


def batting_team() -> Column:
    half = F.trim("inning_topbot")
    return blank_to_null(F.when(half == "Top", F.col("away_team")).when(half == "Bot", F.col("home_team")))


def current_teams(pitches: DataFrame, player: str, team: Column) -> DataFrame:
    """Team on each player's latest pitch that names one."""
    return (
        pitches.withColumn("__team", team)
        .filter(F.col("__team").isNotNull())
        .groupBy(player)
        .agg(F.max_by("__team", F.struct(*CHRONOLOGY, "__team")).alias("team"))
    )


def current_names(pitches: DataFrame, player: str, name: str = "player_name") -> DataFrame:
    """Latest non-blank name per player, as 'First Last'."""
    named = pitches.withColumn("__name", blank_to_null(flip_last_first(name)))
    return (
        named.filter(F.col("__name").isNotNull())
        .groupBy(player)
        .agg(F.max_by("__name", F.struct(*CHRONOLOGY, "__name")).alias("name"))
    )


def expected_value_by_player(pitches: DataFrame, player: str, value: str = "xwoba_est",
                             keys: list[str] | None = None) -> DataFrame:
    """Mean expected value per player over the terminal pitch of each plate appearance.

    Without an expected value a walk and a hit batter count their run value, anything else 0.
    A player none of whose appearances has an expected value gets null.
    """
    keys = list(dict.fromkeys([player, *(keys or ["game_pk", "inning", "at_bat_number"])]))
    ended = pitches.filter(blank_to_null("events").isNotNull())
    terminal = ended.groupBy(*keys).agg(
        F.min_by(F.struct(F.trim("events").alias("event"), F.col(value).alias("x")),
                 F.struct("pitch_number", "events", value)).alias("t")
    )
    x, event = F.col("t.x"), F.col("t.event")
    known = x.isNotNull() & ~F.isnan(x) & (x >= 0)
    worth = (
        F.when(known, x)
        .when(event.isin("walk", "intent_walk"), WALK_VALUE)
        .when(event == "hit_by_pitch", HIT_BY_PITCH_VALUE)
        .otherwise(0.0)
    )
    out = terminal.groupBy(player).agg(
        F.count(F.lit(1)).alias("pas"), F.avg(worth).alias("__mean"), F.bool_or(known).alias("__known")
    )
    return out.select(player, "pas", F.when(F.col("__known"), round_half_up("__mean", 3)).alias("xwoba"))


def merge_partials(partials: DataFrame, keys: list[str], sums: list[str], latest: dict[str, str] | None = None,
                   chunk: str = "chunk") -> DataFrame:
    """Adds up partial results of several chunks; `latest` columns take the value of the last chunk naming one."""
    aggs = [F.sum(s).alias(s) for s in sums]
    for name, col in (latest or {}).items():
        given = blank_to_null(F.col(col))
        aggs.append(F.max_by(given, F.when(given.isNotNull(), F.struct(F.col(chunk), given))).alias(name))
    return partials.groupBy(*keys).agg(*aggs)


def classify_role(games_started, derived_starts=None, threshold: int = 10) -> Column:
    """Starter flag: a source's game starts win when positive, else the derived number counts."""
    gs = F.when(F.col(games_started) > 0, F.col(games_started))
    if derived_starts is not None:
        gs = F.coalesce(gs, F.col(derived_starts))
    return F.coalesce(gs, F.lit(0)) >= threshold
