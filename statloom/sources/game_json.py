"""Nested game documents: play-by-play, box scores, schedules, rosters, stat leaders, grade maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import as_col
from statloom.functions.buckets import SWING_CODES, WHIFF_CODES
from statloom.functions.dates import innings_to_outs
from statloom.functions.physics import approach_angle_at_plate
from statloom.operators.keys import lookup

_PLAY = """atBatIndex: INT,
  result: STRUCT<type: STRING, event: STRING>,
  matchup: STRUCT<pitcher: STRUCT<id: BIGINT>, batter: STRUCT<id: BIGINT>, batSide: STRUCT<code: STRING>>"""
_RUNNERS = """runners: ARRAY<STRUCT<
    movement: STRUCT<isOut: BOOLEAN, `end`: STRING>,
    details: STRUCT<responsiblePitcher: STRUCT<id: BIGINT>, isEarned: BOOLEAN, earned: BOOLEAN>>>"""
_PLAY_EVENTS = """playEvents: ARRAY<STRUCT<
    isPitch: BOOLEAN, pitchNumber: INT, count: STRUCT<balls: INT, strikes: INT>,
    details: STRUCT<type: STRUCT<code: STRING, description: STRING>, call: STRUCT<code: STRING>,
                    isStrike: BOOLEAN, isInPlay: BOOLEAN>,
    pitchData: STRUCT<startSpeed: DOUBLE, extension: DOUBLE, strikeZoneTop: DOUBLE, strikeZoneBottom: DOUBLE,
      breaks: STRUCT<spinRate: DOUBLE, spinDirection: DOUBLE, breakHorizontal: DOUBLE, breakVerticalInduced: DOUBLE>,
      coordinates: STRUCT<pX: DOUBLE, pZ: DOUBLE, x0: DOUBLE, z0: DOUBLE, vX0: DOUBLE, vY0: DOUBLE, vZ0: DOUBLE,
                          aX: DOUBLE, aY: DOUBLE, aZ: DOUBLE, pfxX: DOUBLE, pfxZ: DOUBLE>>,
    hitData: STRUCT<launchSpeed: DOUBLE, launchAngle: DOUBLE, coordinates: STRUCT<coordX: DOUBLE, coordY: DOUBLE>>>>"""
PLAYS_SCHEMA = f"allPlays ARRAY<STRUCT<{_PLAY}, {_RUNNERS}, {_PLAY_EVENTS}>>"
# What pitches and pitching_lines read; the parser skips the rest of the text.
PITCHES_SCHEMA = f"allPlays ARRAY<STRUCT<{_PLAY}, {_PLAY_EVENTS}>>"
LINES_SCHEMA = f"allPlays ARRAY<STRUCT<{_PLAY}, {_RUNNERS}>>"

_TEAM_SIDE = """STRUCT<team: STRUCT<id: BIGINT, abbreviation: STRING, teamName: STRING>,
  players: MAP<STRING, STRUCT<person: STRUCT<id: BIGINT, fullName: STRING>,
    position: STRUCT<abbreviation: STRING, type: STRING>,
    stats: STRUCT<
      pitching: STRUCT<inningsPitched: STRING, hits: INT, runs: INT, earnedRuns: INT, strikeOuts: INT, baseOnBalls: INT,
                       hitBatsmen: INT, hitByPitch: INT, homeRuns: INT, battersFaced: INT, pitchesThrown: INT>,
      batting: STRUCT<plateAppearances: INT, atBats: INT, hits: INT, doubles: INT, triples: INT, homeRuns: INT,
                      baseOnBalls: INT, hitByPitch: INT, sacFlies: INT>>>>>"""
BOX_SCHEMA = f"teams STRUCT<away: {_TEAM_SIDE}, home: {_TEAM_SIDE}>"

_SCHEDULE_SIDE = "STRUCT<score: INT, team: STRUCT<id: BIGINT, name: STRING, teamName: STRING, abbreviation: STRING>>"
SCHEDULE_SCHEMA = f"""dates ARRAY<STRUCT<date: STRING, games: ARRAY<STRUCT<
  gamePk: BIGINT, status: STRUCT<abstractGameState: STRING, detailedState: STRING>,
  teams: STRUCT<away: {_SCHEDULE_SIDE}, home: {_SCHEDULE_SIDE}>>>>>"""

ROSTER_SCHEMA = """roster ARRAY<STRUCT<person: STRUCT<id: BIGINT, fullName: STRING>,
  position: STRUCT<type: STRING, abbreviation: STRING>>>"""

LEADERS_SCHEMA = """stats ARRAY<STRUCT<splits: ARRAY<STRUCT<
  player: STRUCT<id: BIGINT, fullName: STRING>, team: STRUCT<id: BIGINT, abbreviation: STRING>,
  position: STRUCT<abbreviation: STRING>>>>>"""

GRADES_SCHEMA = "MAP<STRING, MAP<STRING, STRUCT<n: BIGINT, xRV: DOUBLE, stuff: DOUBLE, loc: DOUBLE, tun: DOUBLE>>>"


def parse(documents: DataFrame, text: str, schema: str, keep: list[str]) -> DataFrame:
    """Document text to its nested columns beside the columns to keep."""
    return documents.select(*keep, F.from_json(F.col(text), schema).alias("__d")).select(*keep, "__d.*")


def plays(documents: DataFrame, keep: list[str]) -> DataFrame:
    """One row per play.

    Outer explodes are used on parsed documents: a plain one adds a size filter that parses the text again.
    """
    return documents.select(*keep, F.explode_outer("allPlays").alias("play")).filter(F.col("play").isNotNull())


def _counts(events: Column, field: str) -> Column:
    """The count given after each event, null on events that are no tracked pitch."""
    return F.transform(events, lambda e: F.when(e["isPitch"] & e["pitchData"].isNotNull(), e["count"][field]))


def _known_before(counts: Column, position: Column) -> Column:
    """Last count given on earlier pitches of the same play, 0 before the first."""
    return F.coalesce(F.get(F.reverse(F.array_compact(F.slice(counts, 1, position))), F.lit(0)), F.lit(0))


def pitches(play_rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per tracked pitch, with the count before it and the approach angle."""
    p = F.col("play")
    ev = play_rows.select(
        *keep, p["atBatIndex"].alias("at_bat_index"), p["matchup"]["pitcher"]["id"].alias("pitcher"),
        p["matchup"]["batter"]["id"].alias("batter"), p["matchup"]["batSide"]["code"].alias("bat_side"),
        p["result"]["event"].alias("result"),
        _counts(p["playEvents"], "balls").alias("__balls"), _counts(p["playEvents"], "strikes").alias("__strikes"),
        F.posexplode_outer(p["playEvents"]).alias("__pos", "e"),
    ).filter(F.col("e.isPitch") & F.col("e.pitchData").isNotNull())
    d, c = F.col("e.pitchData"), F.col("e.pitchData.coordinates")
    code = F.col("e.details.call.code")
    out = ev.select(
        *keep, "at_bat_index", "pitcher", "batter", "bat_side", "result",
        F.col("e.pitchNumber").alias("pitch_number"),
        F.coalesce("e.details.type.code", F.lit("UN")).alias("pitch_type"),
        F.coalesce("e.details.type.description", F.lit("Unknown")).alias("pitch_name"),
        d["startSpeed"].alias("velo"), d["breaks"]["spinRate"].alias("spin"),
        d["breaks"]["spinDirection"].alias("spin_direction"),
        d["breaks"]["breakHorizontal"].alias("h_break"), d["breaks"]["breakVerticalInduced"].alias("v_break"),
        c["pfxX"].alias("pfx_x_raw"), c["pfxZ"].alias("pfx_z_raw"), c["pX"].alias("plate_x"), c["pZ"].alias("plate_z"),
        d["strikeZoneTop"].alias("sz_top"), d["strikeZoneBottom"].alias("sz_bot"),
        c["x0"].alias("release_pos_x"), c["z0"].alias("release_pos_z"), d["extension"].alias("release_extension"),
        c["vX0"].alias("vx0"), c["vY0"].alias("vy0"), c["vZ0"].alias("vz0"),
        c["aX"].alias("ax"), c["aY"].alias("ay"), c["aZ"].alias("az"),
        _known_before(F.col("__balls"), F.col("__pos")).alias("balls"),
        _known_before(F.col("__strikes"), F.col("__pos")).alias("strikes"),
        F.col("e.details.isStrike").alias("is_strike"), F.col("e.details.isInPlay").alias("is_in_play"),
        F.coalesce(code.isin(*WHIFF_CODES), F.lit(False)).alias("is_whiff"),
        F.coalesce(code.isin(*SWING_CODES), F.lit(False)).alias("is_swing"),
        code.alias("call_code"),
        F.col("e.hitData.launchSpeed").alias("launch_speed"), F.col("e.hitData.launchAngle").alias("launch_angle"),
        F.col("e.hitData.coordinates.coordX").alias("hit_x"), F.col("e.hitData.coordinates.coordY").alias("hit_y"),
    )
    return out.withColumn(
        "vaa", approach_angle_at_plate("vy0", "vz0", "ay", "az", "plate_z", "release_pos_z", "release_extension")
    )


def pitching_lines(play_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Outs and runs from runner movements, strikeouts and so on from plate appearances, per key and pitcher.

    A run is charged to the responsible pitcher when that is the pitcher of the play. Movements are counted inside their play, so a document is
    parsed once and plays go through one aggregation.
    """
    from statloom.operators.rates import HIT_BASES, STRIKEOUT_EVENTS, WALK_EVENTS

    p = F.col("play")

    def charged(m):
        responsible = F.coalesce(m["details"]["responsiblePitcher"]["id"], F.col("pitcher"))
        return (m["movement"]["end"] == "score") & (responsible == F.col("pitcher"))

    def earned(m):
        return F.coalesce(m["details"]["isEarned"], F.lit(False)) | F.coalesce(m["details"]["earned"], F.lit(False))

    def moves(cond):
        return F.coalesce(F.sum(F.array_size(F.filter("runners", cond))), F.lit(0))

    base = play_rows.select(
        *keys, p["matchup"]["pitcher"]["id"].alias("pitcher"), p["result"].alias("r"), p["runners"].alias("runners")
    )
    e = F.col("r.event")
    return base.groupBy(*keys, "pitcher").agg(
        F.count_if(F.col("r.type") == "atBat").alias("bf"),
        *[F.count_if((F.col("r.type") == "atBat") & cond).alias(n) for n, cond in {
            "k": e.isin(*STRIKEOUT_EVENTS), "bb": e.isin(*WALK_EVENTS), "hbp": e == "Hit By Pitch",
            "h": e.isin(*HIT_BASES), "hr": e == "Home Run",
        }.items()],
        moves(lambda m: m["movement"]["isOut"]).alias("outs"), moves(charged).alias("runs"), moves(lambda m: charged(m) & earned(m)).alias("er"),
    )


def box_players(documents: DataFrame, keep: list[str]) -> DataFrame:
    """One row per game, side and player."""
    sides = documents.select(*keep, F.explode(F.array(
        F.struct(F.lit("away").alias("side"), F.col("teams.away").alias("t")),
        F.struct(F.lit("home").alias("side"), F.col("teams.home").alias("t")),
    )).alias("s"))
    rows = sides.select(*keep, F.col("s.side").alias("side"), F.col("s.t.team").alias("team"),
                        F.explode_outer("s.t.players").alias("tag", "p")).filter(F.col("tag").isNotNull())
    return rows.select(
        *keep, "side", F.col("team.id").alias("team_id"), F.col("team.abbreviation").alias("team"),
        F.col("p.person.id").alias("player_id"), F.col("p.person.fullName").alias("name"),
        F.col("p.position.abbreviation").alias("position"), F.col("p.stats.pitching").alias("pitching"),
        F.col("p.stats.batting").alias("batting"),
    )


def played_roles(players: DataFrame) -> DataFrame:
    """Which of the two roles a player filled in the game."""
    pitched = (F.coalesce("pitching.pitchesThrown", F.lit(0)) >= 1) | F.coalesce(
        F.col("pitching.inningsPitched") != "0.0", F.lit(False)
    )
    batted = (F.coalesce("batting.atBats", F.lit(0)) >= 1) | (F.coalesce("batting.plateAppearances", F.lit(0)) >= 1)
    roles = F.filter(
        F.array(F.when(pitched, F.lit("pitcher")), F.when(batted, F.lit("hitter"))), lambda r: r.isNotNull()
    )
    return players.withColumn("role", F.explode(roles))


def box_pitching(players: DataFrame, keys: list[str]) -> DataFrame:
    """Official pitching line per key and player, for players with innings."""
    return players.filter(F.col("pitching.inningsPitched").isNotNull()).select(
        *keys, F.col("player_id").alias("pitcher"), innings_to_outs("pitching.inningsPitched").alias("outs"),
        *[F.coalesce(f"pitching.{s}", F.lit(0)).alias(n) for s, n in {
            "hits": "h", "runs": "runs", "earnedRuns": "er", "strikeOuts": "k", "baseOnBalls": "bb",
            "homeRuns": "hr", "battersFaced": "bf"}.items()],
        F.coalesce("pitching.hitBatsmen", "pitching.hitByPitch", F.lit(0)).alias("hbp"),
    )


def box_batting(players: DataFrame, keys: list[str]) -> DataFrame:
    from statloom.operators.rates import total_bases

    b = players.filter(F.col("batting.plateAppearances").isNotNull()).select(
        *keys, F.col("player_id").alias("batter"),
        *[F.coalesce(f"batting.{s}", F.lit(0)).alias(n) for s, n in {
            "plateAppearances": "pa", "atBats": "ab", "hits": "h", "doubles": "d2", "triples": "d3", "homeRuns": "hr",
            "baseOnBalls": "bb", "hitByPitch": "hbp", "sacFlies": "sf"}.items()],
    )
    return b.withColumn("tb", total_bases("h", "d2", "d3", "hr")).drop("d2", "d3")


def schedule_games(documents: DataFrame, keep: list[str], club_ids: DataFrame) -> DataFrame:
    """One row per scheduled game; exhibition when a league club meets a team from outside it."""
    g = documents.select(*keep, F.explode_outer("dates").alias("d")).select(
        *keep, F.to_date("d.date").alias("date"), F.explode_outer("d.games").alias("g")
    ).filter(F.col("g").isNotNull())
    state, detail = F.col("g.status.abstractGameState"), F.col("g.status.detailedState")
    flat = g.select(
        *keep, F.col("g.gamePk").alias("game_pk"), "date", detail.alias("status"),
        (F.coalesce(state == "Live", F.lit(False)) | F.coalesce(detail == "In Progress", F.lit(False))).alias("is_live"),
        F.col("g.teams.away.team.id").alias("away_id"), F.col("g.teams.away.team.name").alias("away"),
        F.col("g.teams.home.team.id").alias("home_id"), F.col("g.teams.home.team.name").alias("home"),
        F.col("g.teams.away.score").alias("away_score"), F.col("g.teams.home.score").alias("home_score"),
    )
    clubs = club_ids.select("club_id").distinct().withColumn("__c", F.lit(True))
    a = clubs.select(F.col("club_id").alias("away_id"), F.col("__c").alias("__a"))
    h = clubs.select(F.col("club_id").alias("home_id"), F.col("__c").alias("__h"))
    out = lookup(lookup(flat, a, ["away_id"]), h, ["home_id"])
    both = F.coalesce("__a", F.lit(False)) | F.coalesce("__h", F.lit(False))
    return out.withColumn("is_exhibition", both).drop("__a", "__h")


def roster_players(documents: DataFrame, keep: list[str], pitchers: bool | None = None) -> DataFrame:
    """One row per roster place; only pitchers or only others when asked."""
    out = documents.select(*keep, F.explode_outer("roster").alias("r")).filter(F.col("r").isNotNull()).select(
        *keep, F.col("r.person.id").alias("player_id"), F.col("r.person.fullName").alias("name"),
        F.col("r.position.type").alias("position_type"),
    )
    if pitchers is None:
        return out
    is_pitcher = F.coalesce(F.col("position_type") == "Pitcher", F.lit(False))
    return out.filter(is_pitcher if pitchers else ~is_pitcher)


def leader_players(documents: DataFrame, group: str, page: str) -> DataFrame:
    """First row per player in each group, in page order."""
    from statloom.operators.keys import pick_first

    rows = documents.select(group, page, F.posexplode_outer(F.flatten(F.transform("stats", lambda s: s["splits"]))).alias("i", "s"))
    flat = rows.select(
        group, page, "i", F.col("s.player.id").alias("player_id"), F.col("s.player.fullName").alias("name"),
        F.coalesce("s.team.abbreviation", F.lit("")).alias("team"), F.col("s.position.abbreviation").alias("position"),
    ).filter(F.col("player_id").isNotNull())
    return pick_first(flat, [group, "player_id"], [F.col(page), F.col("i")]).drop(page, "i")


def grade_rows(documents: DataFrame, text: str) -> DataFrame:
    """{pitcher: {type: grades}} documents to rows."""
    m = documents.select(F.from_json(F.col(text), GRADES_SCHEMA).alias("m"))
    per = m.select(F.explode_outer("m").alias("pitcher", "t")).select("pitcher", F.explode_outer("t").alias("pitch_type", "g"))
    per = per.filter(F.col("g").isNotNull())
    return per.select(F.col("pitcher").try_cast("bigint").alias("pitcher"), "pitch_type", "g.*")


def playlist(documents: DataFrame, text: str, keep: list[str], schema: str = PLAYS_SCHEMA) -> DataFrame:
    """Play-by-play text straight to play rows."""
    return plays(parse(documents, text, schema, keep), keep)


def as_json(c) -> Column:
    return F.to_json(as_col(c))
