"""Record linkage and gap filling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.names import name_key, parent_team_key
from statloom.functions.numeric import percent_repair
from statloom.operators.keys import lookup, pick_first
from statloom.session import cut

# Games of a block and players of a pack, at most on average; games that a player's run goes over.
GAMES_TOGETHER, PLAYERS_TOGETHER, GAMES_AT_ONCE = 262_144, 4_096, 64

# Fastball types in order of preference.
FASTBALL_PREFERENCE = ("FF", "SI", "FC")

# Name variants and the spelling they are joined under.
NAME_ALIASES = {
    "alex holtz": "alexander holtz", "alex alexeyev": "alexander alexeyev",
    "alex romanov": "alexander romanov", "alex nikishin": "alexander nikishin",
    "alex wennberg": "alexander wennberg", "alex carrier": "alexandre carrier",
    "alex texier": "alexandre texier", "alexei toropchenko": "alexey toropchenko",
    "evgeny dadonov": "evgenii dadonov", "matt dumba": "mathew dumba",
    "matt benning": "matthew benning", "cam atkinson": "cameron atkinson",
    "nick paul": "nicholas paul", "patrick maroon": "pat maroon",
    "emil martinsen lilleberg": "emil lilleberg", "frederick gaudreau": "frederic gaudreau",
    "jacob middleton": "jake middleton", "janis moser": "jj moser",
    "josh mahura": "joshua mahura", "maxwell crozier": "max crozier",
    "pierreolivier joseph": "po joseph", "thomas novak": "tommy novak",
    "william borgen": "will borgen", "zachary bolduc": "zack bolduc",
    "nicholas suzuki": "nick suzuki", "zachary werenski": "zach werenski",
    "christopher tanev": "chris tanev", "mitchell marner": "mitch marner",
    "samuel reinhart": "sam reinhart", "samuel bennett": "sam bennett",
    "nicholas robertson": "nick robertson", "nicholas jensen": "nick jensen",
    "timothy stutzle": "tim stutzle", "cameron york": "cam york",
    "alexander kerfoot": "alex kerfoot", "michael matheson": "mike matheson",
    "maxwell pacioretty": "max pacioretty", "callan foote": "cal foote",
}


def only_new_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right table cut to the keys and the columns the left table lacks."""
    return right.select(*keys, *[c for c in right.columns if c not in left.columns])


def shared_key(left: DataFrame, right: DataFrame, id_col: str = "player_id", name_col: str = "player_name") -> str | None:
    """Id if both tables carry it, else name, else none."""
    for k in (id_col, name_col):
        if k in left.columns and k in right.columns:
            return k
    return None


def join_sources(tables: list[DataFrame], how: str = "left") -> DataFrame:
    """Joins leaderboard tables one after another on id or name; a table adds only new columns.

    A table without a shared key is left out, as is one that adds nothing.
    """

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        key = shared_key(left, right)
        if key is None:
            return left
        fresh = only_new_columns(left, right, [key])
        return left if len(fresh.columns) < 2 else left.join(fresh, key, how)

    return reduce(step, tables)


def outer_join_with_name_fallback(left: DataFrame, right: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Full outer join on id; rows left over on both sides are then matched on the normalized name.

    Columns of both sides are kept, right ones only where new; the id is the one either side knows. Each side is written once, since
    several joins read it.
    """
    fresh = [c for c in right.columns if c not in left.columns]
    left = cut(left, "left-source")
    r = cut(right.select(F.col(id_col).alias("__rid"), F.col(name_col).alias("__rname"), *fresh), "right-source")
    known_l, known_r = left.filter(F.col(id_col).isNotNull()), r.filter(F.col("__rid").isNotNull())
    matched = known_l.join(r, F.col(id_col) == F.col("__rid"), "inner")
    rest_l = left.join(known_r.select("__rid").distinct(), F.col(id_col) == F.col("__rid"), "left_anti")
    rest_r = r.join(known_l.select(id_col).distinct(), F.col("__rid") == F.col(id_col), "left_anti")
    # a full join as left join plus anti join: unlike a full join, both can split a hot name, and missing names too
    named_l = rest_l.withColumn("__lk", F.nullif(name_key(name_col), F.lit("")))
    named_r = rest_r.withColumn("__rk", F.nullif(name_key("__rname"), F.lit("")))
    left_rows = named_l.join(
        named_r, (F.col("__lk") == F.col("__rk")) & (F.col(id_col).isNull() | F.col("__rid").isNull()), "left"
    )
    seen = named_l.select("__lk", F.col(id_col).isNull().alias("__open")).distinct()
    right_only = named_r.join(
        seen, (F.col("__rk") == F.col("__lk")) & (F.col("__rid").isNull() | F.col("__open")), "left_anti"
    )
    by_name = left_rows.drop("__lk", "__rk").unionByName(right_only.drop("__rk"), allowMissingColumns=True)
    both = matched.unionByName(by_name)
    return both.withColumns({
        id_col: F.coalesce(id_col, "__rid"), name_col: F.coalesce(name_col, "__rname"),
    }).drop("__rid", "__rname")


def join_situations(base: DataFrame, tables: dict[str, tuple[DataFrame | None, dict[str, str]]],
                    keys: list[str]) -> DataFrame:
    """Left joins one table per situation; {name: (table or None, {source column: target column})}.

    A missing table or column gives null columns.
    """
    out = base
    for table, columns in tables.values():
        if table is None:
            out = out.withColumns({t: F.lit(None).cast("double") for t in columns.values()})
            continue
        picked = table.select(*keys, *[
            (F.col(f"`{s}`").try_cast("double") if s in table.columns else F.lit(None).cast("double")).alias(t)
            for s, t in columns.items()
        ])
        out = out.join(picked, keys, "left")
    return out


def apply_aliases(df: DataFrame, name: str, aliases: DataFrame, variant: str = "variant", spelling: str = "spelling",
                  out: str | None = None) -> DataFrame:
    """Replaces name variants by the spelling of an alias table."""
    a = aliases.select(F.col(variant).alias(name), F.col(spelling).alias("__s"))
    return lookup(df, a, [name]).withColumn(out or name, F.coalesce("__s", name)).drop("__s")


def alias_table(spark) -> DataFrame:
    return spark.createDataFrame(list(NAME_ALIASES.items()), "variant string, spelling string")


def context_averages(context: DataFrame, metrics: list[str], weight: str, required: str) -> DataFrame:
    """Minutes-weighted context per (name_key, pos_group); weights below one count as one."""
    from statloom.operators.rates import weighted_means

    return weighted_means(context.filter(F.col(required).isNotNull()), ["name_key", "pos_group"], metrics, weight, floor=1.0)


def lookup_id_then_name(df: DataFrame, by_id: DataFrame, by_name: DataFrame, id_col: str, name_col: str,
                        value: str, others: list[str], style: str = "suffix") -> DataFrame:
    """Values by id; where that gives no positive `value`, all of them by normalized name."""
    cols = [value, *others]
    i = by_id.select(id_col, *[F.col(c).alias(f"__i_{c}") for c in cols])
    n = by_name.select(name_key(name_col, style).alias("__k"), *[F.col(c).alias(f"__n_{c}") for c in cols])
    n = pick_first(n.filter(F.col(f"__n_{value}") > 0), ["__k"], [F.desc(f"__n_{value}"), *[F.col(f"__n_{c}") for c in others]])
    out = lookup(lookup(df, i, [id_col]).withColumn("__k", name_key(name_col, style)), n, ["__k"])
    use_name = (F.coalesce(f"__i_{value}", F.lit(0)) <= 0) & (F.col(f"__n_{value}") > 0)
    out = out.withColumns({
        c: F.when(use_name, F.coalesce(f"__n_{c}", f"__i_{c}")).otherwise(F.col(f"__i_{c}")) for c in cols
    })
    return out.drop("__k", *[f"__i_{c}" for c in cols], *[f"__n_{c}" for c in cols])


def fuzzy_lookup(df: DataFrame, table: DataFrame, name: str, value: str, style: str = "token") -> DataFrame:
    """Value by exact name, else by normalized name (the first name in order among equals)."""
    t = table.select(F.col(name).alias("__n"), F.col(value).alias("__v"))
    exact = pick_first(t, ["__n"], [F.col("__v")]).select(F.col("__n").alias(name), F.col("__v").alias("__exact"))
    loose = pick_first(t.withColumn("__k", name_key("__n", style)), ["__k"], [F.col("__n"), F.col("__v")])
    out = lookup(df.withColumn("__k", name_key(name, style)), loose.select("__k", F.col("__v").alias("__loose")), ["__k"])
    out = lookup(out, exact, [name])
    return out.withColumn(value, F.coalesce("__exact", "__loose")).drop("__k", "__exact", "__loose")


def fill_gaps(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str],
              stored_as_share: set[str] = frozenset()) -> DataFrame:
    """Keeps what is there and takes the source's value only where the column is null or absent.

    Source values of share columns that were stored as percentages are divided by 100.
    """
    have = [c for c in columns if c in source.columns]
    s = source.select(*keys, *[F.col(c).alias(f"__s_{c}") for c in have])
    out = lookup(df, s, keys)
    filled = {}
    for c in columns:
        new = F.col(f"__s_{c}") if c in have else F.lit(None).cast("double")
        if c in stored_as_share:
            new = percent_repair(new)
        filled[c] = F.coalesce(F.col(c), new) if c in df.columns else new
    return out.withColumns(filled).drop(*[f"__s_{c}" for c in have])


def preferred_fastball(movement: DataFrame, player: str = "player_id", kind: str = "pitch_type",
                       velo: str = "velo", n: str = "n") -> DataFrame:
    """One row per player: four-seam before sinker before cutter, rows with a speed and a count only."""
    place = F
    for i, k in enumerate(FASTBALL_PREFERENCE):
        place = place.when(F.col(kind) == k, i)
    ok = movement.withColumn("__p", place).filter(
        F.col("__p").isNotNull() & F.col(velo).isNotNull() & F.col(n).isNotNull() & F.col(player).isNotNull()
    )
    return pick_first(ok, [player], [F.col("__p"), F.desc(n), F.col(velo)]).drop("__p")


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join that cannot add rows: the right side keeps its first row per key under the order."""
    return lookup(left, pick_first(right, keys, order), keys)


def semi(df: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(eligible.select(*keys).distinct(), keys, "left_semi")


def supplement(roster: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Roster plus the extra rows whose key the roster lacks, one row per key."""
    missing = extra.join(roster.select(*keys), keys, "left_anti")
    order = [F.col(c).asc_nulls_last() for c in missing.columns if c not in keys]
    return roster.unionByName(pick_first(missing, keys, order or [F.lit(0)]), allowMissingColumns=True)


def player_games(games: DataFrame, log: DataFrame, players: DataFrame) -> DataFrame:
    """(player_id, game_pk): games of the player's log; a player without a log gets the games of the team.

    Pairs of players and games are never moved or held: players of the same teams are packed, so are games of a block, and packs are joined, both of
    bounded size whatever the number of players of a team. The games of some teams are a set, so a game is there once. Pairs come out in runs of a player
    over a slice of games, which a writer packs well. Logged games are made distinct where the join has put them.
    """
    logged = log.select("player_id", "game_pk").join(games.select("game_pk"), "game_pk", "left_semi").distinct()
    teams = players.filter("team IS NOT NULL").groupBy("player_id").agg(F.array_sort(F.collect_set("team")).alias("__own"))
    unlogged = cut(teams.join(log.select("player_id").distinct(), "player_id", "left_anti"), "unlogged")
    rosters = cut(unlogged.select("__own").distinct(), "rosters").withColumn("team", F.explode("__own"))
    blocks, packs = max(1, math.ceil(games.count() / GAMES_TOGETHER)), max(1, math.ceil(unlogged.count() / PLAYERS_TOGETHER))
    sides = games.select("game_pk", F.explode(F.array("away", "home")).alias("team")).join(rosters, "team")
    held = sides.groupBy("__own", F.pmod(F.xxhash64("game_pk"), F.lit(blocks)).alias("__block")).agg(
        F.collect_set("game_pk").alias("__games"), F.bool_or(F.col("game_pk").isNull()).alias("__unnamed"))
    held = held.withColumn("__games", F.when(F.col("__unnamed"), F.concat("__games", F.array(F.lit(None)))).otherwise(F.col("__games")))
    mine = unlogged.groupBy("__own", F.pmod(F.xxhash64("player_id"), F.lit(packs))).agg(F.collect_list(F.struct("player_id")).alias("__players"))
    mine = mine.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    # the planner knows neither how many blocks a pack goes to nor how many pairs come of two packs: it would broadcast, or join in one task
    parts = max(games.sparkSession.sparkContext.defaultParallelism, 4 * blocks)
    mine, held = (side.repartition(parts, "__own", "__block") for side in (mine, held))
    both = mine.join(held.hint("merge"), ["__own", "__block"])
    slices = F.transform(F.sequence(F.lit(1), F.size("__games"), F.lit(GAMES_AT_ONCE)), lambda i: F.slice("__games", i, GAMES_AT_ONCE))
    both = both.select("__players", F.explode_outer(slices).alias("__some")).select("__some", F.explode_outer("__players").alias("__player"))
    by_team = both.select("__player.player_id", F.explode_outer("__some").alias("game_pk"))
    return logged.select("player_id", "game_pk").unionByName(by_team)


def with_slot_and_drag(pitches: DataFrame, slots: DataFrame, drags: DataFrame) -> DataFrame:
    """Movement relative to what the arm slot predicts, and drag relative to speed and spin."""
    s = slots.select("pitch_type", "p_throws", "slope_x", "intercept_x", "slope_z", "intercept_z")
    d = drags.select("pitch_type", F.col("intercept").alias("__i"), F.col("slope_velo").alias("__v"),
                     F.col("slope_spin").alias("__w"))
    out = lookup(lookup(pitches, s, ["pitch_type", "p_throws"]), d, ["pitch_type"])
    expected_drag = F.col("__i") + F.col("__v") * F.col("release_speed") + F.col("__w") * F.col("release_spin_rate")
    return out.withColumns({
        "pfx_x_dev_from_slot": F.col("arm_side_break") - (F.col("slope_x") * F.col("arm_angle") + F.col("intercept_x")),
        "pfx_z_dev_from_slot": F.col("pfx_z") - (F.col("slope_z") * F.col("arm_angle") + F.col("intercept_z")),
        "ay_residual": F.when(F.col("__i").isNull(), 0.0).otherwise(F.col("ay") - expected_drag),
    }).drop("slope_x", "intercept_x", "slope_z", "intercept_z", "__i", "__v", "__w")


def with_arm_angles(pitches: DataFrame, baselines: DataFrame) -> DataFrame:
    """Arm angle of the pitch, else the pitcher's usual one, with the deviation between them.

    The deviation is 0 for a pitch without an own angle and null for a pitcher without a usual one.
    """
    b = baselines.select("pitcher", F.col("arm_angle").alias("__usual"), "arm_angle_std")
    out = lookup(pitches, b, ["pitcher"])
    dev = F.when(F.col("__usual").isNotNull(), F.coalesce(F.col("arm_angle") - F.col("__usual"), F.lit(0.0)))
    return out.withColumns({"arm_angle_dev": dev, "arm_angle": F.coalesce("arm_angle", "__usual")}).drop("__usual")


def prefer_group_mean(df: DataFrame, means: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Takes the group's mean where there is one, else keeps the row's own value."""
    m = means.select(*keys, F.col(column).alias("__m"))
    return lookup(df, m, keys).withColumn(column, F.coalesce("__m", column)).drop("__m")


def value_by_priority(players: DataFrame, game: DataFrame, bulk: DataFrame, prospects: DataFrame,
                      id_col: str = "player_id", value: str = "xwoba") -> DataFrame:
    """Expected value per player: game rows, then the season table, then the prospect table by name and season.

    The first two describe the top level only and are not used for players below it.
    """
    g = game.select(id_col, F.col(value).alias("__g"))
    b = bulk.select(id_col, F.col(value).alias("__b"))
    p = prospects.withColumn("__k", name_key("name", "token")).select("__k", "season", "name", F.col(value).alias("__p"))
    p = pick_first(p, ["__k", "season"], [F.col("name"), F.col("__p")]).drop("name")
    out = lookup(lookup(players, g, [id_col]), b, [id_col]).withColumn("__k", name_key("name", "token"))
    out = lookup(out, p, ["__k", "season"])
    top = F.col("level") != "AAA"
    from statloom.functions.numeric import round_half_up

    return out.withColumn(
        value, F.coalesce(F.when(top, F.col("__g")), F.when(top, round_half_up("__b", 3)), F.col("__p"))
    ).drop("__g", "__b", "__p", "__k")


def situation_columns(df: DataFrame, keys: list[str], situation: str, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """Long-by-situation to one row per key in one pass: {situation: {name: row expression}}."""
    aggs = [
        F.max(F.when(F.col(situation) == s, c)).alias(n) for s, cols in parts.items() for n, c in cols.items()
    ]
    return df.groupBy(*keys).agg(*aggs)


def compare_pairs(board: DataFrame, pairs: DataFrame, id_col: str, value: str) -> DataFrame:
    """Requested pairs with both values, relative speed (slower value over own) and the winner (lower value)."""
    one = board.select(F.col(id_col).alias("a"), F.col(value).alias("a_value"))
    two = board.select(F.col(id_col).alias("b"), F.col(value).alias("b_value"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    slow = F.greatest("a_value", "b_value")
    return both.withColumns({
        "a_speed": slow / F.col("a_value"), "b_speed": slow / F.col("b_value"),
        "winner": F.when(F.col("a_value") < F.col("b_value"), F.col("a"))
        .when(F.col("b_value") < F.col("a_value"), F.col("b")),
    })


def remap_teams(df: DataFrame, team_name: str, clubs: DataFrame) -> DataFrame:
    """Prospect squads under their parent club's id, short name and name; other teams unchanged.

    clubs has club_id, club_abbr, club_name and may list a club under several names.
    """
    c = pick_first(clubs.withColumn("__k", F.lower("club_name")), ["__k"], [F.col("club_id")])
    return lookup(df.withColumn("__k", parent_team_key(team_name)), c, ["__k"]).drop("__k")
