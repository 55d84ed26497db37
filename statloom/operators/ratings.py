"""Composite ratings of skaters and goalies and their multi-season blends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.curve import stretch_percentile
from statloom.functions.names import name_key
from statloom.functions.numeric import clip, safe_ratio, weighted_mean_present
from statloom.operators.keys import lookup, with_group_stats, with_table_stats
from statloom.operators.norms import deployment_factor, zone_start_share
from statloom.operators.ranks import percentile_ranks_wide
from statloom.operators.rates import share_of_total, weighted_means
from statloom.session import cut

# Category weights.
SKATER_WEIGHTS = {
    "offense": 0.275, "defense": 0.215, "production": 0.20, "power_play": 0.055,
    "penalty_kill": 0.055, "penalties": 0.05, "competition": 0.075, "teammates": 0.075,
}
GOALIE_WEIGHTS = {
    "ev5": 0.400, "pk": 0.075, "high": 0.1875, "medium": 0.125, "low": 0.0625, "rebound": 0.05, "ice_time": 0.10,
}
SEASON_WEIGHTS = {2025: 0.53, 2024: 0.31, 2023: 0.16}

# Columns moved by the teammate adjustment.
ATTACK_COLUMNS = (
    "onice_xgf_per60", "ev5_xg_per60", "onice_gf_per60", "hdcf_per60",
    "onice_cf_per60", "onice_ff_per60", "rel_xgf_per60", "rel_gf_per60",
)
DEFENCE_COLUMNS = ("onice_xga_per60", "onice_ga_per60", "hdca_per60", "onice_ca_per60", "rel_xga_per60")

# Weights of percentiles in each category, per position group.
# A leading minus means that a low value is good. "finishing" and "saves" are shot and save percent on ice,
# "opponents" the defensive quality of opponents, "matchups" their overall quality: 50 when unknown.
CATEGORY_TERMS = {
    "offense": {
        "F": {"onice_xgf_per60": 0.24, "ev5_xg_per60": 0.07, "hdcf_per60": 0.10, "onice_cf_per60": 0.05,
              "onice_ff_per60": 0.05, "rel_xgf_per60": 0.30, "onice_gf_per60": 0.04, "rel_gf_per60": 0.05,
              "opponents": 0.10},
        "D": {"onice_xgf_per60": 0.27, "hdcf_per60": 0.12, "onice_cf_per60": 0.08, "onice_ff_per60": 0.08,
              "rel_xgf_per60": 0.29, "onice_gf_per60": 0.04, "rel_gf_per60": 0.02, "opponents": 0.10},
    },
    "defense": {
        "F": {"-onice_xga_per60": 0.28, "-hdca_per60": 0.12, "-onice_ca_per60": 0.05, "matchups": 0.10,
              "ev5_tk_per60": 0.05, "saves": 0.05, "-onice_ga_per60": 0.05, "-rel_xga_per60": 0.30},
        "D": {"-onice_xga_per60": 0.28, "-hdca_per60": 0.10, "-onice_ca_per60": 0.05, "matchups": 0.10,
              "ev5_blk_per60": 0.03, "ev5_tk_per60": 0.04, "saves": 0.05, "-onice_ga_per60": 0.05,
              "-rel_xga_per60": 0.30},
    },
    "production": {
        "F": {"all_g_per60": 0.55, "all_pa_per60": 0.30, "all_sa_per60": 0.15},
        "D": {"all_g_per60": 0.30, "all_pa_per60": 0.40, "all_sa_per60": 0.30},
    },
    "teammates": dict.fromkeys("FD", {"ev_toi_per_gp": 0.50, "pp_toi_per_gp": 0.25, "pk_toi_per_gp": 0.25}),
    "power_play": dict.fromkeys("FD", {
        "pp_g_per60": 0.50 * 3 / 7, "pp_pa_per60": 0.30 * 3 / 7, "pp_sa_per60": 0.20 * 3 / 7,
        "pp_onice_xgf_per60": 1 / 7, "pp_onice_gf_per60": 1 / 7, "pp_onice_hdcf_per60": 1 / 7, "pp_toi_per_gp": 1 / 7,
    }),
    "penalty_kill": dict.fromkeys("FD", {
        "-pk_onice_xga_per60": 0.30, "pk_toi_per_gp": 0.25, "-pk_onice_hdca_per60": 0.18,
        "pk_blk_per60": 0.12, "pk_tk_per60": 0.08, "-pk_onice_ca_per60": 0.07,
    }),
}
QUALITY_COLUMNS = ("qoc_rapm_xg", "qoc_off_xgar", "qoc_def_xgar")
TEAMMATE_COLUMNS = (
    "qot_rapm_xg", "qot_off_xgar", "qot_def_xgar", "qot_rapm_xgf", "qot_rapm_xga", "qot_rapm_cf", "qot_rapm_ca",
)
CATEGORIES = list(SKATER_WEIGHTS)


def rated_metrics() -> list[str]:
    named = {m.lstrip("-") for c in CATEGORY_TERMS.values() for g in c.values() for m in g}
    named -= {"opponents", "matchups", "saves"}
    return sorted(named | {"onice_sv_pct", "penalty_ratio", "dz_shift_pct", *QUALITY_COLUMNS})


def penalty_ratio(taken: str = "all_pim_per60", drawn: str = "all_pen_drawn_per60") -> Column:
    t, d = F.col(taken), F.col(drawn)
    return F.when(d > 0, t / d).when(t > 0, t * 10)


def skater_shares(df: DataFrame) -> DataFrame:
    """Zone starts, minutes per game and the special-teams flags."""
    gp = F.when(F.col("gp").isNotNull(), F.greatest(F.col("gp"), F.lit(1)))
    zones = ["cnt_dz", "cnt_oz", "cnt_nz"]
    pp, pk = F.coalesce("toi_min_pp", F.lit(0.0)), F.coalesce("toi_min_pk", F.lit(0.0))
    out = df.withColumns({
        "penalty_ratio": penalty_ratio(),
        "dz_shift_pct": zone_start_share("cnt_dz", zones),
        "oz_shift_pct": zone_start_share("cnt_oz", zones),
        "ev_toi_per_gp": F.col("toi_min") / gp,
        "pp_toi_per_gp": pp / gp,
        "pk_toi_per_gp": pk / gp,
    })
    return out.withColumns({
        "has_pp": F.coalesce((pp > 0) & (F.col("pp_toi_per_gp") >= 1), F.lit(False)),
        "has_pk": F.coalesce((pk > 0) & (F.col("pk_toi_per_gp") >= 1), F.lit(False)),
    })


def skater_weights(df: DataFrame) -> DataFrame:
    """w_<category> per player: zone deployment shifts offense and defense, special-teams time moves its pool."""
    d = deployment_factor(df, "oz_shift_pct", "pos_group")
    d = with_table_stats(
        d, __pp=F.avg(F.when(F.col("has_pp"), F.col("pp_toi_per_gp"))),
        __pk=F.avg(F.when(F.col("has_pk"), F.col("pk_toi_per_gp"))),
    )

    def claim(flag, minutes):
        return F.when(F.col(flag), F.col(minutes)).otherwise(0.0)

    def ratio(flag, minutes, mean):
        return F.when(F.col(flag) & (F.col(mean) > 0), F.least(F.col(minutes) / F.col(mean), F.lit(1.0))).otherwise(0.0)

    pp, pk = claim("has_pp", "pp_toi_per_gp"), claim("has_pk", "pk_toi_per_gp")
    pool = SKATER_WEIGHTS["power_play"] + SKATER_WEIGHTS["penalty_kill"]
    d = d.withColumns({
        "w_power_play": pool * F.coalesce(safe_ratio(pp, pp + pk), F.lit(0.0)) * ratio("has_pp", "pp_toi_per_gp", "__pp"),
        "w_penalty_kill": pool * F.coalesce(safe_ratio(pk, pp + pk), F.lit(0.0)) * ratio("has_pk", "pk_toi_per_gp", "__pk"),
    })
    left = F.lit(pool) - F.col("w_power_play") - F.col("w_penalty_kill")
    shift = F.col("deployment_factor")
    to_offense = left * (F.lit(0.5) + shift * 0.5)
    fixed = {f"w_{c}": F.lit(SKATER_WEIGHTS[c]) for c in ("production", "penalties", "competition", "teammates")}
    return d.withColumns({
        "w_offense": F.lit(SKATER_WEIGHTS["offense"]) + shift * 0.05 + to_offense,
        "w_defense": F.lit(SKATER_WEIGHTS["defense"]) - shift * 0.05 + (left - to_offense),
        **fixed,
    }).drop("__pp", "__pk")


def teammate_adjustment(df: DataFrame, id_col: str = "player_id") -> DataFrame:
    """Shifts attack and defence columns against the strength of a player's teammates."""
    ranks = percentile_ranks_wide(df, [id_col], ["pos_group"], list(TEAMMATE_COLUMNS), "t_")
    r = lookup(df, ranks, [id_col])

    def pct(c, invert=False):
        p = (F.lit(1) - F.col(f"t_{c}")) if invert else F.col(f"t_{c}")
        return F.when(F.col(c).isNotNull(), p * 100)

    plain = F.coalesce(pct("qot_rapm_xg"), F.lit(50.0))
    w = [F.lit(0.40), F.lit(0.20), F.lit(0.40)]
    attack = weighted_mean_present([pct("qot_rapm_xgf"), pct("qot_rapm_cf"), pct("qot_off_xgar")], w)
    defend = weighted_mean_present([pct("qot_rapm_xga", True), pct("qot_rapm_ca", True), pct("qot_def_xgar")], w)
    r = r.withColumns({"__a": F.coalesce(attack, plain), "__d": F.coalesce(defend, plain)})
    moved = [*ATTACK_COLUMNS, *DEFENCE_COLUMNS]
    g = with_group_stats(
        r, ["pos_group"], __am=F.avg("__a"), __as=F.stddev_pop("__a"), __dm=F.avg("__d"), __ds=F.stddev_pop("__d"),
        **{f"__s_{c}": F.stddev_samp(c) for c in moved},
    )

    def factor(v, m, s):
        return clip((F.col(v) - F.col(m)) / F.greatest(F.col(s), F.lit(1.0)) * -0.5, -0.65, 0.65)

    a, d = factor("__a", "__am", "__as"), factor("__d", "__dm", "__ds")
    shifted = {c: F.col(c) + a * F.greatest(F.col(f"__s_{c}"), F.lit(0.01)) for c in ATTACK_COLUMNS}
    shifted |= {c: F.col(c) - d * F.greatest(F.col(f"__s_{c}"), F.lit(0.01)) for c in DEFENCE_COLUMNS}
    return g.withColumns(shifted).select(*df.columns)


def category_scores(df: DataFrame, id_col: str = "player_id") -> DataFrame:
    """cat_<category> on the stretched percentile scale, ranked within the position group."""
    ranks = percentile_ranks_wide(df, [id_col], ["pos_group"], rated_metrics(), "p_")
    r = lookup(df, ranks, [id_col])

    def pct(m):
        return F.col(f"p_{m}") * 100

    def known(m, otherwise, invert=False):
        p = (F.lit(1) - F.col(f"p_{m}")) * 100 if invert else pct(m)
        return F.when(F.col(m).isNotNull(), p).otherwise(otherwise)

    half = F.lit(50.0)
    special = {
        "saves": known("onice_sv_pct", half, invert=True),
        "matchups": known("qoc_rapm_xg", half),
        "opponents": known("qoc_def_xgar", known("qoc_rapm_xg", half)),
    }

    def term(name):
        if name in special:
            return special[name]
        if name.startswith("-"):
            return (F.lit(1) - F.col(f"p_{name[1:]}")) * 100
        return pct(name)

    def weighted(terms):
        return reduce(lambda x, y: x + y, [term(m) * w for m, w in terms.items()])

    raw = {
        c: F.when(F.col("pos_group") == "D", weighted(g["D"])).otherwise(weighted(g["F"]))
        for c, g in CATEGORY_TERMS.items()
    }
    raw["power_play"] = F.when(F.col("has_pp"), raw["power_play"])
    raw["penalty_kill"] = F.when(F.col("has_pk"), raw["penalty_kill"])
    main = known("qoc_rapm_xg", F.lit(None))
    raw["competition"] = (
        main * 0.4 + pct("dz_shift_pct") * 0.2 + known("qoc_off_xgar", main) * 0.2 + known("qoc_def_xgar", main) * 0.2
    )
    names = [c for c in CATEGORIES if c != "penalties"]
    r = r.withColumns({f"raw_{c}": raw[c] for c in names})
    r = r.withColumn("cat_penalties", stretch_percentile((F.lit(1) - F.col("p_penalty_ratio")) * 100))
    r = cut(r.select(*df.columns, "cat_penalties", *[f"raw_{c}" for c in names]), "skater-raw")
    seconds = percentile_ranks_wide(r, [id_col], ["pos_group"], [f"raw_{c}" for c in names], "r_")
    r = lookup(r, seconds, [id_col])
    optional = ("competition", "power_play", "penalty_kill")
    r = with_group_stats(r, ["pos_group"], **{f"__n_{c}": F.count(f"raw_{c}") for c in optional})
    cats = {}
    for c in names:
        score = stretch_percentile(F.col(f"r_raw_{c}") * 100)
        if c in optional:
            score = F.when(F.col(f"raw_{c}").isNotNull() & (F.col(f"__n_{c}") > 1), score)
        cats[f"cat_{c}"] = score
    return r.withColumns(cats).select(*df.columns, *[f"cat_{c}" for c in CATEGORIES])


def add_overall(df: DataFrame, categories: dict[str, Column | str], pool: list[str], id_col: str = "player_id",
                empty: float | None = 0.0) -> DataFrame:
    """overall_raw: weighted mean of the categories a player has; overall: its stretched percentile in the pool."""
    weights = [F.col(w) if isinstance(w, str) else w for w in categories.values()]
    raw = weighted_mean_present(list(categories), weights)
    out = df.withColumn("overall_raw", F.coalesce(raw, F.lit(empty).cast("double")))
    ranks = percentile_ranks_wide(out, [id_col], pool, ["overall_raw"], "__o_")
    out = lookup(out, ranks, [id_col])
    return out.withColumn("overall", stretch_percentile(F.col("__o_overall_raw") * 100)).drop("__o_overall_raw")


def rate_skaters(df: DataFrame, id_col: str = "player_id") -> DataFrame:
    """Full skater rating of one season: needs pos_group and the rate columns; groups F and D only."""
    base = skater_shares(df.filter(F.col("pos_group").isin("F", "D")))
    weighted = cut(skater_weights(base), "skater-weights")
    adjusted = cut(teammate_adjustment(weighted, id_col), "skater-adjusted")
    scored = cut(category_scores(adjusted, id_col), "skater-categories")
    return add_overall(scored, {f"cat_{c}": f"w_{c}" for c in CATEGORIES}, ["pos_group"], id_col)


def goalie_metrics(df: DataFrame, keys: list[str] | None = None, min_games: int = 15) -> DataFrame:
    """One row per goalie from rows per situation: goals saved above expected, per hour and by danger tier."""
    keys = keys or ["name", "team"]
    s = F.col("situation")

    def total(col):
        return F.max(F.when(s == "all", F.col(col).cast("double")))

    saved = {t: F.col(f"{t}DangerxGoals") - F.col(f"{t}DangerGoals") for t in ("high", "medium", "low")}
    ev5 = (saved["high"] * 0.55 + saved["medium"] * 0.30 + saved["low"] * 0.15) / (F.col("icetime") / 3600)
    pk = F.col("xGoals") - F.col("goals")
    per = df.groupBy(*keys).agg(
        total("games_played").alias("gp"), total("icetime").alias("icetime_sec"),
        F.max(F.when(s == "all", F.col("xGoals") - F.col("goals"))).alias("gsax_total"),
        *[F.max(F.when(s == "all", saved[t])).alias(f"{t}_gsax") for t in saved],
        F.max(F.when(s == "all", F.col("xRebounds") - F.col("rebounds"))).alias("__reb"),
        F.max(F.when(s == "all", F.col("lowDangerShots") + F.col("mediumDangerShots") + F.col("highDangerShots"))).alias("shots_faced"),
        F.max(F.when((s == "5on5") & (F.col("icetime") > 0), ev5)).alias("ev5_gsax_per60"),
        F.max(F.when((s == "4on5") & (F.col("icetime") > 0), pk / (F.col("icetime") / 3600))).alias("pk_gsax_per60"),
    )
    team = [k for k in keys if k != "name"]
    shared = share_of_total(per.filter(F.col("gp").isNotNull()), team, "gp", "gp_share")
    hours = F.col("icetime_sec") / 3600
    out = shared.filter((F.col("gp") >= min_games) & (F.col("icetime_sec") > 0) & F.col("gsax_total").isNotNull())
    return out.withColumns({
        "gsax_per60": F.col("gsax_total") / hours,
        **{f"{t}_gsax_per60": F.col(f"{t}_gsax") / hours for t in saved},
        "reb_per60": F.col("__reb") / hours,
    }).drop("__reb")


GOALIE_SOURCES = {
    "ev5": "ev5_gsax_per60", "pk": "pk_gsax_per60", "high": "high_gsax_per60", "medium": "medium_gsax_per60",
    "low": "low_gsax_per60", "rebound": "reb_per60", "ice_time": "gp_share",
}


def rate_goalies(df: DataFrame, id_col: str = "name", pool: list[str] | None = None) -> DataFrame:
    """cat_<category> and overall over the pool (season by default); a missing category drops out of the mean."""
    pool = pool or ["season"]
    ids = list(dict.fromkeys([id_col, *pool]))
    named = cut(df.withColumn("__id", F.struct(*ids)), "goalies")
    ranks = percentile_ranks_wide(named, ["__id"], pool, list(GOALIE_SOURCES.values()), "p_")
    r = lookup(named, ranks, ["__id"])
    r = r.withColumns({
        f"cat_{c}": F.when(F.col(m).isNotNull(), stretch_percentile(F.col(f"p_{m}") * 100)) for c, m in GOALIE_SOURCES.items()
    })
    cats = {f"cat_{c}": F.lit(w) for c, w in GOALIE_WEIGHTS.items()}
    out = add_overall(cut(r, "goalie-categories"), cats, pool, "__id", None)
    return out.drop("__id", *[f"p_{m}" for m in GOALIE_SOURCES.values()])


def _season_weight(season: str) -> Column:
    w = F
    for y, v in SEASON_WEIGHTS.items():
        w = w.when(F.col(season) == y, v)
    return w.otherwise(0.0)


def _identity(df: DataFrame, columns: list[str]) -> list[Column]:
    """Per column the latest season's non-null value."""
    return [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("season", c))).alias(c) for c in columns
    ]


def blend_skaters(seasons: DataFrame, rates: list[str], totals: list[str], zone_counts: list[str],
                  key: str = "name_key", identity: tuple = ("name", "team", "position")) -> DataFrame:
    """Three-season blend of skaters: rates weighted by season weight times minutes, totals added up.

    A season counts from 200 minutes. A player needs one of the two latest seasons and either two
    seasons of 250 minutes or one of 300.
    """
    w = seasons.withColumn("__w", _season_weight("season")).filter(F.col("toi_min") >= 200)
    w = w.withColumn("__eff", F.col("__w") * F.greatest(F.col("toi_min"), F.lit(1.0)))
    sums = {c: F.coalesce(F.sum(c), F.lit(0.0)) for c in totals}
    sums |= {c: F.coalesce(F.sum(F.col(c) * F.col("__w")), F.lit(0.0)) for c in zone_counts}
    latest = sorted(SEASON_WEIGHTS, reverse=True)[:2]
    out = weighted_means(w, [key], rates, "__eff", {
        **sums,
        "__recent": F.bool_or(F.col("season").isin(*latest)),
        "__n250": F.count_if(F.col("toi_min") >= 250),
        "__max": F.max("toi_min"),
        **{i: c for i, c in zip(identity, _identity(w, list(identity)))},
    })
    ok = F.col("__recent") & ((F.col("__n250") >= 2) | (F.col("__max") >= 300))
    return out.filter(ok).drop("__recent", "__n250", "__max")


def blend_goalies(seasons: DataFrame, rates: list[str], totals: list[str], key: str = "name_key") -> DataFrame:
    """Three-season blend of goalies: from 40 games in all, with two seasons or one of 20 games."""
    w = seasons.withColumn("__w", _season_weight("season"))
    w = w.withColumn("__eff", F.col("__w") * F.greatest(F.col("icetime_sec") / 60, F.lit(1.0)))
    latest = sorted(SEASON_WEIGHTS, reverse=True)[:2]
    share = F.sum(F.col("gp_share") * F.col("__w")) / F.nullif(F.sum("__w"), F.lit(0.0))
    out = weighted_means(w, [key], rates, "__eff", {
        "gp": F.sum("gp"), "icetime_sec": F.sum("icetime_sec"),
        **{c: F.coalesce(F.sum(F.col(c) * F.col("__w")), F.lit(0.0)) for c in totals},
        "gp_share": share,
        "__recent": F.bool_or(F.col("season").isin(*latest)),
        "__seasons": F.count_distinct("season"),
        "__max": F.max("gp"),
        **{i: c for i, c in zip(("name", "team"), _identity(w, ["name", "team"]))},
    })
    ok = F.col("__recent") & (F.col("gp") >= 40) & ((F.col("__seasons") >= 2) | (F.col("__max") >= 20))
    return out.filter(ok).drop("__recent", "__seasons", "__max")


def blended_key(df: DataFrame, name: str = "name", aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds the normalised name, variants replaced by their spelling after normalising (the known aliases by default)."""
    if aliases is None:
        from statloom.operators.joins import NAME_ALIASES as aliases
    key = name_key(name, "ascii")
    pairs = [name_key(F.lit(x), "ascii") for pair in aliases.items() for x in pair]
    return df.withColumn("name_key", F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key)


def blend_components(stuff: str, location: str, tunnel: str, weights: dict[str, float]) -> Column:
    """Linear blend of the three component predictions."""
    return (
        F.col(stuff) * weights["stuff"] + F.col(location) * weights["location"]
        + F.col(tunnel) * weights["tunnel"] + F.lit(weights["intercept"])
    )


# Published blend of the component models.
BLEND_WEIGHTS = {
    "stuff": 0.8268003463745117, "location": 0.8665236234664917, "tunnel": 0.21111805737018585,
    "intercept": 0.004898399580270052,
}
