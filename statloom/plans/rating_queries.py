"""Composite ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import names
from statloom.operators import ratings
from statloom.operators.ratings import ATTACK_COLUMNS, CATEGORIES, CATEGORY_TERMS, DEFENCE_COLUMNS, SKATER_WEIGHTS
from statloom.plans.bindings import SKATER_METRICS
from statloom.plans.registry import pct_rank_sql, query, r6, r6_sql, table
from statloom.plans.value_queries import _ascii_key, _curve_sql


def skaters(spark, folder):
    return table(spark, folder, "skaters").filter(F.col("pos_group").isin("F", "D"))


# Every engine gets the same steps as CTEs: shares -> weights -> adjusted columns -> percentiles -> categories.
_GP = "greatest(gp, 1)"
_TOTAL = "(coalesce(cnt_dz, 0) + coalesce(cnt_oz, 0) + coalesce(cnt_nz, 0))"
_SHARES = f"""sh AS (SELECT *, CASE WHEN all_pen_drawn_per60 > 0 THEN all_pim_per60 / all_pen_drawn_per60 WHEN all_pim_per60 > 0 THEN all_pim_per60 * 10 END AS penalty_ratio,
  CASE WHEN {_TOTAL} > 0 THEN coalesce(cnt_dz, 0) / {_TOTAL} * 100 ELSE 33.3 END AS dz_shift_pct, CASE WHEN {_TOTAL} > 0 THEN coalesce(cnt_oz, 0) / {_TOTAL} * 100 ELSE 33.3 END AS oz_shift_pct,
  toi_min / {_GP} AS ev_toi_per_gp, coalesce(toi_min_pp, 0) / {_GP} AS pp_toi_per_gp, coalesce(toi_min_pk, 0) / {_GP} AS pk_toi_per_gp,
  coalesce(toi_min_pp, 0) > 0 AND coalesce(toi_min_pp, 0) / {_GP} >= 1 AS has_pp, coalesce(toi_min_pk, 0) > 0 AND coalesce(toi_min_pk, 0) / {_GP} >= 1 AS has_pk
  FROM @skaters WHERE pos_group IN ('F', 'D'))"""
_POOL = SKATER_WEIGHTS["power_play"] + SKATER_WEIGHTS["penalty_kill"]
_PPC, _PKC = "(CASE WHEN has_pp THEN pp_toi_per_gp ELSE 0 END)", "(CASE WHEN has_pk THEN pk_toi_per_gp ELSE 0 END)"
_WEIGHTS = f"""z AS (SELECT *, avg(oz_shift_pct) OVER g AS om, stddev_samp(oz_shift_pct) OVER g AS os, avg(CASE WHEN has_pp THEN pp_toi_per_gp END) OVER () AS ppm, avg(CASE WHEN has_pk THEN pk_toi_per_gp END) OVER () AS pkm
   FROM sh WINDOW g AS (PARTITION BY pos_group)),
 w0 AS (SELECT *, CASE WHEN os > 0 THEN least(greatest((oz_shift_pct - om) / os, -1), 1) ELSE 0 END AS df,
   {_POOL!r} * CASE WHEN {_PPC} + {_PKC} > 0 THEN {_PPC} / ({_PPC} + {_PKC}) ELSE 0 END * CASE WHEN has_pp AND ppm > 0 THEN least(pp_toi_per_gp / ppm, 1) ELSE 0 END AS w_power_play,
   {_POOL!r} * CASE WHEN {_PPC} + {_PKC} > 0 THEN {_PKC} / ({_PPC} + {_PKC}) ELSE 0 END * CASE WHEN has_pk AND pkm > 0 THEN least(pk_toi_per_gp / pkm, 1) ELSE 0 END AS w_penalty_kill FROM z),
 w AS (SELECT *, 0.275 + df * 0.05 + ({_POOL!r} - w_power_play - w_penalty_kill) * (0.5 + df * 0.5) AS w_offense,
   0.215 - df * 0.05 + (({_POOL!r} - w_power_play - w_penalty_kill) - ({_POOL!r} - w_power_play - w_penalty_kill) * (0.5 + df * 0.5)) AS w_defense,
   0.20 AS w_production, 0.05 AS w_penalties, 0.075 AS w_competition, 0.075 AS w_teammates FROM w0)"""


def _adjust() -> str:
    def pr(c, inv=False):
        b = pct_rank_sql(c, "pos_group")
        return f"CASE WHEN {c} IS NOT NULL THEN {'(1 - ' + b + ')' if inv else b} * 100 END"

    def mix(a, b, c):
        return (f"(coalesce({a} * 0.4, 0) + coalesce({b} * 0.2, 0) + coalesce({c} * 0.4, 0)) / nullif("
                f"CASE WHEN {a} IS NULL THEN 0 ELSE 0.4 END + CASE WHEN {b} IS NULL THEN 0 ELSE 0.2 END + CASE WHEN {c} IS NULL THEN 0 ELSE 0.4 END, 0)")

    def factor(v):
        return f"least(greatest((({v} - avg({v}) OVER g) / greatest(stddev_pop({v}) OVER g, 1)) * -0.5, -0.65), 0.65)"

    moved = [f"{c} + {factor('att')} * greatest(stddev_samp({c}) OVER g, 0.01) AS {c}" for c in ATTACK_COLUMNS]
    moved += [f"{c} - {factor('def')} * greatest(stddev_samp({c}) OVER g, 0.01) AS {c}" for c in DEFENCE_COLUMNS]
    return f"""t1 AS (SELECT *, {pr('qot_rapm_xgf')} AS a1, {pr('qot_rapm_cf')} AS a2, {pr('qot_off_xgar')} AS a3, {pr('qot_rapm_xga', True)} AS d1, {pr('qot_rapm_ca', True)} AS d2,
   {pr('qot_def_xgar')} AS d3, {pr('qot_rapm_xg')} AS xx FROM w),
 t2 AS (SELECT *, coalesce({mix('a1', 'a2', 'a3')}, xx, 50) AS att, coalesce({mix('d1', 'd2', 'd3')}, xx, 50) AS def FROM t1),
 adj AS (SELECT * REPLACE ({', '.join(moved)}) FROM t2 WINDOW g AS (PARTITION BY pos_group))"""


def _categories() -> str:
    pcts = ", ".join(f"{pct_rank_sql(m, 'pos_group')} AS p_{m}" for m in ratings.rated_metrics())

    def known(m, otherwise, invert=False):
        p = f"(1 - p_{m}) * 100" if invert else f"p_{m} * 100"
        return f"(CASE WHEN {m} IS NOT NULL THEN {p} ELSE {otherwise} END)"

    special = {"saves": known("onice_sv_pct", "50", True), "matchups": known("qoc_rapm_xg", "50"),
               "opponents": known("qoc_def_xgar", known("qoc_rapm_xg", "50"))}

    def term(m):
        return special.get(m) or (f"(1 - p_{m[1:]}) * 100" if m.startswith("-") else f"p_{m} * 100")

    def total(terms):
        return " + ".join(f"({term(m)}) * {w!r}e0" if "e" not in repr(w) else f"({term(m)}) * {w!r}" for m, w in terms.items())

    raw = {c: f"CASE WHEN pos_group = 'D' THEN {total(g['D'])} ELSE {total(g['F'])} END" for c, g in CATEGORY_TERMS.items()}
    raw["power_play"] = f"CASE WHEN has_pp THEN {raw['power_play']} END"
    raw["penalty_kill"] = f"CASE WHEN has_pk THEN {raw['penalty_kill']} END"
    main = known("qoc_rapm_xg", "NULL")
    raw["competition"] = f"{main} * 0.4e0 + p_dz_shift_pct * 100 * 0.2e0 + {known('qoc_off_xgar', main)} * 0.2e0 + {known('qoc_def_xgar', main)} * 0.2e0"
    rows = [c for c in CATEGORIES if c != "penalties"]
    raws = ", ".join(f"{raw[c]} AS raw_{c}" for c in rows)
    cats = []
    for c in rows:
        s = _curve_sql(f"({pct_rank_sql(f'raw_{c}', 'pos_group')} * 100)")
        if c in ("competition", "power_play", "penalty_kill"):
            s = f"CASE WHEN raw_{c} IS NOT NULL AND count(raw_{c}) OVER (PARTITION BY pos_group) > 1 THEN {s} END"
        cats.append(f"{s} AS cat_{c}")
    cats.append(f"{_curve_sql('((1 - p_penalty_ratio) * 100)')} AS cat_penalties")
    return f"""pp AS (SELECT *, {pcts} FROM adj), rr AS (SELECT *, {raws} FROM pp), cc AS (SELECT *, {', '.join(cats)} FROM rr)"""


_TOP = " + ".join(f"coalesce(cat_{c} * w_{c}, 0)" for c in CATEGORIES)
_BOTTOM = " + ".join(f"CASE WHEN cat_{c} IS NULL THEN 0 ELSE w_{c} END" for c in CATEGORIES)
_OVERALL = f"oo AS (SELECT *, coalesce(({_TOP}) / nullif({_BOTTOM}, 0), 0) AS overall_raw FROM cc)"


@query("c2_c3_skater_weights", f"""WITH {_SHARES}, {_WEIGHTS}
SELECT player_id, {r6_sql('penalty_ratio')} AS penalty_ratio, has_pp, has_pk, {', '.join(f'{r6_sql(f"w_{c}")} AS w_{c}' for c in CATEGORIES)} FROM w""")
def c2(spark, folder):
    w = ratings.skater_weights(ratings.skater_shares(skaters(spark, folder)))
    weights = [f"w_{c}" for c in CATEGORIES]
    return r6(w.select("player_id", "penalty_ratio", "has_pp", "has_pk", *weights), "penalty_ratio", *weights)


@query("c1_c4_skater_ratings", f"""WITH {_SHARES}, {_WEIGHTS}, {_adjust()}, {_categories()}, {_OVERALL}
SELECT player_id, pos_group, {', '.join(f'{r6_sql(f"cat_{c}")} AS cat_{c}' for c in CATEGORIES)}, {r6_sql('overall_raw')} AS overall_raw, {r6_sql(_curve_sql(f"({pct_rank_sql('overall_raw', 'pos_group')} * 100)"))} AS overall FROM oo""")
def c1(spark, folder):
    cats = [f"cat_{c}" for c in CATEGORIES]
    out = ratings.rate_skaters(skaters(spark, folder))
    return r6(out.select("player_id", "pos_group", *cats, "overall_raw", "overall"), *cats, "overall_raw", "overall")


# --- goalies --------------------------------------------------------------------------------------

# one row per customer, season and situation; every seventh goalie has no short-handed row
_GOALIE = {
    "season": "2023 + k / 3", "situation": "k % 3", "games_played": "(c * 7 + y * 5) % 60",
    "icetime": "CASE WHEN c % 31 = 0 THEN 0 ELSE 600 + (c * 131 + y * 17 + s * 37) % 90000 END / 1e0",
    "xGoals": "((c * 17 + s * 3 + y) % 900) / 10e0", "goals": "(c * 13 + s * 5 + y * 2) % 90 / 1e0",
    "xRebounds": "((c * 11 + y) % 300) / 10e0", "rebounds": "(c * 19 + y) % 30 / 1e0",
    **{f"{t}DangerxGoals": f"((c * {p} + s * 7 + y) % 400) / 10e0" for t, p in (("low", 23), ("medium", 29), ("high", 31))},
    **{f"{t}DangerGoals": f"(c * {p} + s + y * 3) % 40 / 1e0" for t, p in (("low", 41), ("medium", 43), ("high", 47))},
    **{f"{t}DangerShots": f"(c * {p} + s) % 300 / 1e0" for t, p in (("low", 3), ("medium", 5), ("high", 9))},
}
_GOALIE_COLUMNS = ", ".join(
    f"{e} AS {n}" for n, e in _GOALIE.items() if n not in ("season", "situation"))
_GOALIES = f"""(SELECT concat('G', c) AS name, concat('T', c % 30) AS team, CAST(2023 + y AS INT) AS season, CASE s WHEN 0 THEN 'all' WHEN 1 THEN '5on5' ELSE '4on5' END AS situation, {_GOALIE_COLUMNS}
 FROM (SELECT c_custkey AS c, s, y FROM customer, (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest([0, 1, 2]) AS y)) WHERE NOT (s = 2 AND c % 7 = 0))"""


def goalies(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    c = c.select("c", "s", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("y")).filter("NOT (s = 2 AND c % 7 = 0)")
    return c.selectExpr(
        "concat('G', c) AS name", "concat('T', c % 30) AS team", "CAST(2023 + y AS INT) AS season",
        "CASE s WHEN 0 THEN 'all' WHEN 1 THEN '5on5' ELSE '4on5' END AS situation",
        *[f"{e} AS {n}" for n, e in _GOALIE.items() if n not in ("season", "situation")])


def _metrics_sql(min_games: int) -> str:
    a = "situation = 'all'"
    saved = {t: f"({t}DangerxGoals - {t}DangerGoals)" for t in ("high", "medium", "low")}
    return f"""gm0 AS (SELECT name, team, season, CAST(max(games_played) FILTER (WHERE {a}) AS DOUBLE) AS gp, max(icetime) FILTER (WHERE {a}) AS icetime_sec, max(xGoals - goals) FILTER (WHERE {a}) AS gsax_total,
   {', '.join(f"max({e}) FILTER (WHERE {a}) AS {t}_gsax" for t, e in saved.items())}, max(xRebounds - rebounds) FILTER (WHERE {a}) AS reb, max(lowDangerShots + mediumDangerShots + highDangerShots) FILTER (WHERE {a}) AS shots_faced,
   max(({saved['high']} * 0.55 + {saved['medium']} * 0.30 + {saved['low']} * 0.15) / nullif(icetime / 3600, 0)) FILTER (WHERE situation = '5on5' AND icetime > 0) AS ev5_gsax_per60,
   max((xGoals - goals) / nullif(icetime / 3600, 0)) FILTER (WHERE situation = '4on5' AND icetime > 0) AS pk_gsax_per60 FROM {_GOALIES} GROUP BY name, team, season),
 gm1 AS (SELECT *, gp / greatest(sum(gp) OVER (PARTITION BY team, season), 1) AS gp_share FROM gm0),
 gm AS (SELECT *, gsax_total / (icetime_sec / 3600) AS gsax_per60, high_gsax / (icetime_sec / 3600) AS high_gsax_per60, medium_gsax / (icetime_sec / 3600) AS medium_gsax_per60, low_gsax / (icetime_sec / 3600) AS low_gsax_per60,
   reb / (icetime_sec / 3600) AS reb_per60 FROM gm1 WHERE gp >= {min_games} AND icetime_sec > 0)"""


_G_OUT = ["gsax_total", "gsax_per60", "high_gsax_per60", "medium_gsax_per60", "low_gsax_per60", "reb_per60", "ev5_gsax_per60", "pk_gsax_per60", "gp_share"]


@query("c5_j21_goalie_metrics", f"""WITH {_metrics_sql(15)} SELECT name, team, season, gp, shots_faced, {', '.join(f'{r6_sql(c)} AS {c}' for c in _G_OUT)} FROM gm""")
def c5(spark, folder):
    g = ratings.goalie_metrics(goalies(spark, folder), ["name", "team", "season"], 15)
    return r6(g.select("name", "team", "season", "gp", "shots_faced", *_G_OUT), *_G_OUT)


def _goalie_overall_sql() -> str:
    src = ratings.GOALIE_SOURCES
    cats = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN {_curve_sql(f"({pct_rank_sql(m, 'season')} * 100)")} END AS cat_{c}" for c, m in src.items())
    top = " + ".join(f"coalesce(cat_{c} * {w!r}, 0)" for c, w in ratings.GOALIE_WEIGHTS.items())
    low = " + ".join(f"CASE WHEN cat_{c} IS NULL THEN 0 ELSE {w!r} END" for c, w in ratings.GOALIE_WEIGHTS.items())
    return f"gc AS (SELECT *, {cats} FROM gm), go AS (SELECT *, ({top}) / nullif({low}, 0) AS overall_raw FROM gc)"


@query("c6_goalie_ratings", f"""WITH {_metrics_sql(15)}, {_goalie_overall_sql()}
SELECT name, season, {', '.join(f'{r6_sql(f"cat_{c}")} AS cat_{c}' for c in ratings.GOALIE_SOURCES)}, {r6_sql(_curve_sql(f"({pct_rank_sql('overall_raw', 'season')} * 100)"))} AS overall FROM go""")
def c6(spark, folder):
    g = ratings.goalie_metrics(goalies(spark, folder), ["name", "team", "season"], 15)
    cats = [f"cat_{c}" for c in ratings.GOALIE_SOURCES]
    return r6(ratings.rate_goalies(g).select("name", "season", *cats, "overall"), *cats, "overall")


_BLEND_RATES = ["onice_xgf_per60", "hdcf_per60", "all_g_per60"]


def skater_seasons(spark, folder):
    s = table(spark, folder, "skaters").select(
        "player_id", "name", "team", "position", "gp", "toi_min", "cnt_dz", *_BLEND_RATES,
        F.explode(F.sequence(F.lit(2023), F.lit(2025))).alias("season"))
    s = s.filter("(player_id + season) % 4 <> 0")
    return s.withColumns({
        "toi_min": F.pmod(F.col("toi_min") + (F.col("season") - 2023) * 77, F.lit(500)) + 50,
        "team": F.when((F.col("player_id") + F.col("season")) % 3 != 0, F.concat("team", F.lit("-"), "season")),
        **{c: F.col(c) + (F.col("season") - 2023) for c in _BLEND_RATES}})


_W = "CASE season WHEN 2025 THEN 0.53 WHEN 2024 THEN 0.31 WHEN 2023 THEN 0.16 ELSE 0 END"


@query("c7_skater_blend", f"""
WITH s AS (SELECT player_id, {_ascii_key('name')} AS name_key, name, CASE WHEN (player_id + y) % 3 <> 0 THEN concat(team, '-', y) END AS team, position, gp, (toi_min + (y - 2023) * 77) % 500 + 50 AS toi_min, cnt_dz, {', '.join(f'{c} + (y - 2023) AS {c}' for c in _BLEND_RATES)}, y AS season
   FROM @skaters, (SELECT unnest([2023, 2024, 2025]) AS y) WHERE (player_id + y) % 4 <> 0),
 f AS (SELECT *, {_W} AS w, {_W} * greatest(toi_min, 1) AS e FROM s WHERE toi_min >= 200),
 g AS (SELECT name_key, {', '.join(f'sum({c} * e) / nullif(sum(e) FILTER (WHERE {c} IS NOT NULL), 0) AS {c}' for c in _BLEND_RATES)}, sum(gp) AS gp, sum(toi_min) AS toi_min, coalesce(sum(cnt_dz * w), 0) AS cnt_dz,
   bool_or(season >= 2024) AS recent, count(*) FILTER (WHERE toi_min >= 250) AS n250, max(toi_min) AS top, max({{'season': season, 'team': team}}) FILTER (WHERE team IS NOT NULL) AS tm FROM f GROUP BY name_key)
SELECT name_key, {', '.join(f'{r6_sql(c)} AS {c}' for c in _BLEND_RATES)}, gp, {r6_sql('toi_min')} AS toi_min, {r6_sql('cnt_dz')} AS cnt_dz, tm.team AS team FROM g WHERE recent AND (n250 >= 2 OR top >= 300)""")
def c7(spark, folder):
    s = ratings.blended_key(skater_seasons(spark, folder))
    out = ratings.blend_skaters(s, _BLEND_RATES, ["gp", "toi_min"], ["cnt_dz"])
    return r6(out.select("name_key", *_BLEND_RATES, "gp", "toi_min", "cnt_dz", "team"), *_BLEND_RATES, "toi_min", "cnt_dz")


@query("c7_goalie_blend", f"""WITH {_metrics_sql(5)}, f AS (SELECT *, {_W} AS w, {_W} * greatest(icetime_sec / 60, 1) AS e FROM gm),
 g AS (SELECT lower(name) AS name_key, sum(gsax_per60 * e) / sum(e) AS gsax_per60, sum(pk_gsax_per60 * e) / nullif(sum(e) FILTER (WHERE pk_gsax_per60 IS NOT NULL), 0) AS pk_gsax_per60, sum(gp) AS gp, coalesce(sum(gsax_total * w), 0) AS gsax_total,
   sum(gp_share * w) / sum(w) AS gp_share, bool_or(season >= 2024) AS recent, count(DISTINCT season) AS seasons, max(gp) AS top FROM f GROUP BY name)
SELECT name_key, {r6_sql('gsax_per60')} AS gsax_per60, {r6_sql('pk_gsax_per60')} AS pk_gsax_per60, gp, {r6_sql('gsax_total')} AS gsax_total, {r6_sql('gp_share')} AS gp_share FROM g WHERE recent AND gp >= 40 AND (seasons >= 2 OR top >= 20)""")
def c7_goalies(spark, folder):
    g = ratings.blended_key(ratings.goalie_metrics(goalies(spark, folder), ["name", "team", "season"], 5))
    out = ratings.blend_goalies(g, ["gsax_per60", "pk_gsax_per60"], ["gsax_total"])
    return r6(out.select("name_key", "gsax_per60", "pk_gsax_per60", "gp", "gsax_total", "gp_share"),
              "gsax_per60", "pk_gsax_per60", "gsax_total", "gp_share")


@query("c9_component_blend", f"""
SELECT line_key, {r6_sql('0.8268003463745117 * stuff + 0.8665236234664917 * location + 0.21111805737018585 * coalesce(tunnel, 0) + 0.004898399580270052')} AS xrv_final FROM @pitches""")
def c9(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", "stuff", "location", F.coalesce("tunnel", F.lit(0.0)).alias("tunnel"))
    return r6(p.select("line_key", ratings.blend_components("stuff", "location", "tunnel", ratings.BLEND_WEIGHTS).alias("xrv_final")), "xrv_final")
