"""Rates, grids, plate-appearance metrics, weighted means, fits and densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import buckets
from statloom.functions.buckets import CONTACT_DESCRIPTIONS, SWING_DESCRIPTIONS, WHIFF_DESCRIPTIONS
from statloom.functions.numeric import round_half_even, safe_percent
from statloom.operators import appearances, grids, ranks, rates
from statloom.plans.registry import half_even_sql, half_up_sql, query, r6, r6_sql, table


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SWING = f"description IN {_in(SWING_DESCRIPTIONS)}"
WHIFF = f"description IN {_in(WHIFF_DESCRIPTIONS)}"
BUCKET = (
    "CASE WHEN balls = 0 AND strikes = 0 THEN 'first' WHEN balls = 3 AND strikes = 2 THEN 'full' "
    "WHEN (balls, strikes) IN ((0,1), (0,2), (1,2)) THEN 'ahead' WHEN (balls, strikes) IN ((1,1), (2,2)) THEN 'even' "
    "WHEN (balls, strikes) IN ((1,0), (2,0), (2,1), (3,1), (3,0)) THEN 'behind' END"
)
ANGLE = "CASE " + " ".join(f"WHEN launch_angle <= {e} THEN {i}" for i, e in enumerate(buckets.ANGLE_EDGES)) + \
    " WHEN launch_angle IS NOT NULL THEN 11 END"


def zone_sql(w: float) -> str:
    return (f"(CASE WHEN plate_x IS NOT NULL AND plate_z IS NOT NULL THEN abs(plate_x) <= {w} "
            "AND plate_z >= coalesce(nullif(sz_bot, 0), 1.5) AND plate_z <= coalesce(nullif(sz_top, 0), 3.5) END)")


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} / {d} * 100 END"


@query("a1_grade_means", f"""
SELECT pitcher, pitch_type, count(xrv) AS n, {half_even_sql('avg(xrv) * 100', 3)} AS xrv, {half_even_sql('avg(stuff) * 100', 3)} AS stuff,
 {half_even_sql('avg(tunnel) * 100', 3)} AS tunnel, CASE WHEN grouping(pitch_type) = 1 THEN 'player' ELSE 'kind' END AS level
FROM @pitches GROUP BY GROUPING SETS ((pitcher, pitch_type), (pitcher))""")
def a1(spark, folder):
    return rates.grade_means_two_levels(table(spark, folder, "pitches"), "pitcher", "pitch_type", ["xrv", "stuff", "tunnel"])


@query("a2_m5_f5_league_rates", f"""
SELECT season, pitch_type, count(*) AS count, {half_even_sql('avg(release_speed)', 1)} AS velo, {half_even_sql('avg(release_spin_rate)', 0)} AS spin,
 {half_even_sql(pct(f"count(*) FILTER (WHERE {zone_sql(0.83)})", f"count({zone_sql(0.83)})"), 1)} AS zone_pct,
 {half_even_sql(pct(f'count(*) FILTER (WHERE {WHIFF})', f'count(*) FILTER (WHERE {SWING})'), 1)} AS whiff_pct,
 {half_even_sql('avg(release_extension)', 2)} AS extension FROM @pitches GROUP BY ALL HAVING count(*) >= 500""")
def a2(spark, folder):
    return rates.league_rates(table(spark, folder, "pitches"), ["season", "pitch_type"], 500)


@query("a3_pitch_mix", f"""
WITH g AS (SELECT pitcher, pitch_type, count(*) AS n, {half_up_sql('avg(nullif(release_speed, 0))', 1)} AS velo,
 {half_up_sql('avg(nullif(release_spin_rate, 0))', 0)} AS spin, {half_up_sql('avg(pfx_x)', 1)} AS h_break, {half_up_sql('avg(pfx_z)', 1)} AS v_break,
 {half_up_sql('avg(nullif(release_pos_z, 0))', 2)} AS release_height, {half_up_sql('avg(nullif(release_extension, 0))', 1)} AS extension,
 {half_up_sql(pct(f"count(*) FILTER (WHERE {zone_sql(0.88)})", 'count(*)'), 1)} AS zone_pct,
 {half_up_sql(pct(f'count(*) FILTER (WHERE {WHIFF})', f'count(*) FILTER (WHERE {SWING})'), 1)} AS whiff_pct FROM @pitches GROUP BY ALL)
SELECT g.*, {half_up_sql('n / sum(n) OVER (PARTITION BY pitcher) * 100', 1)} AS usage_pct FROM g""")
def a3(spark, folder):
    return rates.pitch_mix(table(spark, folder, "pitches"), ["pitcher"])


_GRID = f"""count(*) AS n, {r6_sql(pct(f"count(*) FILTER (WHERE {zone_sql(0.88)})", f"count({zone_sql(0.88)})"))} AS zone,
 {r6_sql(pct(f'count(*) FILTER (WHERE {WHIFF})', f'count(*) FILTER (WHERE {SWING})'))} AS whiff,
 {r6_sql(pct(f'count(*) FILTER (WHERE {SWING})', 'count(*)'))} AS swing, {r6_sql('avg(launch_speed)')} AS ev"""


@query("a4_m3_count_grid_by_type", f"""
WITH p AS (SELECT *, {BUCKET} AS bk FROM @pitches),
 g AS (SELECT pitcher, pitch_type, CASE WHEN grouping(bk) = 1 THEN 'all' ELSE bk END AS bucket, {_GRID}
  FROM p GROUP BY GROUPING SETS ((pitcher, pitch_type, bk), (pitcher, pitch_type)))
SELECT * FROM g WHERE bucket IS NOT NULL""")
def a4(spark, folder):
    return r6(grids.count_grid_by_type(table(spark, folder, "pitches"), ["pitcher"]), "zone", "whiff", "swing", "ev")


@query("a5_m4_count_grid_by_group", f"""
WITH p AS (SELECT *, {BUCKET} AS bk, CASE WHEN pitch_type IN ('FF','SI','FC','FA') THEN 'Fastball' WHEN pitch_type IN ('SL','CU','KC','CS','SV','ST','KN') THEN 'Breaking'
  WHEN pitch_type IN ('CH','FS','SC','FO') THEN 'Offspeed' ELSE 'Other' END AS pitch_group FROM @pitches),
 g AS (SELECT batter, pitch_group, CASE WHEN grouping(bk) = 1 THEN 'all' ELSE bk END AS bucket, {_GRID}
  FROM p GROUP BY GROUPING SETS ((batter, pitch_group, bk), (batter, pitch_group)))
SELECT g.*, {r6_sql('n / sum(n) OVER (PARTITION BY batter, bucket) * 100')} AS mix FROM g WHERE bucket IS NOT NULL""")
def a5(spark, folder):
    return r6(grids.count_grid_by_group(table(spark, folder, "pitches"), ["batter"]), "zone", "whiff", "swing", "ev", "mix")


@query("p8_grid_to_columns", f"""
WITH p AS (SELECT *, {BUCKET} AS bk FROM @pitches), g AS (SELECT pitcher, pitch_type, CASE WHEN grouping(bk) = 1 THEN 'all' ELSE bk END AS bucket,
 {r6_sql('avg(launch_speed)')} AS ev FROM p GROUP BY GROUPING SETS ((pitcher, pitch_type, bk), (pitcher, pitch_type)))
SELECT pitcher, pitch_type, {', '.join(f'max(CASE WHEN bucket = {b!r} THEN ev END) AS "{b}"' for b in grids.GRID_BUCKETS)} FROM g GROUP BY ALL""")
def p8(spark, folder):
    g = grids.count_grid_by_type(table(spark, folder, "pitches"), ["pitcher"])
    return r6(grids.grid_to_columns(g, ["pitcher", "pitch_type"], "ev"), *grids.GRID_BUCKETS)


_HIST = f"""b AS (SELECT pitcher, launch_speed, {ANGLE} AS bucket FROM @pitches WHERE launch_speed IS NOT NULL AND launch_angle IS NOT NULL),
 s AS (SELECT CAST(grouping(pitcher) AS INT) AS is_league, pitcher, bucket, count(*) AS c, sum(launch_speed) AS ev, count(*) FILTER (WHERE launch_speed >= 95) AS hard
  FROM b GROUP BY GROUPING SETS ((pitcher, bucket), (bucket))),
 t AS (SELECT is_league, pitcher, CAST(sum(c) AS BIGINT) AS total_bbe FROM s GROUP BY ALL HAVING is_league = 1 OR sum(c) >= 30),
 hist AS (SELECT t.is_league, t.pitcher, total_bbe, CAST(k.bucket AS INT) AS bucket, coalesce(c, 0) AS count, {half_even_sql('ev / c', 1)} AS avg_ev, {half_even_sql('hard / c * 100', 1)} AS hard_hit_pct
  FROM t CROSS JOIN (SELECT unnest(range(12)) AS bucket) k LEFT JOIN s ON s.is_league = t.is_league AND s.pitcher IS NOT DISTINCT FROM t.pitcher AND s.bucket = k.bucket)"""


@query("a6_m2_f9_f16_angle_histogram", f"""WITH {_HIST}
SELECT is_league, pitcher, total_bbe, bucket, {'[' + ', '.join("'" + x + "'" for x in buckets.ANGLE_LABELS) + ']'}[bucket + 1] AS label, count, avg_ev, hard_hit_pct FROM hist""")
def a6(spark, folder):
    h = grids.angle_histogram(table(spark, folder, "pitches"), "pitcher", 30)
    return h.withColumn("is_league", F.col("is_league").cast("int"))


_WIDE = f"""{_HIST}, w AS (SELECT is_league, pitcher, CAST(ceil(bucket / 2e0) AS INT) AS wide_bucket, CAST(sum(count) AS BIGINT) AS count,
  sum(coalesce(avg_ev * count, 0)) AS ev, sum(coalesce(floor(hard_hit_pct / 100 * count + 0.5), 0)) AS hard FROM hist GROUP BY ALL),
 wide AS (SELECT is_league, pitcher, wide_bucket, count, CASE WHEN count > 0 THEN {half_up_sql('ev / count', 1)} END AS avg_ev, CASE WHEN count > 0 THEN {half_up_sql('hard / count * 100', 1)} END AS hard_hit_pct FROM w)"""


@query("a7_merge_angle_buckets", f"WITH {_WIDE} SELECT * FROM wide")
def a7(spark, folder):
    h = grids.angle_histogram(table(spark, folder, "pitches"), "pitcher", 30)
    return grids.merge_angle_buckets(h, ["is_league", "pitcher"]).drop("label").withColumn("is_league", F.col("is_league").cast("int"))


@query("a8_j18_bucket_shares_vs_league", f"""WITH {_WIDE}, sh AS (SELECT *, coalesce(count / nullif(sum(count) OVER (PARTITION BY is_league, pitcher), 0) * 100, 0) AS share FROM wide),
 lg AS (SELECT wide_bucket, share AS ls, avg_ev AS le, hard_hit_pct AS lh FROM sh WHERE is_league = 1)
SELECT pitcher, wide_bucket, count, {r6_sql('share')} AS share, {r6_sql('share - ls')} AS share_diff, {r6_sql('avg_ev - le')} AS ev_diff, {r6_sql('hard_hit_pct - lh')} AS hard_diff
FROM sh JOIN lg USING (wide_bucket) WHERE is_league = 0""")
def a8(spark, folder):
    h = grids.angle_histogram(table(spark, folder, "pitches"), "pitcher", 30)
    wide = grids.merge_angle_buckets(h, ["is_league", "pitcher"])
    return r6(grids.bucket_shares_vs_league(wide, "pitcher"), "share", "share_diff", "ev_diff", "hard_diff")


@query("j18_grid_vs_league", f"""
WITH p AS (SELECT *, {BUCKET} AS bk FROM @pitches), g AS (SELECT pitcher, pitch_type, bk AS bucket, avg(launch_speed) AS ev FROM p WHERE bk IS NOT NULL GROUP BY ALL),
 l AS (SELECT pitch_type, bk AS bucket, avg(launch_speed) AS ev FROM p WHERE bk IS NOT NULL AND pitch_type <> 'CU' GROUP BY ALL)
SELECT g.pitcher, g.pitch_type, g.bucket, {r6_sql('g.ev - coalesce(l.ev, 88.0)')} AS ev_diff FROM g LEFT JOIN l USING (pitch_type, bucket)""")
def j18(spark, folder):
    p = table(spark, folder, "pitches")
    mine = grids.count_grid_by_type(p, ["pitcher"]).filter("bucket <> 'all'").select("pitcher", "pitch_type", "bucket", "ev")
    league = grids.count_grid_by_type(p.filter("pitch_type <> 'CU'")).select("pitch_type", "bucket", F.col("ev").alias("lg"))
    return r6(grids.versus_league(mine, league, ["pitch_type", "bucket"], "ev", "lg", F.lit(88.0), "ev_diff"), "ev_diff").drop("ev")


_TWO_STRIKES = """f AS (SELECT *, row_number() OVER (PARTITION BY pitcher, game_pk, at_bat_number, inning ORDER BY pitch_number) - 1 AS idx,
  count(*) OVER (PARTITION BY pitcher, game_pk, at_bat_number, inning) AS n FROM @feed),
 pa AS (SELECT pitcher, game_pk, n, coalesce(min(CASE WHEN coalesce(strikes, 0) >= 2 THEN idx END),
   max(CASE WHEN idx = n - 1 AND coalesce(strikes, 0) = 1 AND (description LIKE '%strike%' OR description LIKE '%foul%' OR events LIKE '%strikeout%') THEN n END)) AS need
  FROM f GROUP BY pitcher, game_pk, at_bat_number, inning, n)"""


@query("a10_n15_two_strike_rates", f"""WITH {_TWO_STRIKES}
SELECT pitcher, CAST(coalesce(sum(need), 0) AS BIGINT) AS pitch_sum, count(need) AS qualifying_pas, count(*) AS total_pas,
 {half_even_sql('sum(need) / count(need)', 3)} AS avg_pitches, {half_even_sql('count(need) / count(*) * 100', 1)} AS reach_pct FROM pa GROUP BY pitcher""")
def a10(spark, folder):
    pas = appearances.two_strike_appearances(table(spark, folder, "feed"))
    return rates_of(pas)


def rates_of(pas):
    return appearances.two_strike_rates(pas, ["pitcher"])


@query("a9_u1_merge_chunk_partials", f"""WITH {_TWO_STRIKES}, names AS (SELECT pitcher, arg_max(player_name, pitch_number) FILTER (WHERE player_name <> '') AS name FROM @feed GROUP BY pitcher)
SELECT pitcher, CAST(coalesce(sum(need), 0) AS BIGINT) AS pitch_sum, count(need) AS qualifying_pas, count(*) AS total_pas,
 any_value(regexp_replace(name, '^(.*?), (.*)$', '\\2 \\1')) AS name, {half_even_sql('sum(need) / count(need)', 3)} AS avg_pitches, {half_even_sql('count(need) / count(*) * 100', 1)} AS reach_pct
FROM pa LEFT JOIN names USING (pitcher) GROUP BY pitcher""")
def a9(spark, folder):
    f = table(spark, folder, "feed")
    half = F.when(F.dayofmonth("game_date") <= 15, "a").otherwise("b")
    pas = appearances.two_strike_appearances(f.withColumn("chunk", half), [*appearances.PA_KEYS, "chunk"])
    part = appearances.two_strike_rates(pas, ["pitcher", "chunk"]).drop("avg_pitches", "reach_pct")
    names = appearances.current_names(f.withColumn("chunk", half).withColumn("__pc", F.struct("pitcher", "chunk")), "__pc")
    names = names.select("__pc.pitcher", "__pc.chunk", "name")
    part = part.join(names, ["pitcher", "chunk"], "left")
    merged = appearances.merge_partials(part, ["pitcher"], ["pitch_sum", "qualifying_pas", "total_pas"], {"name": "name"})
    return appearances.finish_two_strike_rates(merged)


@query("a11_outs_by_pitcher", f"""
SELECT pitcher, CAST(sum(CASE WHEN events IN {_in(buckets.OUT_EVENTS)} THEN 1 + CASE WHEN events LIKE '%double_play%' THEN 1 WHEN events LIKE '%triple_play%' THEN 2 ELSE 0 END ELSE 0 END) AS BIGINT) AS outs
FROM @feed WHERE events <> '' GROUP BY pitcher""")
def a11(spark, folder):
    return appearances.outs_by_pitcher(table(spark, folder, "feed"))


@query("a12_game_starts", """
WITH s AS (SELECT game_pk, inning_topbot, pitcher, row_number() OVER (PARTITION BY game_pk, inning_topbot ORDER BY at_bat_number, pitch_number) AS rn FROM @feed WHERE inning = 1)
SELECT pitcher, count(*) AS starts FROM s WHERE rn = 1 GROUP BY pitcher""")
def a12(spark, folder):
    return appearances.game_starts(table(spark, folder, "feed"))


@query("a13_current_team_and_name", """
WITH t AS (SELECT *, CASE inning_topbot WHEN 'Top' THEN home_team ELSE away_team END AS team, row_number() OVER (PARTITION BY pitcher ORDER BY game_date DESC, at_bat_number DESC, pitch_number DESC) AS rn FROM @feed
  WHERE CASE inning_topbot WHEN 'Top' THEN home_team ELSE away_team END <> '')
SELECT pitcher, team FROM t WHERE rn = 1""")
def a13(spark, folder):
    return appearances.current_teams(table(spark, folder, "feed"), "pitcher", appearances.fielding_team())


@query("a14_f10_competitive_swings", """
WITH s AS (SELECT line_key, pitcher, bat_speed, launch_speed FROM @pitches WHERE bat_speed IS NOT NULL AND description IN ('hit_into_play','swinging_strike','swinging_strike_blocked','foul','foul_tip')),
 q AS (SELECT pitcher, quantile_cont(bat_speed, 0.10) AS p10 FROM s GROUP BY pitcher)
SELECT line_key, s.pitcher, bat_speed FROM s JOIN q USING (pitcher) WHERE bat_speed >= p10 - 1e-9 OR (bat_speed >= 60 AND launch_speed >= 90)""")
def a14(spark, folder):
    from statloom.operators.reshape import competitive_swings

    p = table(spark, folder, "pitches").filter(F.col("description").isin(*buckets.TRACKED_SWING_DESCRIPTIONS))
    out = competitive_swings(p.select("line_key", "pitcher", "bat_speed", "launch_speed"), "pitcher")
    return out.drop("launch_speed")


@query("a15_distribution_summary", f"""
SELECT pitch_type, count(launch_speed) AS n, {r6_sql('avg(launch_speed)')} AS mean, {r6_sql('stddev_samp(launch_speed)')} AS std, {r6_sql('median(launch_speed)')} AS median,
 {', '.join(f'{r6_sql(f"quantile_cont(launch_speed, {p})")} AS {n}' for n, p in (('p5', 0.05), ('p25', 0.25), ('p75', 0.75), ('p95', 0.95)))}
FROM @pitches GROUP BY pitch_type""")
def a15(spark, folder):
    d = rates.distribution_summary(table(spark, folder, "pitches"), "launch_speed", ["pitch_type"])
    return r6(d, "mean", "std", "median", "p5", "p25", "p75", "p95")


@query("a15_quantile_sketch_within_error", """
SELECT pitch_type, TRUE AS median_close, TRUE AS p95_close FROM @pitches GROUP BY pitch_type""")
def a15_sketch(spark, folder):
    p = table(spark, folder, "pitches").select("pitch_type", "launch_speed")
    probs = {"median": 0.5, "p95": 0.95}
    a = ranks.approximate_quantiles(p, "launch_speed", ["pitch_type"], probs)
    e = ranks.exact_quantiles(p, "launch_speed", ["pitch_type"], {f"e_{k}": v for k, v in probs.items()}).drop("n")
    j = a.join(e, "pitch_type")
    return j.select("pitch_type", *[(F.abs(F.col(k) - F.col(f"e_{k}")) < 0.5).alias(f"{k}_close") for k in probs])


@query("a16_median_imputation", f"""
WITH m AS (SELECT median(launch_speed) AS ms, median(bat_speed) AS mb FROM @pitches)
SELECT line_key, {r6_sql('coalesce(launch_speed, ms)')} AS launch_speed, {r6_sql('coalesce(bat_speed, mb)')} AS bat_speed FROM @pitches, m""")
def a16(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", "launch_speed", "bat_speed")
    return r6(rates.impute_medians(p, ["launch_speed", "bat_speed"]), "launch_speed", "bat_speed")


@query("a17_a18_weighted_means", f"""
SELECT batter, {r6_sql('sum(launch_speed * release_extension) / nullif(sum(release_extension) FILTER (WHERE launch_speed IS NOT NULL), 0)')} AS launch_speed,
 {r6_sql('sum(tunnel * release_extension) / nullif(sum(release_extension) FILTER (WHERE tunnel IS NOT NULL), 0)')} AS tunnel,
 {r6_sql('sum(release_speed)')} AS speed_total FROM @pitches GROUP BY batter""")
def a17(spark, folder):
    out = rates.weighted_means(
        table(spark, folder, "pitches"), ["batter"], ["launch_speed", "tunnel"], "release_extension",
        {"speed_total": F.sum("release_speed")})
    return r6(out, "launch_speed", "tunnel", "speed_total")


@query("a19_eligibility", """
WITH y AS (SELECT batter, season, sum(release_speed) AS work FROM @pitches GROUP BY ALL),
 e AS (SELECT batter, bool_or(season IN (2000, 2001)) AS recent, count(*) FILTER (WHERE work >= 250) AS n250, max(work) AS top, count(DISTINCT season) AS seasons FROM y GROUP BY batter)
SELECT batter, recent, n250, seasons, (recent AND (n250 >= 2 OR top >= 300)) AS eligible FROM e""")
def a19(spark, folder):
    y = table(spark, folder, "pitches").groupBy("batter", "season").agg(F.sum("release_speed").alias("work"))
    e = y.groupBy("batter").agg(
        F.bool_or(F.col("season").isin(2000, 2001)).alias("recent"), F.count_if(F.col("work") >= 250).alias("n250"),
        F.max("work").alias("top"), F.count_distinct("season").alias("seasons"))
    return e.select("batter", "recent", "n250", "seasons",
                    (F.col("recent") & ((F.col("n250") >= 2) | (F.col("top") >= 300))).alias("eligible"))


@query("a20_team_share", f"""
SELECT player_id, team, {r6_sql('ip / greatest(sum(ip) OVER (PARTITION BY team), 1)')} AS share FROM @players""")
def a20(spark, folder):
    p = table(spark, folder, "players").select("player_id", "team", "ip")
    return r6(rates.share_of_total(p, ["team"], "ip"), "share").drop("ip")


_EVENTS = ("Single", "Double", "Triple", "Home Run", "Walk", "Intent Walk", "Hit By Pitch", "Strikeout",
           "Strikeout Double Play", "Sac Fly", "Groundout", "Catcher Interference")
_EVENT_SQL = "CASE l_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EVENTS)) + " END"


def event_column():
    out = F
    for i, e in enumerate(_EVENTS):
        out = out.when(F.col("l_orderkey") % 12 == i, e)
    return out.otherwise(None)


@query("a21_batting_lines", f"""
WITH e AS (SELECT l_partkey AS batter, {_EVENT_SQL} AS event FROM lineitem),
 l AS (SELECT batter, count(*) AS pa, count(*) FILTER (WHERE event IN ('Single','Double','Triple','Home Run','Strikeout','Strikeout Double Play','Groundout')) AS ab,
  count(*) FILTER (WHERE event IN ('Single','Double','Triple','Home Run')) AS h,
  CAST(sum(CASE event WHEN 'Single' THEN 1 WHEN 'Double' THEN 2 WHEN 'Triple' THEN 3 WHEN 'Home Run' THEN 4 ELSE 0 END) AS BIGINT) AS tb,
  count(*) FILTER (WHERE event LIKE '%Strikeout%') AS k, count(*) FILTER (WHERE event IN ('Walk','Intent Walk')) AS bb,
  count(*) FILTER (WHERE event = 'Hit By Pitch') AS hbp, count(*) FILTER (WHERE event = 'Sac Fly') AS sf FROM e GROUP BY batter)
SELECT *, {half_up_sql('CASE WHEN ab + bb + hbp + sf > 0 THEN (h + bb + hbp) / (ab + bb + hbp + sf) ELSE 0 END', 3)} AS obp,
 {half_up_sql('CASE WHEN ab > 0 THEN tb / ab ELSE 0 END', 3)} AS slg, {half_up_sql('k / pa * 100', 1)} AS k_pct, {half_up_sql('bb / pa * 100', 1)} AS bb_pct FROM l""")
def a21(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("batter"), event_column().alias("event"))
    return rates.batting_lines(li, ["batter"])


def _discipline(w):
    z = zone_sql(w)
    return f"""SELECT batter, {half_up_sql('avg(launch_speed)', 1)} AS avg_ev, {half_up_sql('max(launch_speed)', 1)} AS max_ev,
 {half_up_sql(f"coalesce({pct(f'count(*) FILTER (WHERE {WHIFF})', f'count(*) FILTER (WHERE {SWING})')}, 0)", 1)} AS whiff_pct,
 {half_up_sql(f"coalesce({pct(f'count(*) FILTER (WHERE NOT {z} AND {SWING})', f'count(*) FILTER (WHERE NOT {z})')}, 0)", 1)} AS chase_pct FROM @pitches GROUP BY batter"""


@query("a22_contact_and_discipline", _discipline(0.88))
def a22(spark, folder):
    return rates.contact_and_discipline(table(spark, folder, "pitches"), ["batter"], buckets.ZONE_DISPLAY)


@query("a22_discipline_wide_zone", _discipline(0.95))
def a22_wide(spark, folder):
    return rates.contact_and_discipline(table(spark, folder, "pitches"), ["batter"], buckets.ZONE_WIDE)


@query("a26_era_fip", f"""
WITH l AS (SELECT l_suppkey AS pitcher, CAST(2021 + year(l_shipdate) % 6 AS INT) AS season, CAST(sum(l_linenumber) AS BIGINT) AS outs, count(*) FILTER (WHERE l_returnflag = 'R') AS er,
  count(*) FILTER (WHERE l_linenumber = 7) AS hr, count(*) FILTER (WHERE l_linenumber = 5) AS bb, count(*) FILTER (WHERE l_linenumber = 6) AS hbp, count(*) FILTER (WHERE l_linenumber <= 2) AS k, count(*) AS bf FROM lineitem GROUP BY ALL)
SELECT *, {half_even_sql('floor(outs / 3) + (outs % 3) * 0.1', 1)} AS ip, {r6_sql('CASE WHEN outs > 0 THEN er * 9 / (outs / 3) END')} AS era,
 {r6_sql("CASE WHEN outs > 0 THEN (13 * hr + 3 * (bb + hbp) - 2 * k) / (outs / 3) END + CASE season WHEN 2023 THEN 3.107 WHEN 2024 THEN 3.102 ELSE 3.150 END")} AS fip,
 {r6_sql('k / bf * 100')} AS k_pct, {r6_sql('bb / bf * 100')} AS bb_pct FROM l""")
def a26(spark, folder):
    n = F.col("l_linenumber")
    li = table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("pitcher"), (F.lit(2021) + F.year("l_shipdate") % 6).cast("int").alias("season")
    ).agg(
        F.sum("l_linenumber").alias("outs"), F.count_if(F.col("l_returnflag") == "R").alias("er"),
        F.count_if(n == 7).alias("hr"), F.count_if(n == 5).alias("bb"), F.count_if(n == 6).alias("hbp"),
        F.count_if(n <= 2).alias("k"), F.count(F.lit(1)).alias("bf"))
    return r6(rates.pitching_rates(li), "era", "fip", "k_pct", "bb_pct")


@query("a27_expected_value_by_player", f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY pitcher, game_pk, inning, at_bat_number ORDER BY pitch_number) AS rn FROM @feed WHERE events <> ''),
 t AS (SELECT pitcher, xwoba_est IS NOT NULL AND xwoba_est >= 0 AS known, CASE WHEN xwoba_est >= 0 THEN xwoba_est WHEN events = 'walk' THEN 0.696 WHEN events = 'hit_by_pitch' THEN 0.726 ELSE 0 END AS w FROM e WHERE rn = 1)
SELECT pitcher, count(*) AS pas, CASE WHEN bool_or(known) THEN {half_up_sql('avg(w)', 3)} END AS xwoba FROM t GROUP BY pitcher""")
def a27(spark, folder):
    return appearances.expected_value_by_player(table(spark, folder, "feed"), "pitcher")


@query("a29_null_skipping_grade_means", f"""
SELECT pitcher, pitch_type, {half_up_sql('avg(stuff * 1000)', 1)} AS stuff, {half_up_sql('avg(tunnel * 1000)', 1)} AS tunnel FROM @pitches GROUP BY ALL""")
def a29(spark, folder):
    from statloom.functions.numeric import round_half_up

    return table(spark, folder, "pitches").groupBy("pitcher", "pitch_type").agg(
        round_half_up(F.avg(F.col("stuff") * 1000), 1).alias("stuff"), round_half_up(F.avg(F.col("tunnel") * 1000), 1).alias("tunnel"))


@query("a33_player_summary", f"""
SELECT pitcher, count(*) AS n, {r6_sql('avg(launch_speed)')} AS ev, {r6_sql('avg(bat_speed)')} AS bat_speed,
 {r6_sql(f"avg(CASE WHEN description IN {_in(CONTACT_DESCRIPTIONS)} THEN 1 ELSE 0 END)")} AS contact FROM @pitches WHERE {SWING} GROUP BY pitcher HAVING count(*) >= 150""")
def a33(spark, folder):
    p = table(spark, folder, "pitches").filter(buckets.is_swing("description"))
    p = p.withColumn("contact", buckets.is_contact("description").cast("int"))
    s = rates.player_summary(p, ["pitcher"], {"ev": "launch_speed", "bat_speed": "bat_speed", "contact": "contact"}, 150)
    return r6(s, "ev", "bat_speed", "contact")


@query("a34_player_season_summary", f"""
SELECT pitcher, season, count(*) AS n, {r6_sql('avg(bat_speed)')} AS bat_speed FROM @pitches GROUP BY ALL HAVING count(*) >= 25""")
def a34(spark, folder):
    s = rates.player_summary(table(spark, folder, "pitches"), ["pitcher", "season"], {"bat_speed": "bat_speed"}, 25)
    return r6(s, "bat_speed")


@query("a35_validation_correlation", f"""
SELECT pitch_type, count(*) AS pairs, {r6_sql('corr(bat_speed, launch_speed)')} AS r, {r6_sql('regr_r2(launch_speed, bat_speed)')} AS r2
FROM @pitches WHERE bat_speed IS NOT NULL AND launch_speed IS NOT NULL GROUP BY pitch_type""")
def a35(spark, folder):
    return r6(rates.validate_against(table(spark, folder, "pitches"), ["pitch_type"], "bat_speed", "launch_speed"), "r", "r2")


@query("a36_yearly_counts", "SELECT season, count(*) AS n, count(DISTINCT pitcher) AS players FROM @pitches GROUP BY season")
def a36(spark, folder):
    return rates.yearly_counts(table(spark, folder, "pitches"), "season", "pitcher")


@query("a37_k9_trend_series", f"""
WITH s AS (SELECT pitcher, season, {half_even_sql('avg(release_speed)', 1)} AS velo FROM @pitches GROUP BY ALL)
SELECT pitcher, string_agg(concat(season, ':', CAST(velo AS DECIMAL(9,1))), ',' ORDER BY season) AS trend, count(*) AS seasons FROM s GROUP BY pitcher""")
def a37(spark, folder):
    s = table(spark, folder, "pitches").groupBy("pitcher", "season").agg(round_half_even(F.avg("release_speed"), 1).alias("velo"))
    t = rates.trend_series(s, ["pitcher"], "season", ["velo"])
    text = F.transform("series", lambda x: F.concat(x["season"].cast("string"), F.lit(":"), x["velo"].cast("decimal(9,1)").cast("string")))
    return t.select("pitcher", F.array_join(text, ",").alias("trend"), F.size("series").cast("long").alias("seasons"))


@query("a38_f17_density_grid", f"""
WITH p AS (SELECT pitch_type, stand, (plate_x + 2) / (4e0 / 12) AS cx, (5 - plate_z) / (5e0 / 15) AS cy FROM @pitches WHERE plate_x IS NOT NULL AND plate_z IS NOT NULL),
 c AS (SELECT pitch_type, stand, CAST(floor(cx + 0.5) AS INT) + dx AS col, CAST(floor(cy + 0.5) AS INT) + dy AS row, cx, cy
  FROM p, (SELECT unnest(range(-4, 5)) AS dx), (SELECT unnest(range(-4, 5)) AS dy)),
 g AS (SELECT pitch_type, stand, row, col, sum(exp(-((col - cx) * (col - cx) / (2 * pow(0.35e0 / (4e0 / 12), 2)) + (row - cy) * (row - cy) / (2 * pow(0.35e0 / (5e0 / 15), 2))))) AS density
  FROM c WHERE col BETWEEN 0 AND 11 AND row BETWEEN 0 AND 14 GROUP BY ALL)
SELECT pitch_type, stand, CAST(row AS INT) AS row, CAST(col AS INT) AS col, {r6_sql('density')} AS density, {r6_sql('density / max(density) OVER (PARTITION BY pitch_type, stand)')} AS relative FROM g""")
def a38(spark, folder):
    p = table(spark, folder, "pitches")
    g = grids.density_grid(p, ["pitch_type", "stand"], "plate_x", "plate_z", (-2.0, 2.0), (0.0, 5.0), 12, 15)
    return r6(g, "density", "relative")


@query("a39_slot_and_drag_fits", f"""
SELECT pitch_type, p_throws, CAST(regr_count(pfx_z, arm_angle) AS BIGINT) AS n, {r6_sql('regr_slope(pfx_z, arm_angle)')} AS slope, {r6_sql('regr_intercept(pfx_z, arm_angle)')} AS intercept FROM @pitches GROUP BY ALL""")
def a39(spark, folder):
    return r6(rates.linear_fit(table(spark, folder, "pitches"), ["pitch_type", "p_throws"], "pfx_z", "arm_angle"), "slope", "intercept")


@query("a39_two_predictor_fit", f"""
WITH p AS (SELECT pitch_type, launch_speed AS y, bat_speed AS a, pfx_x AS b FROM @pitches WHERE launch_speed IS NOT NULL AND bat_speed IS NOT NULL),
 m AS (SELECT pitch_type, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS vaa, var_samp(b) AS vbb, covar_samp(a, b) AS vab, covar_samp(a, y) AS vay, covar_samp(b, y) AS vby FROM p GROUP BY pitch_type)
SELECT pitch_type, {r6_sql('(vay * vbb - vby * vab) / (vaa * vbb - vab * vab)', 5)} AS slope_a, {r6_sql('(vby * vaa - vay * vab) / (vaa * vbb - vab * vab)', 5)} AS slope_b,
 {r6_sql('my - (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) * ma - (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) * mb', 5)} AS intercept FROM m""")
def a39_plane(spark, folder):
    f = rates.plane_fit(table(spark, folder, "pitches"), ["pitch_type"], "launch_speed", "bat_speed", "pfx_x")
    return r6(f, "slope_a", "slope_b", "intercept", digits=5)


@query("a40_grade_histogram", f"""
WITH b AS (SELECT pitch_type, CASE WHEN xrv < -0.1 THEN 0 WHEN xrv >= 0.1 THEN 21 ELSE CAST(floor(20 * (xrv - (-0.1e0)) / (0.1e0 - (-0.1e0))) AS INT) + 1 END AS bin FROM (SELECT pitch_type, l * 1e0 AS xrv FROM (SELECT pitch_type, (launch_angle / 500e0) AS l FROM @pitches) WHERE l IS NOT NULL))
SELECT pitch_type, CAST(bin AS INT) AS bin, count(*) AS n, {r6_sql('count(*) / sum(count(*)) OVER (PARTITION BY pitch_type)')} AS share FROM b GROUP BY pitch_type, bin""")
def a40(spark, folder):
    p = table(spark, folder, "pitches").select("pitch_type", (F.col("launch_angle") / 500).alias("v"))
    return r6(rates.histogram(p, "v", ["pitch_type"], -0.1, 0.1, 20), "share")


@query("a41_run_summary", """
SELECT season, count(*) AS rows, count(*) FILTER (WHERE launch_speed >= 95) AS qualified, min(release_speed) AS lowest, max(release_speed) AS highest FROM @pitches GROUP BY season""")
def a41(spark, folder):
    return rates.run_summary(table(spark, folder, "pitches"), ["season"], "release_speed", buckets.is_hard_hit("launch_speed"))
