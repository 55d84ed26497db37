"""Percentiles, ranks, grades, ordered-sequence and rolling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import buckets
from statloom.functions.numeric import round_half_even
from statloom.operators import appearances, entities, keys, norms, ranks, rates, ratings, reshape
from statloom.plans.registry import half_even_sql, pct_rank_sql, query, r6, r6_sql, strict_sql, table
from statloom.session import cut


@query("flagship_percentile_leaderboard", f"""
WITH g AS (SELECT pitcher, pitch_type, count(*) AS n, avg(release_speed) AS m FROM @pitches GROUP BY ALL HAVING count(*) >= 10),
     v AS (SELECT pitcher, pitch_type, n, {half_even_sql('m', 3)} AS velo FROM g)
SELECT pitcher, pitch_type, n, velo, {strict_sql('velo', 'pitch_type')} AS pctile,
       row_number() OVER (PARTITION BY pitch_type ORDER BY velo DESC, pitcher) AS rank
FROM v""")
def flagship(spark, folder):
    p = table(spark, folder, "pitches")
    g = p.groupBy("pitcher", "pitch_type").agg(
        F.count(F.lit(1)).alias("n"), round_half_even(F.avg("release_speed"), 3).alias("velo")
    ).filter(F.col("n") >= 10)
    g = cut(g, "qualified")
    scored = ranks.add_strict_percentile(g, "velo", ["pitch_type"])
    return ranks.leaderboard(scored, "velo", ["pitch_type"], "pitcher", ascending=False)


@query("w1_average_tie_percentile_rank", f"""
SELECT player_id, pos_group, onice_xgf_per60 AS value, {r6_sql(pct_rank_sql('onice_xgf_per60', 'pos_group'))} AS pct_rank
FROM @skaters""")
def w1(spark, folder):
    s = table(spark, folder, "skaters").select("player_id", "pos_group", F.col("onice_xgf_per60").alias("value"))
    return r6(ranks.add_percentile_rank(s, "value", ["pos_group"]), "pct_rank")


@query("w1_percentile_rank_of_pitches", f"""
SELECT line_key, pitch_type, launch_speed, {r6_sql(pct_rank_sql('launch_speed', 'pitch_type'))} AS pct_rank FROM @pitches""")
def w1_pitches(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", "pitch_type", "launch_speed")
    return r6(ranks.add_percentile_rank(p, "launch_speed", ["pitch_type"]), "pct_rank")


@query("w2_strict_percentile", f"""
SELECT player_id, team, pa, {strict_sql('pa', 'team')} AS pctile FROM @players""")
def w2(spark, folder):
    p = table(spark, folder, "players").select("player_id", "team", "pa")
    return ranks.add_strict_percentile(p, "pa", ["team"])


@query("w3_lower_is_better", f"""
SELECT player_id, position, pa, {strict_sql('pa', 'position', True)} AS pctile FROM @players""")
def w3(spark, folder):
    p = table(spark, folder, "players").select("player_id", "position", "pa")
    return ranks.add_strict_percentile(p, "pa", ["position"], lower_better=True)


@query("w4_role_split_percentile", f"""
WITH p AS (SELECT player_id, CASE WHEN gs > 0 THEN gs ELSE 0 END >= 10 AS is_starter, pa FROM @players)
SELECT player_id, is_starter, pa, {strict_sql('pa', 'is_starter', True)} AS pctile FROM p""")
def w4(spark, folder):
    p = table(spark, folder, "players").select(
        "player_id", appearances.classify_role("gs").alias("is_starter"), "pa")
    return ranks.add_strict_percentile(p, "pa", ["is_starter"], lower_better=True)


@query("w5_inverted_z_grade", f"""
WITH g AS (SELECT pitcher, pitch_type, count(*) AS n, avg(xrv) * 100 AS v FROM @pitches GROUP BY ALL HAVING count(*) >= 50),
 z AS (SELECT *, avg(v) OVER (PARTITION BY pitch_type) AS m, stddev_samp(v) OVER (PARTITION BY pitch_type) AS s FROM g)
SELECT pitcher, pitch_type, n, {half_even_sql('100 - (v - m) / s * 10', 1)} AS grade FROM z WHERE s > 0""")
def w5(spark, folder):
    g = table(spark, folder, "pitches").groupBy("pitcher", "pitch_type").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("xrv") * 100).alias("v")).filter("n >= 50")
    return norms.inverted_z_grade(g, "v", "pitch_type").drop("v")


@query("w6_log_grade", """
WITH g AS (SELECT batter, season, avg(release_speed * release_speed / 1000) AS v, count(*) AS n FROM @pitches GROUP BY ALL HAVING count(*) >= 3),
 l AS (SELECT *, ln(greatest(v, 1e-10)) AS x FROM g),
 z AS (SELECT *, avg(x) OVER (PARTITION BY season) AS m, stddev_samp(x) OVER (PARTITION BY season) AS s FROM l)
SELECT batter, season, n, CASE WHEN s > 0 THEN round_even(100 + (x - m) / s * 15, 0) END AS grade FROM z""")
def w6(spark, folder):
    g = table(spark, folder, "pitches").groupBy("batter", "season").agg(
        F.avg(F.col("release_speed") * F.col("release_speed") / 1000).alias("v"), F.count(F.lit(1)).alias("n")
    ).filter("n >= 3")
    return norms.log_grade(g, "v", ["season"]).drop("v")


@query("w7_l11_component_grades", f"""
WITH p AS (SELECT line_key, CASE WHEN season % 2 = 0 THEN 'MLB' ELSE 'AAA' END AS level, pitch_type, stuff, location, tunnel FROM @pitches),
 long AS (SELECT line_key, level, pitch_type, 'stuff' AS component, stuff AS value FROM p UNION ALL
          SELECT line_key, level, pitch_type, 'location', location FROM p UNION ALL
          SELECT line_key, level, pitch_type, 'tunnel', tunnel FROM p),
 t AS (SELECT level, component, pitch_type, avg(value) AS tm, stddev_samp(value) AS ts FROM long GROUP BY ALL),
 g AS (SELECT level, component, avg(value) AS gm, stddev_samp(value) AS gs FROM long GROUP BY ALL),
 j AS (SELECT long.*, tm, ts, gm, gs, CASE component WHEN 'stuff' THEN 'hybrid' WHEN 'location' THEN 'per-type' ELSE 'global' END AS mode
       FROM long JOIN t USING (level, component, pitch_type) JOIN g USING (level, component))
SELECT line_key, level, pitch_type, component, mode,
  {r6_sql("CASE mode WHEN 'per-type' THEN 100 - (value - tm) / ts * 10 WHEN 'global' THEN 100 - (value - gm) / gs * 10 ELSE 100 - (value - gm) / ts * 10 END")} AS grade
FROM j""")
def w7(spark, folder):
    p = table(spark, folder, "pitches").select(
        "line_key", F.when(F.col("season") % 2 == 0, "MLB").otherwise("AAA").alias("level"), "pitch_type",
        "stuff", "location", "tunnel")
    n = cut(norms.norm_table(p, ["stuff", "location", "tunnel"], "level", "pitch_type"), "norms")
    g = norms.component_grades(
        p, n, ["line_key"], {"stuff": "hybrid", "location": "per-type", "tunnel": "global"}, "level", "pitch_type")
    return r6(g, "grade").drop("value")


_SHARES = """SELECT player_id, pos_group, CASE WHEN coalesce(cnt_dz,0)+coalesce(cnt_oz,0)+coalesce(cnt_nz,0) > 0
  THEN coalesce(cnt_oz,0) / (coalesce(cnt_dz,0)+coalesce(cnt_oz,0)+coalesce(cnt_nz,0)) * 100 ELSE 33.3 END AS oz FROM @skaters"""


@query("w8_w18_deployment_factor", f"""
WITH s AS ({_SHARES}), z AS (SELECT *, avg(oz) OVER (PARTITION BY pos_group) AS m, stddev_samp(oz) OVER (PARTITION BY pos_group) AS d FROM s)
SELECT player_id, pos_group, {r6_sql('oz')} AS oz_shift_pct,
 {r6_sql('CASE WHEN d > 0 THEN least(greatest((oz - m) / d, -1), 1) ELSE 0 END')} AS deployment_factor FROM z""")
def w8(spark, folder):
    s = table(spark, folder, "skaters").select(
        "player_id", "pos_group", norms.zone_start_share("cnt_oz", ["cnt_dz", "cnt_oz", "cnt_nz"]).alias("oz_shift_pct"))
    return r6(norms.deployment_factor(s, "oz_shift_pct", "pos_group"), "oz_shift_pct", "deployment_factor")


@query("w9_first_and_last_per_key", """
SELECT game_pk, arg_min(pitcher, pitch_number) AS first_pitcher, arg_max(pitcher, pitch_number) AS last_pitcher,
 arg_max(CASE WHEN xwoba_est IS NOT NULL THEN pitch_number END, CASE WHEN xwoba_est IS NOT NULL THEN pitch_number END) AS last_valued
FROM @feed GROUP BY game_pk""")
def w9(spark, folder):
    f = table(spark, folder, "feed")
    valued = F.when(F.col("xwoba_est").isNotNull(), F.col("pitch_number"))
    return f.groupBy("game_pk").agg(
        F.min_by("pitcher", "pitch_number").alias("first_pitcher"),
        F.max_by("pitcher", "pitch_number").alias("last_pitcher"),
        F.max_by("pitch_number", valued).alias("last_valued"))


@query("w10_m24_over_expected_by_bin", f"""
WITH p AS (SELECT line_key, bat_speed, plate_x FROM @pitches),
 r AS (SELECT min(plate_x) AS lo, max(plate_x) AS hi FROM p),
 b AS (SELECT p.*, CASE WHEN plate_x IS NOT NULL THEN least(greatest(ceil((plate_x - lo) / ((hi - lo) / 20)), 1), 20) END AS bin FROM p, r),
 m AS (SELECT bin, avg(bat_speed) AS mean FROM b GROUP BY bin)
SELECT line_key, {r6_sql('coalesce(CASE WHEN b.bin IS NOT NULL THEN bat_speed - mean END, 0)')} AS over_expected
FROM b LEFT JOIN m ON b.bin = m.bin""")
def w10(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", "bat_speed", "plate_x")
    return r6(norms.over_expected(p, "bat_speed", "plate_x"), "over_expected").select("line_key", "over_expected")


@query("w11_count_before_pitch", """
SELECT pitch_number, pitcher, game_pk,
 CAST(coalesce(last_value(balls_after IGNORE NULLS) OVER w, 0) AS INT) AS balls, CAST(coalesce(last_value(strikes_after IGNORE NULLS) OVER w, 0) AS INT) AS strikes
FROM @feed WINDOW w AS (PARTITION BY pitcher, game_pk ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w11(spark, folder):
    f = table(spark, folder, "feed").drop("strikes")
    c = appearances.count_before(f, ["pitcher", "game_pk"], ["pitch_number"])
    return c.select("pitch_number", "pitcher", "game_pk", "balls", "strikes")


@query("w12_pitch_index", """
SELECT pitch_number, pitcher, game_pk, row_number() OVER (PARTITION BY pitcher, game_pk, at_bat_number, inning ORDER BY pitch_number) - 1 AS idx,
 count(*) OVER (PARTITION BY pitcher, game_pk, at_bat_number, inning) AS n_pitches FROM @feed""")
def w12(spark, folder):
    f = table(spark, folder, "feed").select("pitch_number", *appearances.PA_KEYS)
    return appearances.pitch_index(f).select("pitch_number", "pitcher", "game_pk", "idx", "n_pitches")


@query("w13_leaderboard_rank_and_bar", f"""
WITH g AS (SELECT pitcher, {half_even_sql('avg(value)', 2)} AS v FROM @feed GROUP BY pitcher), t AS (SELECT *, pitcher % 2 AS pool FROM g)
SELECT pitcher, pool, v, row_number() OVER (PARTITION BY pool ORDER BY v, pitcher) AS rank,
 {r6_sql('CASE WHEN max(v) OVER (PARTITION BY pool) > min(v) OVER (PARTITION BY pool) THEN (max(v) OVER (PARTITION BY pool) - v) / (max(v) OVER (PARTITION BY pool) - min(v) OVER (PARTITION BY pool)) * 85 + 15 ELSE 50 END')} AS bar
FROM t""")
def w13(spark, folder):
    g = table(spark, folder, "feed").groupBy("pitcher").agg(round_half_even(F.avg("value"), 2).alias("v"))
    g = cut(g.withColumn("pool", F.col("pitcher") % 2), "board")
    return r6(ranks.bar_length(ranks.leaderboard(g, "v", ["pool"], "pitcher"), "v", ["pool"]), "bar")


@query("w14_rolling_60_day_baselines", f"""
WITH d AS (SELECT pitcher, game_date AS day, count(*) AS n, sum(release_speed) AS s, sum(pfx_x) AS px FROM @pitches
  WHERE pitch_type IN ('FF', 'SI') GROUP BY ALL)
SELECT pitcher, day, CAST(sum(n) OVER w AS BIGINT) AS n, {r6_sql('sum(s) OVER w / sum(n) OVER w')} AS release_speed, {r6_sql('sum(px) OVER w / sum(n) OVER w')} AS pfx_x
FROM d WINDOW w AS (PARTITION BY pitcher ORDER BY day RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW)""")
def w14(spark, folder):
    fb = table(spark, folder, "pitches").filter(F.col("pitch_type").isin("FF", "SI"))
    return r6(rates.rolling_day_means(fb, "pitcher", "game_date", ["release_speed", "pfx_x"], 60), "release_speed", "pfx_x")


@query("w15_rolling_three_starts", f"""
WITH s AS (SELECT pitcher, game_pk, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM @feed GROUP BY ALL),
 r AS (SELECT pitcher, game_pk, row_number() OVER (PARTITION BY pitcher ORDER BY game_pk) - 1 AS start_no,
  sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM s
  WINDOW w AS (PARTITION BY pitcher ORDER BY game_pk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT pitcher, game_pk, start_no, CAST(n AS BIGINT) AS n, {r6_sql('s / n', 9)} AS mean,
 {r6_sql('CASE WHEN n > 1 THEN sqrt(greatest(q - s * s / n, 0) / (n - 1)) END', 4)} AS std FROM r""")
def w15(spark, folder):
    f = table(spark, folder, "feed").select("pitcher", "game_pk", "value")
    return r6(rates.rolling_starts(f, "pitcher", ["game_pk"], ["game_pk"], "value"), "std", digits=4).transform(lambda d: r6(d, "mean", digits=9))


@query("w16_name_disambiguation", """
WITH p AS (SELECT player_id, concat(first_name, ' ', last_name) AS name, team FROM @players)
SELECT player_id, name, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN concat(name, ' (', coalesce(team, '?'), ')') ELSE name END AS display_name FROM p""")
def w16(spark, folder):
    p = table(spark, folder, "players").select(
        "player_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "team")
    return entities.disambiguate(p, "name", "team").drop("team")


def _teammate_sql() -> str:
    def pr(c, inv=False):
        base = pct_rank_sql(c, "pos_group")
        return f"CASE WHEN {c} IS NOT NULL THEN {'(1 - ' + base + ')' if inv else base} * 100 END"

    def mix(a, b, c):
        return (f"(coalesce({a} * 0.4, 0) + coalesce({b} * 0.2, 0) + coalesce({c} * 0.4, 0)) / nullif("
                f"CASE WHEN {a} IS NULL THEN 0 ELSE 0.4 END + CASE WHEN {b} IS NULL THEN 0 ELSE 0.2 END + CASE WHEN {c} IS NULL THEN 0 ELSE 0.4 END, 0)")

    cols = ", ".join([*ratings.ATTACK_COLUMNS, *ratings.DEFENCE_COLUMNS])

    def factor(v):
        return f"least(greatest((({v} - avg({v}) OVER g) / greatest(stddev_pop({v}) OVER g, 1)) * -0.5, -0.65), 0.65)"

    out = [f"{r6_sql(f'{c} + {factor('att')} * greatest(stddev_samp({c}) OVER g, 0.01)')} AS {c}" for c in ratings.ATTACK_COLUMNS]
    out += [f"{r6_sql(f'{c} - {factor('def')} * greatest(stddev_samp({c}) OVER g, 0.01)')} AS {c}" for c in ratings.DEFENCE_COLUMNS]
    return f"""WITH s AS (SELECT * FROM @skaters WHERE pos_group IS NOT NULL),
 p AS (SELECT player_id, pos_group, {cols}, {pr('qot_rapm_xgf')} AS a1, {pr('qot_rapm_cf')} AS a2, {pr('qot_off_xgar')} AS a3,
  {pr('qot_rapm_xga', True)} AS d1, {pr('qot_rapm_ca', True)} AS d2, {pr('qot_def_xgar')} AS d3, {pr('qot_rapm_xg')} AS x FROM s),
 m AS (SELECT *, coalesce({mix('a1', 'a2', 'a3')}, x, 50) AS att, coalesce({mix('d1', 'd2', 'd3')}, x, 50) AS def FROM p)
SELECT player_id, {', '.join(out)} FROM m WINDOW g AS (PARTITION BY pos_group)"""


@query("w17_teammate_adjustment", _teammate_sql())
def w17(spark, folder):
    s = table(spark, folder, "skaters").filter(F.col("pos_group").isNotNull())
    moved = [*ratings.ATTACK_COLUMNS, *ratings.DEFENCE_COLUMNS]
    return r6(ratings.teammate_adjustment(s).select("player_id", *moved), *moved)


@query("t1_sort_nulls_last", """SELECT player_id, name, pa, row_number() OVER (PARTITION BY role ORDER BY pa DESC NULLS LAST, player_id) AS place, role FROM @players""")
def t1(spark, folder):
    p = table(spark, folder, "players").select("player_id", "name", "pa", "role")
    placed = ranks.leaderboard(p, "pa", ["role"], "player_id", ascending=False, rank="place")
    return placed.orderBy(F.desc_nulls_last("pa"), "player_id")


@query("t2_top_and_bottom_25", """
WITH g AS (SELECT batter, round_even(avg(release_speed) * 1e6, 0) / 1e6 AS v FROM @pitches GROUP BY batter)
SELECT * FROM (SELECT 'top' AS side, batter, v FROM g ORDER BY v DESC, batter LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'bottom' AS side, batter, v FROM g ORDER BY v, batter LIMIT 25)""")
def t2(spark, folder):
    g = table(spark, folder, "pitches").groupBy("batter").agg(round_half_even(F.avg("release_speed"), 6).alias("v"))
    top = g.orderBy(F.desc("v"), "batter").limit(25).select(F.lit("top").alias("side"), "batter", "v")
    low = g.orderBy("v", "batter").limit(25).select(F.lit("bottom").alias("side"), "batter", "v")
    return top.unionByName(low)


@query("t3_top_ten_per_type", """
WITH g AS (SELECT pitch_type, pitcher, count(*) AS n FROM @pitches GROUP BY ALL HAVING count(*) >= 10)
SELECT pitch_type, pitcher, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY pitch_type ORDER BY n DESC, pitcher) AS rank FROM g) WHERE rank <= 10""")
def t3(spark, folder):
    g = table(spark, folder, "pitches").groupBy("pitch_type", "pitcher").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    return keys.top_n_per_group(g, ["pitch_type"], [F.desc("n"), F.col("pitcher")], 10)


@query("t4_even_stride_points", """
WITH r AS (SELECT pitch_number, pitcher, row_number() OVER (PARTITION BY pitcher ORDER BY pitch_number) - 1 AS i, count(*) OVER (PARTITION BY pitcher) AS n FROM @feed)
SELECT pitch_number, pitcher FROM r WHERE n <= 20 OR i = 0 OR floor(i / (n / 20e0)) <> floor((i - 1) / (n / 20e0))""")
def t4(spark, folder):
    f = table(spark, folder, "feed").select("pitch_number", "pitcher")
    return reshape.even_stride(f, ["pitcher"], ["pitch_number"], 20)


@query("t5_types_by_frequency", """
WITH g AS (SELECT pitcher, pitch_type, count(*) AS n FROM @pitches GROUP BY ALL)
SELECT pitcher, pitch_type, n, place FROM (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY n DESC, pitch_type) AS place FROM g) WHERE place <= 9""")
def t5(spark, folder):
    g = table(spark, folder, "pitches").groupBy("pitcher", "pitch_type").agg(F.count(F.lit(1)).alias("n"))
    return keys.top_n_per_group(g, ["pitcher"], [F.desc("n"), F.col("pitch_type")], 9, "place")


@query("t6_latest_games_first", """
SELECT game_date, CAST(count(DISTINCT game_pk) AS BIGINT) AS games FROM @pitches GROUP BY game_date ORDER BY game_date DESC""")
def t6(spark, folder):
    p = table(spark, folder, "pitches")
    return p.groupBy("game_date").agg(F.count_distinct("game_pk").alias("games")).orderBy(F.desc("game_date"))


@query("c11_effectiveness", f"""
WITH g AS (SELECT pitch_type, pitcher, avg(release_speed) AS v FROM @pitches GROUP BY ALL),
 d AS (SELECT *, least(greatest((v - CASE pitch_type WHEN 'FF' THEN 94.5 WHEN 'SI' THEN 93.9 WHEN 'SL' THEN 86.3 WHEN 'CU' THEN 79.8 WHEN 'CH' THEN 86.0 WHEN 'FS' THEN 86.2 ELSE 88.0 END) / 2.0, -1), 1) AS e FROM g),
 k AS (SELECT *, least(greatest((v - 86.5) / 2.5, -1), 1) AS t FROM d)
SELECT pitch_type, pitcher, {r6_sql('CASE WHEN abs(e) < 0.08 THEN 0 ELSE e END')} AS vs_type, {r6_sql('CASE WHEN abs(-t) < 0.05 THEN 0 ELSE -t END')} AS vs_thresholds FROM k""")
def c11(spark, folder):
    # Mean speed by pitch type.
    speeds = {"FF": 94.5, "SI": 93.9, "SL": 86.3, "CU": 79.8, "CH": 86.0, "FS": 86.2}
    g = table(spark, folder, "pitches").groupBy("pitch_type", "pitcher").agg(F.avg("release_speed").alias("v"))
    avg = F
    for t, s in speeds.items():
        avg = avg.when(F.col("pitch_type") == t, s)
    out = g.select(
        "pitch_type", "pitcher", buckets.effectiveness("v", avg.otherwise(88.0), F.lit(2.0)).alias("vs_type"),
        buckets.threshold_effectiveness("v", 84, 86, 89, "low").alias("vs_thresholds"))
    return r6(out, "vs_type", "vs_thresholds")


@query("c12_bands_and_tiers", f"""
WITH p AS (SELECT player_id, {strict_sql('pa', 'role')} AS pctile, 60 + player_id % 90 AS grade FROM @players)
SELECT player_id, CASE WHEN pctile IS NULL THEN 'NA' WHEN pctile >= 90 THEN '90-100' WHEN pctile >= 75 THEN '75-90' WHEN pctile >= 55 THEN '55-75'
 WHEN pctile >= 45 THEN '45-55' WHEN pctile >= 25 THEN '25-45' WHEN pctile >= 10 THEN '10-25' ELSE '0-10' END AS band,
 CASE WHEN grade >= 130 THEN 'Elite' WHEN grade >= 115 THEN 'Above Avg' WHEN grade >= 100 THEN 'Average' WHEN grade >= 85 THEN 'Below Avg' ELSE 'Poor' END AS tier FROM p""")
def c12(spark, folder):
    p = ranks.add_strict_percentile(table(spark, folder, "players").select("player_id", "role", "pa"), "pa", ["role"])
    return p.select("player_id", buckets.percentile_band("pctile").alias("band"),
                    buckets.rating_tier(F.lit(60) + F.col("player_id") % 90).alias("tier"))
