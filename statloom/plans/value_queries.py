"""Column functions: names, codes, numbers, dates, flight; and projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import buckets, curve, dates, names, numeric, physics, sql
from statloom.operators import appearances, entities, joins, reshape
from statloom.plans.aggregate_queries import ANGLE, BUCKET, SWING, WHIFF, _in, zone_sql
from statloom.plans.registry import half_even_sql, half_up_sql, query, r6, r6_sql, strict_sql, table

# --- names and keys -------------------------------------------------------------------------------


def _suffix_key(c: str) -> str:
    k = f"replace(regexp_replace(lower(strip_accents({c})), '[.,]', '', 'g'), '-', ' ')"
    for s in names.SUFFIXES:
        k = f"regexp_replace({k}, ' {s}$', '')"
    return f"trim(regexp_replace({k}, '\\s+', ' ', 'g'))"


def _ascii_key(c: str) -> str:
    k = f"regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\x00-\\x7f]', '', 'g'), '[.''\\-]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({k}, '\\s*\\([dclr]w?\\)\\s*$', ''), '\\s+', ' ', 'g'))"


def _token_key(c: str) -> str:
    k = f"regexp_replace(lower(strip_accents({c})), '[.\\-,]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({k}, '\\b(jr|sr|ii|iii|iv)\\b', '', 'g'), '\\s+', ' ', 'g'))"


@query("n1_n2_n3_name_keys", f"""
SELECT player_id, name, {_suffix_key('name')} AS suffix_key, {_ascii_key('name')} AS ascii_key, {_token_key('name')} AS token_key FROM @players""")
def n1(spark, folder):
    p = table(spark, folder, "players")
    return p.select("player_id", "name", *[names.name_key("name", s).alias(f"{s}_key") for s in ("suffix", "ascii", "token")])


@query("n1_accent_folding_of_texts", """
SELECT doc_id, lang, md5(lower(strip_accents(text))) AS folded_md5 FROM documents""")
def n1_texts(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", "lang", F.md5(names.search_key("text")).alias("folded_md5"))


@query("n4_alias_replacement", """
WITH a(variant, spelling) AS (SELECT DISTINCT lower(p_type), lower(concat(p_type, ' type')) FROM part WHERE p_type <> 'SMALL')
SELECT p_partkey, coalesce(spelling, lower(p_type)) AS label FROM part LEFT JOIN a ON variant = lower(p_type)""")
def n4(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.lower("p_type").alias("label"))
    a = table(spark, folder, "part").filter("p_type <> 'SMALL'").select(
        F.lower("p_type").alias("variant"), F.lower(F.concat("p_type", F.lit(" type"))).alias("spelling")).distinct()
    return joins.apply_aliases(p, "label", a)


@query("n5_n6_name_order", """
SELECT player_id, regexp_replace(listed, '^(.*?), (.*)$', '\\2 \\1') AS flipped, concat_ws(' ', first_name, last_name) AS full_name FROM @players""")
def n5(spark, folder):
    return table(spark, folder, "players").select(
        "player_id", names.flip_last_first("listed").alias("flipped"), names.full_name("first_name", "last_name").alias("full_name"))


@query("n7_n8_position_and_team", f"""
WITH p AS (SELECT player_id, trim(split_part(upper(trim(position)), ',', 1)) AS pos, upper(trim(string_split(team, ',')[-1])) AS t FROM @players)
SELECT player_id, CASE WHEN pos IN {_in(names.DEFENCE_CODES)} THEN 'D' WHEN pos IN {_in(names.FORWARD_CODES)} THEN 'F' END AS pos_group,
 CASE t WHEN 'T.B' THEN 'TBL' WHEN 'S.J' THEN 'SJS' WHEN 'N.J' THEN 'NJD' WHEN 'L.A' THEN 'LAK' ELSE t END AS team FROM p""")
def n7(spark, folder):
    return table(spark, folder, "players").select(
        "player_id", names.position_group("position").alias("pos_group"), names.standard_team("team").alias("team"))


@query("f12_position_group_filter", f"""
WITH p AS (SELECT player_id, trim(split_part(upper(trim(position)), ',', 1)) AS pos FROM @players)
SELECT player_id, CASE WHEN pos IN {_in(names.DEFENCE_CODES)} THEN 'D' ELSE 'F' END AS pos_group FROM p WHERE pos IN {_in(names.DEFENCE_CODES + names.FORWARD_CODES)}""")
def f12(spark, folder):
    p = table(spark, folder, "players").select("player_id", names.position_group("position").alias("pos_group"))
    return p.filter(F.col("pos_group").isin("F", "D"))


@query("n9_country_lookup", f"""
WITH c AS (SELECT {_ascii_key("concat('Team ', n_name)")} AS k, min(n_name) AS country FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1)
SELECT player_id, country FROM @players LEFT JOIN c ON k = concat('team nation_', nation)""")
def n9(spark, folder):
    n = table(spark, folder, "nation").filter("n_nationkey % 3 <> 0").select(
        names.search_key(names.strip_team_prefix(F.concat(F.lit("Team "), "n_name"))).alias("__k"), F.col("n_name").alias("country"))
    p = table(spark, folder, "players").select("player_id", F.concat(F.lit("nation_"), F.col("nation")).alias("__k"))
    from statloom.operators.keys import lookup

    return lookup(p, n, ["__k"]).drop("__k")


@query("n10_composite_keys", """
SELECT line_key, concat(game_pk, '_', at_bat_number - 1, '_', pitch_number) AS key FROM @pitches""")
def n10(spark, folder):
    return table(spark, folder, "pitches").select("line_key", names.pitch_key("game_pk", "at_bat_number", "pitch_number").alias("key"))


@query("n11_p3_number_parsing", f"""
SELECT page_id, CAST(TRY_CAST(tail AS DOUBLE) AS DOUBLE) AS number, CASE WHEN TRY_CAST(tail AS DOUBLE) > 0 THEN {half_even_sql('TRY_CAST(tail AS DOUBLE) / 1000', 3)} END AS positive
FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS tail FROM pages)""")
def n11(spark, folder):
    p = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("tail"))
    quoted = F.concat(F.lit("'"), F.col("tail"), F.lit('"'))
    thousandth = numeric.parse_positive(quoted, 0) / 1000
    return p.select("page_id", numeric.to_number("tail").alias("number"), numeric.round_half_even(thousandth, 3).alias("positive"))


@query("n12_season_labels", """
SELECT DISTINCT y AS season, concat(lpad(CAST(y % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')) AS label, concat(y, y + 1) AS span FROM (SELECT year(o_orderdate) AS y FROM orders)""")
def n12(spark, folder):
    o = table(spark, folder, "orders").select(dates.season_of("o_orderdate").alias("season")).distinct()
    return o.select("season", names.season_label("season").alias("label"), names.season_span("season").alias("span"))


@query("n13_team_name_strip", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('Nation ', s_nationkey) WHEN s_suppkey % 3 = 1 THEN concat('Steam ', s_nationkey) ELSE concat('x team ', s_nationkey) END AS country,
 concat('club ', s_nationkey) AS parent FROM supplier""")
def n13(spark, folder):
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("TEAM  Nation "), "s_nationkey")).when(k == 1, F.concat(F.lit("Steam "), "s_nationkey")).otherwise(
        F.concat(F.lit("x team "), "s_nationkey"))
    squad = F.when(k == 0, F.concat(F.lit("Club "), "s_nationkey", F.lit(" Prospects"))).when(
        k == 1, F.concat(F.lit("CLUB "), "s_nationkey", F.lit(" prospect "))).otherwise(F.concat(F.lit("club "), "s_nationkey"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", names.strip_team_prefix(raw).alias("country"), names.parent_team_key(squad).alias("parent"))


@query("n15_event_words", """
SELECT doc_id, lower(text) LIKE '%the%' OR lower(text) LIKE '%tion%' AS has_word, lower(text) LIKE '%http%' AS has_link FROM documents""")
def n15(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", names.contains_any("text", ["the", "tion"]).alias("has_word"), names.contains_any("text", ["http"]).alias("has_link"))


@query("n16_pitch_names", """
SELECT line_key, CASE pitch_type WHEN 'FF' THEN '4-Seam' WHEN 'SI' THEN 'Sinker' WHEN 'SL' THEN 'Slider' WHEN 'CU' THEN 'Curveball' WHEN 'CH' THEN 'Changeup' ELSE 'XX' END AS pitch_name FROM @pitches""")
def n16(spark, folder):
    code = F.when(F.col("pitch_type") == "FS", "XX").otherwise(F.col("pitch_type"))
    return table(spark, folder, "pitches").select("line_key", names.pitch_name(code).alias("pitch_name"))


@query("f13_accent_insensitive_search", """
SELECT player_id, name, team FROM @players WHERE strip_accents(lower(name)) LIKE '%munoz1%' OR strip_accents(lower(team)) LIKE '%munoz1%'""")
def f13(spark, folder):
    return table(spark, folder, "players").filter(reshape.matches_search("MUÑOZ1", "name", "team")).select("player_id", "name", "team")


# --- numbers, dates -------------------------------------------------------------------------------


def _curve_sql(p: str) -> str:
    c = ", ".join(repr(x) for x in curve.series_coefficients())
    u = f"least({p} / 98.5, 1)"

    def half(x):
        return f"pow({x}, 1.3) * list_sum(list_transform(range({curve.TERMS}), lambda n: [{c}][n + 1] * pow({x}, n)))"

    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0 THEN 0 WHEN {u} >= 1 THEN 100 "
            f"WHEN {u} <= 0.5 THEN 100 * {half(u)} ELSE 100 * (1 - {half(f'(1 - {u})')}) END")


@query("m1_x1_percentile_stretch", f"""
WITH p AS (SELECT player_id, {strict_sql('pa', 'role')} AS p FROM @players) SELECT player_id, {r6_sql(_curve_sql('p'))} AS stretched FROM p""")
def m1(spark, folder):
    from statloom.operators.ranks import add_strict_percentile

    p = add_strict_percentile(table(spark, folder, "players").select("player_id", "role", "pa"), "pa", ["role"], "p")
    return r6(p.select("player_id", curve.stretch_percentile("p").alias("stretched")), "stretched")


@query("m2_m3_buckets", f"SELECT line_key, {ANGLE} AS angle_bucket, {BUCKET} AS count_bucket, CASE {BUCKET} WHEN 'ahead' THEN 'behind' WHEN 'behind' THEN 'ahead' ELSE {BUCKET} END AS hitter_bucket FROM @pitches")
def m2(spark, folder):
    c = buckets.count_bucket("balls", "strikes")
    return table(spark, folder, "pitches").select(
        "line_key", buckets.angle_bucket("launch_angle").alias("angle_bucket"), c.alias("count_bucket"), buckets.hitter_bucket(c).alias("hitter_bucket"))


@query("m4_pitch_groups", """
WITH c AS (SELECT p_partkey, ['FF','SI','FC','FA','SL','CU','KC','CS','SV','ST','KN','CH','FS','SC','FO','EP','XX'][p_partkey % 17 + 1] AS code FROM part)
SELECT p_partkey, code, CASE WHEN code IN ('FF','SI','FC','FA') THEN 'Fastball' WHEN code IN ('SL','CU','KC','CS','SV','ST','KN') THEN 'Breaking' WHEN code IN ('CH','FS','SC','FO') THEN 'Offspeed' ELSE 'Other' END AS pitch_group,
 CASE WHEN code IN ('FF','SI','FC','FA') THEN 'fastball' WHEN code IN ('SL','CU','KC','CS','SV','ST') THEN 'breaking' WHEN code IN ('CH','FS','SC','FO','KN','EP') THEN 'offspeed' ELSE 'other' END AS pitch_family FROM c""")
def m4(spark, folder):
    codes = ["FF", "SI", "FC", "FA", "SL", "CU", "KC", "CS", "SV", "ST", "KN", "CH", "FS", "SC", "FO", "EP", "XX"]
    code = buckets.label_of(F.col("p_partkey") % 17, codes)
    p = table(spark, folder, "part").select("p_partkey", code.alias("code"))
    return p.select("*", buckets.pitch_group("code").alias("pitch_group"), buckets.pitch_family("code").alias("pitch_family"))


@query("m5_x2_zone_tests", f"""
SELECT line_key, {zone_sql(0.83)} AS rulebook, {zone_sql(0.88)} AS display FROM @pitches""")
def m5(spark, folder):
    z = ("plate_x", "plate_z", "sz_top", "sz_bot")
    return table(spark, folder, "pitches").select(
        "line_key", buckets.in_zone(*z, buckets.ZONE_RULEBOOK).alias("rulebook"), buckets.in_zone(*z, buckets.ZONE_DISPLAY).alias("display"))


@query("m6_location_features", f"""
SELECT line_key, {r6_sql("CASE WHEN stand = 'L' THEN -plate_x ELSE plate_x END")} AS plate_x_adj, {r6_sql('sqrt(plate_x * plate_x + (plate_z - 2.5) * (plate_z - 2.5))')} AS zone_center_dist,
 {r6_sql('CASE WHEN plate_x IS NOT NULL THEN sqrt(pow(greatest(abs(plate_x) - 0.83, 0), 2) + pow(greatest(plate_z - 3.5, 1.5 - plate_z, 0), 2)) END')} AS out_of_zone_dist,
 CASE WHEN abs(plate_x) <= 0.83 AND plate_z BETWEEN 1.5 AND 3.5 THEN 1 ELSE 0 END AS in_zone, CASE WHEN p_throws = stand THEN 1 ELSE 0 END AS same_side FROM @pitches""")
def m6(spark, folder):
    out = table(spark, folder, "pitches").withColumns(physics.location_columns())
    out = out.select("line_key", "plate_x_adj", "zone_center_dist", "out_of_zone_dist", "in_zone", "same_side")
    return r6(out, "plate_x_adj", "zone_center_dist", "out_of_zone_dist")


@query("m7_m8_m9_m11_release_features", f"""
SELECT line_key, {r6_sql('sqrt(pfx_x * pfx_x + pfx_z * pfx_z)')} AS total_movement, {r6_sql('CASE WHEN release_spin_rate > 0 THEN sqrt(pfx_x * pfx_x + pfx_z * pfx_z) / (release_spin_rate / 1000) END')} AS spin_efficiency,
 {r6_sql("pfx_x * CASE WHEN p_throws = 'L' THEN -1 ELSE 1 END")} AS arm_side_break, {r6_sql('sin(radians(spin_axis))')} AS axis_sin, {r6_sql('cos(radians(spin_axis))')} AS axis_cos,
 {r6_sql('atan2(vz0, -vy0)')} AS release_tilt, CASE WHEN p_throws = stand THEN 1 ELSE 0 END AS same_side FROM @pitches""")
def m7(spark, folder):
    s, c = physics.circular("spin_axis")
    out = table(spark, folder, "pitches").select(
        "line_key", physics.total_movement("pfx_x", "pfx_z").alias("total_movement"),
        physics.spin_efficiency("pfx_x", "pfx_z", "release_spin_rate").alias("spin_efficiency"),
        physics.arm_side_break("pfx_x", "p_throws").alias("arm_side_break"), s.alias("axis_sin"), c.alias("axis_cos"),
        physics.release_tilt("vy0", "vz0").alias("release_tilt"), physics.same_side("p_throws", "stand").alias("same_side"))
    return r6(out, "total_movement", "spin_efficiency", "arm_side_break", "axis_sin", "axis_cos", "release_tilt")


_T1 = "least(greatest(50.0 / (-vy0), 0.35), 0.55)"
_T2 = "((-vy0 - sqrt(vy0 * vy0 - 2 * ay * (50e0 - 17e0 / 12e0))) / ay)"


@query("m14_m15_m16_approach_angles", f"""
SELECT line_key, {half_even_sql('degrees(atan((2.5 - release_pos_z) / (60.5 - release_extension)))', 2)} AS straight,
 {r6_sql(f'degrees(atan2(vz0 + az * {_T1}, -(vy0 + ay * {_T1})))')} AS vertical, {r6_sql(f'degrees(atan2(vx0 + ax * {_T1}, -(vy0 + ay * {_T1})))')} AS horizontal,
 coalesce(CASE WHEN {_T2} > 0 AND {_T2} <= 1 THEN {half_up_sql(f'degrees(atan((vz0 + az * {_T2}) / abs(vy0 + ay * {_T2})))', 1)} END, {half_up_sql('degrees(atan((plate_z - release_pos_z) / (60.5 - release_extension)))', 1)}) AS at_plate FROM @pitches""")
def m14(spark, folder):
    v, h = physics.flight_angles("vx0", "vy0", "vz0", "ax", "ay", "az")
    out = table(spark, folder, "pitches").select(
        "line_key", physics.approach_angle_geometric("release_pos_z", "release_extension").alias("straight"),
        v.alias("vertical"), h.alias("horizontal"),
        physics.approach_angle_at_plate("vy0", "vz0", "ay", "az", "plate_z", "release_pos_z", "release_extension").alias("at_plate"))
    return r6(out, "vertical", "horizontal")


@query("a28_mean_approach_angle", f"""
SELECT pitcher, pitch_type, {half_up_sql(f"avg({half_up_sql(f'degrees(atan((vz0 + az * {_T2}) / abs(vy0 + ay * {_T2})))', 1)})", 1)} AS vaa FROM @pitches GROUP BY ALL""")
def a28(spark, folder):
    a = physics.approach_angle_at_plate("vy0", "vz0", "ay", "az")
    return table(spark, folder, "pitches").groupBy("pitcher", "pitch_type").agg(numeric.round_half_up(F.avg(a), 1).alias("vaa"))


_TT = "((-vy0 - sqrt(vy0 * vy0 - 4 * (0.5 * ay) * (50e0 - (17e0 / 12e0 + 23e0)))) / (2 * (0.5 * ay)))"
_TP = "((-vy0 - sqrt(vy0 * vy0 - 4 * (0.5 * ay) * (50e0 - 17e0 / 12e0))) / (2 * (0.5 * ay)))"


@query("m13_tunnel_point", f"""
WITH p AS (SELECT *, CASE WHEN {_TT} > 0 AND {_TT} < 0.5 THEN {_TT} END AS tt, {_TP} AS tp FROM @pitches)
SELECT line_key, {r6_sql('release_pos_x + vx0 * tt + 0.5 * ax * tt * tt')} AS tunnel_x, {r6_sql('release_pos_z + vz0 * tt + 0.5 * az * tt * tt')} AS tunnel_z, {r6_sql('tp - tt')} AS time_after_tunnel FROM p""")
def m13(spark, folder):
    out = table(spark, folder, "pitches").withColumns(physics.tunnel_columns())
    return r6(out.select("line_key", "tunnel_x", "tunnel_z", "time_after_tunnel"), "tunnel_x", "tunnel_z", "time_after_tunnel")


@query("m17_innings", f"""
SELECT o_custkey, outs, {half_even_sql('floor(outs / 3) + (outs % 3) * 0.1', 1)} AS ip, {half_even_sql('outs / 3 + (outs % 3) * 0.1', 1)} AS ip_as_published, outs AS outs_again, {r6_sql('outs / 3')} AS innings
FROM (SELECT o_custkey, count(*) AS outs FROM orders GROUP BY o_custkey)""")
def m17(spark, folder):
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("outs"))
    ip = dates.outs_to_innings("outs")
    return r6(o.select("o_custkey", "outs", ip.alias("ip"), dates.outs_to_innings("outs", compat=True).alias("ip_as_published"),
                       dates.innings_to_outs(ip).cast("long").alias("outs_again"), dates.actual_innings("outs").alias("innings")), "innings")


def _slugging() -> str:
    rows = []
    for low, high, steps in buckets.EXPECTED_SLUGGING:
        here = " AND ".join([*([f"launch_angle >= {low}"] if low is not None else []), *([f"launch_angle < {high}"] if high is not None else [])])
        rows += [f"WHEN {here}{f' AND launch_speed < {b}' if b is not None else ''} THEN {v}e0" for b, v in steps]
    return "CASE WHEN launch_angle IS NULL OR launch_speed IS NULL THEN NULL " + " ".join(rows) + " END"


@query("m18_expected_slugging", f"SELECT line_key, {_slugging()} AS expected FROM @pitches")
def m18(spark, folder):
    return table(spark, folder, "pitches").select("line_key", buckets.expected_slugging("launch_angle", "launch_speed").alias("expected"))


_DIFF = "sqrt(plate_x * plate_x + (plate_z - 2.5) * (plate_z - 2.5))"
_EVM = "(1.23 * bat_speed + 0.23 * release_speed)"


@query("m19_c10_swing_features", f"""
SELECT line_key, CASE WHEN attack_angle BETWEEN 5 AND 20 THEN 1 ELSE 0 END AS ideal_attack_angle, CAST(balls - strikes AS INT) AS count_leverage, {r6_sql(_DIFF)} AS location_difficulty,
 {r6_sql('-attack_direction * plate_x')} AS directional_match, {r6_sql('bat_speed - release_speed * 0.7')} AS speed_differential, {r6_sql(f'bat_speed * (1 + 0.3 * {_DIFF})')} AS speed_vs_location,
 {r6_sql(_EVM)} AS theoretical_max_ev, {r6_sql(f'launch_speed / {_EVM}')} AS squared_up_rate, {r6_sql('pow(greatest(xwoba_est, 0.001), 1.5) * pow(greatest(release_extension / 10, 0.001), 0.3) + 0 * xwoba_est')} AS swing_value FROM @pitches""")
def m19(spark, folder):
    c = physics.swing_columns()
    value = physics.swing_value("xwoba_est", F.col("release_extension") / 10)
    out = table(spark, folder, "pitches").withColumns({**c, "swing_value": value})
    out = out.select("line_key", *c, "swing_value").withColumn("count_leverage", F.col("count_leverage").cast("int"))
    return r6(out, *[x for x in out.columns if x not in ("line_key", "ideal_attack_angle", "count_leverage")])


@query("m20_m21_seasons_and_windows", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS season, o_orderdate BETWEEN make_date(year(o_orderdate), 2, 20) AND make_date(year(o_orderdate), 3, 28) AS spring,
 o_orderdate BETWEEN make_date(year(o_orderdate), 3, 20) AND make_date(year(o_orderdate), 11, 5) AS regular, o_orderdate BETWEEN make_date(year(o_orderdate), 10, 1) AND make_date(year(o_orderdate), 11, 15) AS post FROM orders""")
def m20(spark, folder):
    d = F.col("o_orderdate").cast("date")
    s = dates.season_of("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", s.alias("season"), dates.in_season_window(d, s, "S").alias("spring"),
        dates.in_season_window(d, s, "R").alias("regular"), dates.in_season_window(d, s, "P").alias("post"))


@query("m22_m23_m26_ratios_and_rounding", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {half_even_sql('l_quantity / 8', 1)} AS to_even, {half_up_sql('l_quantity / 8', 1)} AS half_up, CASE WHEN l_linenumber - 3 > 0 THEN l_quantity / (l_linenumber - 3) * 100 END AS pct,
 least(greatest(l_quantity, 10), 40) AS clipped FROM lineitem""")
def m22(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numeric.round_half_even(q / 8, 1).alias("to_even"), numeric.round_half_up(q / 8, 1).alias("half_up"),
        numeric.safe_percent(q, F.col("l_linenumber") - 3).alias("pct"), numeric.clip(q, 10.0, 40.0).alias("clipped"))


@query("m25_spray_points", f"""
WITH p AS (SELECT line_key, 180 + (nullif(hit_x, 0) - 125) * 1.25e0 AS x, 290 - (200 - nullif(hit_y, 0)) * 1.25e0 AS y FROM @pitches)
SELECT line_key, {r6_sql('greatest(2, least(358, x))')} AS x, {r6_sql('greatest(2, least(298, y))')} AS y FROM p WHERE x BETWEEN -20 AND 380 AND y BETWEEN -20 AND 320""")
def m25(spark, folder):
    p = table(spark, folder, "pitches").select(
        "line_key", buckets.spray_point("hit_x", "hit_y", 360.0, 300.0, 200.0, 180.0, 290.0).alias("s"))
    return r6(p.filter(F.col("s").isNotNull()).select("line_key", "s.x", "s.y"), "x", "y")


# --- projections ----------------------------------------------------------------------------------

HITTER_SPECS = [
    {"key": "xslg", "label": "xSLG", "lower_better": False, "decimals": 3},
    {"key": "avg_ev", "label": "Avg Exit Velocity", "lower_better": False, "decimals": 1},
    {"key": "fast_swing_rate", "label": "Fast Swing %", "lower_better": False, "decimals": 1, "scale": 100.0},
    {"key": "whiff_percent", "label": "Whiff %", "lower_better": True, "decimals": 1},
]


def hitter_table(spark, folder):
    p = table(spark, folder, "players")
    i = F.col("player_id")
    return p.select(
        "player_id", "name", "role", F.lit(2025).alias("season"),
        F.when(i % 9 != 0, (i * 7 % 800) / 1000.0).alias("xslg"),
        F.when(i % 4 == 0, F.lit("n/a")).otherwise((i * 13 % 400 / 4.0).cast("string")).alias("avg_ev"),
        (i * 3 % 64 / 64.0).alias("fast_swing_rate"),
        F.when(i % 5 != 0, (i * 11 % 160) / 4.0).alias("whiff_percent"))


_HITTERS = """h AS (SELECT c_custkey AS player_id, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 7 % 800) / 1000e0 END AS xslg, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 13 % 400 / 4e0 END AS avg_ev,
  c_custkey * 3 % 64 / 64e0 AS fast_swing_rate, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 11 % 160) / 4e0 END AS whiff_percent FROM customer),
 e AS (SELECT player_id, 'xslg' AS metric, 'xSLG' AS label, xslg AS value, 3 AS d, 1 AS s FROM h UNION ALL SELECT player_id, 'avg_ev', 'Avg Exit Velocity', avg_ev, 1, 1 FROM h
  UNION ALL SELECT player_id, 'fast_swing_rate', 'Fast Swing %', fast_swing_rate, 1, 100 FROM h UNION ALL SELECT player_id, 'whiff_percent', 'Whiff %', whiff_percent, 1, 1 FROM h)"""


@query("p7_p9_metric_entries", f"""WITH {_HITTERS},
 p AS (SELECT *, {strict_sql('value', 'metric')} AS up, {strict_sql('value', 'metric', True)} AS down FROM e)
SELECT player_id, metric, label, value, CASE WHEN metric = 'whiff_percent' THEN down ELSE up END AS pctile, value IS NULL AS no_value FROM p""")
def p7(spark, folder):
    e = reshape.metric_entries(hitter_table(spark, folder), ["player_id"], HITTER_SPECS)
    return e.select("player_id", "metric", "label", "value", "pctile", (F.col("display") == "—").alias("no_value"))


@query("p9_display_text", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '—' ELSE printf('%.1f', (l_quantity * 3 + 0.26e0) / 7) END AS shown, printf('%.3f', l_quantity / 7) AS three FROM lineitem""")
def p9(spark, folder):
    q = F.col("l_quantity")
    v = F.when(F.col("l_linenumber") != 7, (q * 3 + 0.26) / 700)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", numeric.display(v, 1, 100.0).alias("shown"), numeric.display(q / 7, 3).alias("three"))


@query("p1_p2_p4_p5_conform", """
SELECT c_custkey AS player_id, c_name AS player_name, c_acctbal AS velo, CAST(NULL AS DOUBLE) AS spin, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CAST(c_nationkey AS VARCHAR)) AS team FROM customer""")
def p1(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("PlayerName"), F.col("c_acctbal").alias("velo"),
        F.col("c_acctbal").alias("velo"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("Team"), F.col("c_nationkey").alias("team_id"))
    u = reshape.drop_repeated_columns(c)
    u = reshape.rename_present(u, {"id": "player_id", "PlayerName": "player_name", "Nothing": "nothing"})
    u = u.withColumn("team", reshape.first_existing(u, ["Team", "team_name", "team_id"]))
    return reshape.ensure_columns(u, ["spin"]).select("player_id", "player_name", "velo", "spin", "team")


@query("p6_new_columns_only", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def p6(spark, folder):
    s = table(spark, folder, "supplier")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lit("x").alias("s_name"), "n_name")
    return s.join(joins.only_new_columns(s, n, ["s_nationkey"]), "s_nationkey", "left")


@query("p10_p11_fallbacks", """
SELECT player_id, coalesce(CASE WHEN nullif(ip, 0) IS NOT NULL THEN ip END, gs / 1e0) AS ip, CASE WHEN ip > 1 THEN ip / 100 ELSE ip END AS share FROM @players""")
def p10(spark, folder):
    return table(spark, folder, "players").select(
        "player_id", F.coalesce(numeric.zero_to_null("ip"), F.col("gs") / 1.0).alias("ip"), numeric.percent_repair("ip").alias("share"))


@query("p12_p13_scaling", f"""SELECT pitcher, {r6_sql('sum(pfx_x / 12)')} AS pfx_feet, {half_even_sql('avg(xrv) * 100', 3)} AS per_100 FROM @pitches GROUP BY pitcher""")
def p12(spark, folder):
    g = table(spark, folder, "pitches").groupBy("pitcher").agg(
        F.sum(numeric.inches_to_feet("pfx_x")).alias("pfx_feet"), numeric.per_hundred(F.avg("xrv")).alias("per_100"))
    return r6(g, "pfx_feet")


@query("p14_export_projection", f"""
WITH g AS (SELECT batter, avg(xwoba_est) AS q, avg(CASE WHEN description IN {_in(buckets.CONTACT_DESCRIPTIONS)} THEN 1.0 ELSE 0.0 END) AS c, avg(bat_speed) AS b, count(*) AS n FROM @pitches GROUP BY batter)
SELECT batter AS batter_name, {half_even_sql('q', 3)} AS quality, {half_even_sql('c * 100', 1)} AS actual_contact, {half_even_sql('b', 1)} AS bat_speed, n AS n_swings FROM g""")
def p14(spark, folder):
    g = table(spark, folder, "pitches").groupBy("batter").agg(
        F.avg("xwoba_est").alias("q"), F.avg(buckets.is_contact("description").cast("double")).alias("c"), F.avg("bat_speed").alias("b"), F.count(F.lit(1)).alias("n"))
    return reshape.export(g, {"batter_name": ("batter", None, 1), "quality": ("q", 3, 1.0), "actual_contact": ("c", 1, 100.0),
                              "bat_speed": ("b", 1, 1.0), "n_swings": ("n", None, 1)})


@query("p15_season_from_data", "SELECT pitcher, max(season) AS season, count(DISTINCT season) AS seasons FROM @pitches GROUP BY pitcher")
def p15(spark, folder):
    return table(spark, folder, "pitches").groupBy("pitcher").agg(F.max("season").alias("season"), F.count_distinct("season").alias("seasons"))


# --- filters --------------------------------------------------------------------------------------


@query("f1_season_aware_minimum", """
SELECT player_id, s.season, pa FROM @players, (SELECT unnest([2024, 2025]) AS season) s WHERE pa >= CASE WHEN s.season = 2025 THEN 25 ELSE 100 END""")
def f1(spark, folder):
    p = table(spark, folder, "players").select("player_id", "pa", F.explode(F.array(F.lit(2024), F.lit(2025))).alias("season"))
    run = F.lit("2025-05-15").cast("date")
    return p.filter(F.col("pa") >= dates.minimum_appearances("season", run)).select("player_id", "season", "pa")


@query("f2_f4_minimum_work", "SELECT player_id, ip, gs FROM @players WHERE ip >= 20 AND gs >= 10")
def f2(spark, folder):
    return table(spark, folder, "players").filter((F.col("ip") >= 20) & (F.col("gs") >= 10)).select("player_id", "ip", "gs")


@query("f3_minimum_events", "SELECT pitcher, pitch_type, count(*) AS n FROM @pitches GROUP BY ALL HAVING count(*) >= 100")
def f3(spark, folder):
    return table(spark, folder, "pitches").groupBy("pitcher", "pitch_type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")


@query("f5_f6_swing_and_whiff_sets", f"""
SELECT line_key, {SWING} AS swing, {WHIFF} AS whiff, chr(65 + CAST(batter % 26 AS INT)) IN {_in(buckets.SWING_CODES)} AS code_swing, chr(65 + CAST(batter % 26 AS INT)) IN {_in(buckets.WHIFF_CODES)} AS code_whiff FROM @pitches""")
def f5(spark, folder):
    code = F.char(F.lit(65) + F.col("batter") % 26)
    return table(spark, folder, "pitches").select(
        "line_key", buckets.is_swing("description").alias("swing"), buckets.is_whiff("description").alias("whiff"),
        code.isin(*buckets.SWING_CODES).alias("code_swing"), code.isin(*buckets.WHIFF_CODES).alias("code_whiff"))


@query("f7_f8_complete_rows", """
SELECT pitch_type, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM (SELECT pitch_type, launch_speed IS NOT NULL AND plate_x IS NOT NULL AND bat_speed IS NOT NULL AS ok FROM @pitches) GROUP BY pitch_type""")
def f7(spark, folder):
    return reshape.count_incomplete(table(spark, folder, "pitches"), ["launch_speed", "plate_x", "bat_speed"], ["pitch_type"])


@query("f7_drop_incomplete", "SELECT line_key FROM @pitches WHERE launch_speed IS NOT NULL AND plate_x IS NOT NULL AND bat_speed IS NOT NULL")
def f7_drop(spark, folder):
    return reshape.drop_incomplete(table(spark, folder, "pitches"), ["launch_speed", "plate_x", "bat_speed"]).select("line_key")


@query("f11_playable_games", """
SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Final' WHEN '2-HIGH' THEN 'Postponed: Rain' WHEN '5-LOW' THEN 'In Progress' WHEN '3-MEDIUM' THEN 'Scheduled' END AS status FROM orders)
WHERE status IS NULL OR status IN ('Final', 'In Progress')""")
def f11(spark, folder):
    p = F.col("o_orderpriority")
    s = F.when(p == "1-URGENT", "Final").when(p == "2-HIGH", "Postponed: Rain").when(p == "5-LOW", "In Progress").when(p == "3-MEDIUM", "Scheduled")
    return table(spark, folder, "orders").select("o_orderkey", s.alias("status")).filter(reshape.playable("status"))


@query("f14_season_type_filter", "SELECT season, count(*) AS n FROM @pitches WHERE game_date BETWEEN make_date(season, 3, 20) AND make_date(season, 11, 5) GROUP BY season")
def f14(spark, folder):
    p = table(spark, folder, "pitches").filter(dates.in_season_window("game_date", "season", "R"))
    return p.groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("f15_value_gates", """
SELECT line_key, CASE WHEN xwoba_est > 0 AND xwoba_est < 1 THEN xwoba_est END AS xwoba FROM @pitches WHERE release_speed IS NOT NULL AND plate_x IS NOT NULL AND plate_z IS NOT NULL AND pitch_type <> 'SI'""")
def f15(spark, folder):
    ok = numeric.all_present(["release_speed", "plate_x", "plate_z"]) & (F.col("pitch_type") != "SI")
    return table(spark, folder, "pitches").filter(ok).select("line_key", numeric.in_open_range("xwoba_est", 0, 1).alias("xwoba"))


@query("f17_batter_side_split", "SELECT pitcher, stand, count(*) AS n, count(DISTINCT batter) AS batters FROM @pitches WHERE stand = 'L' GROUP BY ALL")
def f17(spark, folder):
    p = table(spark, folder, "pitches").filter("stand = 'L'")
    return p.groupBy("pitcher", "stand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batter").alias("batters"))


# --- SQL functions --------------------------------------------------------------------------------


@query("x6_sql_functions", f"""
SELECT line_key, {half_up_sql('release_speed / 3', 1)} AS a, {half_even_sql('release_speed / 3', 1)} AS b, {zone_sql(0.83)} AS z, {ANGLE} AS bucket, {BUCKET} AS cnt,
 {half_even_sql('degrees(atan((2.5 - release_pos_z) / (60.5 - release_extension)))', 2)} AS vaa, {half_even_sql('floor(pitch_number / 3) + (pitch_number % 3) * 0.1', 1)} AS ip, {r6_sql(_curve_sql('(release_speed - 70) * 3'))} AS curve FROM @pitches""")
def x6(spark, folder):
    sql.register(spark)
    return table(spark, folder, "pitches").selectExpr(
        "line_key", "round_half_up(release_speed / 3, 1) AS a", "round_to_even(release_speed / 3, 1) AS b",
        "in_strike_zone(plate_x, plate_z, sz_top, sz_bot, 0.83D) AS z", "angle_bucket(launch_angle) AS bucket",
        "count_bucket(CAST(balls AS INT), CAST(strikes AS INT)) AS cnt", "vaa_straight(release_pos_z, release_extension) AS vaa",
        "outs_to_innings(pitch_number) AS ip", "rint(stretch_percentile((release_speed - 70) * 3) * 1e6) / 1e6 + 0.0D AS curve")


@query("x6_sql_name_key", f"SELECT player_id, {_suffix_key('name')} AS k FROM @players")
def x6_names(spark, folder):
    sql.register(spark)
    return table(spark, folder, "players").selectExpr("player_id", "name_key(name) AS k")


@query("c8_role_classification", """
SELECT player_id, CASE WHEN gs > 0 THEN gs ELSE ip END >= 10 AS is_starter FROM @players""")
def c8(spark, folder):
    return table(spark, folder, "players").select("player_id", appearances.classify_role("gs", "ip").alias("is_starter"))


@query("u6_metric_coverage", """
SELECT season, m AS metric, CASE m WHEN 'bat_speed' THEN nb WHEN 'launch_speed' THEN nl ELSE 0 END AS n_values, n AS n_rows, m <> 'sprint_speed' AS present
FROM (SELECT season, count(bat_speed) AS nb, count(launch_speed) AS nl, count(*) AS n FROM @pitches GROUP BY season), (SELECT unnest(['bat_speed', 'launch_speed', 'sprint_speed']) AS m)""")
def u6(spark, folder):
    return entities.metric_coverage(table(spark, folder, "pitches"), ["bat_speed", "launch_speed", "sprint_speed"], ["season"])
