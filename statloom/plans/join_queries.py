"""Record linkage, gap filling, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import names
from statloom.functions.numeric import round_half_even
from statloom.operators import appearances, entities, joins, ranks, rates
from statloom.operators.keys import lookup
from statloom.plans.registry import half_even_sql, half_up_sql, query, r6, r6_sql, table
from statloom.plans.value_queries import _suffix_key, _token_key
from statloom.session import cut


@query("j1_left_join_sources", """
SELECT c_custkey AS player_id, c_name AS player_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS xslg, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + 0.5e0 END AS avg_ev, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END AS team
FROM customer""")
def j1(spark, folder):
    """Three leaderboard tables, each with its own columns; gaps are missing values and missing keys."""
    c = table(spark, folder, "customer")
    i = F.col("c_custkey")
    base = c.select(i.alias("player_id"), F.col("c_name").alias("player_name"), F.when(i % 5 != 0, F.col("c_acctbal")).alias("xslg"))
    two = c.select(F.when(i % 3 != 0, i).alias("player_id"), F.col("c_name").alias("player_name"), (F.col("c_nationkey") + 0.5).cast("double").alias("avg_ev"))
    three = c.select(F.when(i % 7 == 0, F.col("c_name")).alias("player_name"), F.col("c_mktsegment").alias("team"))
    return joins.join_sources([base, two, three]).select("player_id", "player_name", "xslg", "avg_ev", "team")


@query("j2_outer_join_sources", """
SELECT c_custkey AS player_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS player_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS xslg,
  CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 5 = 0 THEN c_nationkey + 0.5e0 END AS avg_ev
FROM customer""")
def j2(spark, folder):
    """Two tables that share some players; each player is in one of them at least."""
    c = table(spark, folder, "customer")
    i = F.col("c_custkey")
    base = c.filter(i % 5 != 0).select(i.alias("player_id"), F.col("c_name").alias("player_name"), F.col("c_acctbal").alias("xslg"))
    two = c.filter((i % 3 != 0) | (i % 5 == 0)).select(i.alias("player_id"), F.col("c_name").alias("player_name"), (F.col("c_nationkey") + 0.5).cast("double").alias("avg_ev"))
    return joins.join_sources([base, two], "full")


@query("j3_outer_join_with_name_fallback", f"""
WITH l AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS player_id, c_name AS player_name, c_acctbal AS a FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 6 = 0),
 r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS rid, upper(c_name) AS rname, c_nationkey AS b FROM customer WHERE c_custkey % 6 <> 0),
 m AS (SELECT player_id, player_name, a, b FROM l JOIN r ON player_id = rid),
 rl AS (SELECT * FROM l WHERE player_id IS NULL OR player_id NOT IN (SELECT rid FROM r WHERE rid IS NOT NULL)),
 rr AS (SELECT * FROM r WHERE rid IS NULL OR rid NOT IN (SELECT player_id FROM l WHERE player_id IS NOT NULL))
SELECT * FROM m UNION ALL
SELECT coalesce(player_id, rid), coalesce(player_name, rname), a, b FROM rl FULL JOIN rr ON lower(player_name) = lower(rname) AND (player_id IS NULL OR rid IS NULL)""")
def j3(spark, folder):
    c = table(spark, folder, "customer")
    i = F.col("c_custkey")
    left = c.filter((i % 4 != 0) | (i % 6 == 0)).select(F.when(i % 10 != 0, i).alias("player_id"), F.col("c_name").alias("player_name"), F.col("c_acctbal").alias("a"))
    right = c.filter(i % 6 != 0).select(F.when(i % 3 != 0, i).alias("player_id"), F.upper("c_name").alias("player_name"), F.col("c_nationkey").alias("b"))
    return joins.outer_join_with_name_fallback(left, right, "player_id", "player_name")


@query("j4_situation_tables", """
WITH s AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)
SELECT concat('P', s.l_suppkey) AS name, concat('T', s.l_suppkey % 7) AS team, 'C' AS position, s.l_returnflag AS situation, a.g AS pp_goals, CAST(NULL AS DOUBLE) AS pk_goals, CAST(NULL AS DOUBLE) AS missing
FROM s LEFT JOIN (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS g FROM lineitem GROUP BY l_suppkey) a ON a.l_suppkey = s.l_suppkey AND s.l_suppkey % 2 = 0""")
def j4(spark, folder):
    li = table(spark, folder, "lineitem")

    def keyed(df, known=F.lit(True)):
        return df.select(F.when(known, F.concat(F.lit("P"), "l_suppkey")).alias("name"), F.concat(F.lit("T"), F.col("l_suppkey") % 7).alias("team"),
                         F.lit("C").alias("position"), *[c for c in df.columns if c != "l_suppkey"])

    base = keyed(li.select("l_suppkey", F.col("l_returnflag").alias("situation")).distinct())
    pp = keyed(li.groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("string").alias("Goals/60")), F.col("l_suppkey") % 2 == 0)
    return joins.join_situations(
        base, {"pp": (pp, {"Goals/60": "pp_goals", "Absent/60": "missing"}), "pk": (None, {"Goals/60": "pk_goals"})},
        ["name", "team", "position"])


@query("j5_context_averages", f"""
WITH c AS (SELECT l_suppkey, l_linestatus AS pos_group, sum(l_extendedprice * greatest(l_discount * 100, 1)) / sum(greatest(l_discount * 100, 1)) AS q FROM lineitem GROUP BY ALL)
SELECT s_suppkey, pos_group, {r6_sql('q', 3)} AS quality FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey AND pos_group = CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'O' END""")
def j5(spark, folder):
    """The first players have names with variants: one table spells them one way, the other the other way."""
    def player(key, spellings, prefix):
        known = F.get(F.array(*[F.lit(s) for s in spellings]), (F.col(key) - 1).cast("int"))
        return F.coalesce(F.initcap(known), F.concat(F.lit(prefix), key))

    def keyed(df, name):
        return joins.apply_aliases(df.withColumn("name_key", names.name_key(name, "ascii")), "name_key", joins.alias_table(spark)).drop(name)

    li = table(spark, folder, "lineitem").select(
        player("l_suppkey", list(joins.NAME_ALIASES), "Supplier ").alias("player"), F.col("l_linestatus").alias("pos_group"),
        F.col("l_extendedprice").alias("quality"), (F.col("l_discount") * 100).alias("toi"))
    ctx = joins.context_averages(keyed(li, "player"), ["quality"], "toi", "quality")
    s = keyed(table(spark, folder, "supplier").select(
        "s_suppkey", player("s_suppkey", list(joins.NAME_ALIASES.values()), "SUPPLIER ").alias("player"),
        F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("O").alias("pos_group")), "player")
    return r6(lookup(s, ctx, ["name_key", "pos_group"]).select("s_suppkey", "pos_group", "quality"), "quality", digits=3)


@query("j6_dictionary_lookup", """
SELECT c_custkey, n_name AS team, r_name AS league FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2""")
def j6(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("team"), F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, folder, "region").filter("r_regionkey <> 2").select("r_regionkey", F.col("r_name").alias("league"))
    return lookup(lookup(c, n, ["n_nationkey"]), r, ["r_regionkey"]).select("c_custkey", "team", "league")


@query("j7_lookup_by_id_then_name", f"""
WITH p AS (SELECT player_id, name, {_suffix_key('name')} AS k FROM @players),
 i AS (SELECT player_id, ip, gs FROM @players WHERE player_id % 2 = 0),
 n AS (SELECT k, ip, gs FROM (SELECT {_suffix_key('name')} AS k, ip + 5 AS ip, gs + 1 AS gs, row_number() OVER (PARTITION BY {_suffix_key('name')} ORDER BY ip DESC, gs) AS rn FROM @players WHERE ip + 5 > 0) WHERE rn = 1)
SELECT p.player_id, CASE WHEN coalesce(i.ip, 0) <= 0 AND n.ip > 0 THEN n.ip ELSE i.ip END AS ip, CAST(CASE WHEN coalesce(i.ip, 0) <= 0 AND n.ip > 0 THEN n.gs ELSE i.gs END AS INT) AS gs
FROM p LEFT JOIN i USING (player_id) LEFT JOIN n USING (k)""")
def j7(spark, folder):
    p = table(spark, folder, "players")
    by_name = p.select("name", (F.col("ip") + 5).alias("ip"), (F.col("gs") + 1).cast("int").alias("gs"))
    out = joins.lookup_id_then_name(p.select("player_id", "name"), p.filter("player_id % 2 = 0").select("player_id", "ip", "gs"),
                                    by_name, "player_id", "name", "ip", ["gs"])
    return out.select("player_id", "ip", "gs")


@query("j8_semi_join", """
SELECT line_key, batter FROM @pitches WHERE batter IN (SELECT batter FROM @pitches GROUP BY batter HAVING count(*) >= 35)""")
def j8(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", "batter")
    ok = p.groupBy("batter").agg(F.count(F.lit(1)).alias("n")).filter("n >= 35")
    return joins.semi(p, ok, ["batter"]).select("line_key", "batter")


@query("j9_player_games", """
WITH g AS (SELECT o_orderkey AS game_pk, concat('T', o_orderkey % 40) AS away, concat('T', (o_orderkey + 13) % 40) AS home FROM orders),
 lg AS (SELECT DISTINCT l_suppkey AS player_id, l_orderkey AS game_pk FROM lineitem WHERE l_suppkey % 5 <> 0),
 p AS (SELECT s_suppkey AS player_id, concat('T', s_nationkey) AS team FROM supplier)
SELECT player_id, game_pk FROM lg WHERE game_pk IN (SELECT game_pk FROM g)
UNION ALL SELECT DISTINCT player_id, game_pk FROM p JOIN g ON team = away OR team = home WHERE player_id NOT IN (SELECT player_id FROM lg)""")
def j9(spark, folder):
    k = F.col("o_orderkey")
    games = table(spark, folder, "orders").select(
        k.alias("game_pk"), F.concat(F.lit("T"), k % 40).alias("away"), F.concat(F.lit("T"), (k + 13) % 40).alias("home"))
    log = table(spark, folder, "lineitem").filter("l_suppkey % 5 <> 0").select(F.col("l_suppkey").alias("player_id"), F.col("l_orderkey").alias("game_pk"))
    players = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("player_id"), F.concat(F.lit("T"), "s_nationkey").alias("team"))
    return joins.player_games(games, log, players)


@query("j10_u4_roster_supplement", """
WITH r AS (SELECT DISTINCT l_returnflag AS role, l_suppkey AS id, 'roster' AS src FROM lineitem WHERE l_suppkey % 3 <> 0),
 x AS (SELECT DISTINCT l_returnflag AS role, l_suppkey AS id, 'box' AS src FROM lineitem)
SELECT * FROM r UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.role = x.role AND r.id = x.id)""")
def j10(spark, folder):
    x = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("id"))
    roster = x.filter("id % 3 <> 0").dropDuplicates(["role", "id"]).withColumn("src", F.lit("roster"))
    return joins.supplement(roster, x.withColumn("src", F.lit("box")), ["role", "id"])


@query("u4_two_role_players", """
SELECT l_suppkey AS id, count(DISTINCT l_returnflag) AS roles FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1""")
def u4(spark, folder):
    x = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("id"))
    per_role = x.dropDuplicates(["role", "id"])
    return per_role.groupBy("id").agg(F.count(F.lit(1)).alias("roles")).filter("roles > 1")


@query("j11_p11_gap_fill", """
SELECT c_custkey AS player_id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 10000 END, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_nationkey + 0.25e0 > 1 THEN (c_nationkey + 0.25e0) / 100 ELSE c_nationkey + 0.25e0 END END) AS fast_swing_rate,
 CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey * 2e0 END AS avg_ev, CAST(NULL AS DOUBLE) AS xslg FROM customer""")
def j11(spark, folder):
    c, i = table(spark, folder, "customer"), F.col("c_custkey")
    left = c.select(i.alias("player_id"), F.when(i % 3 != 0, F.col("c_acctbal") / 10000).alias("fast_swing_rate"))
    src = c.filter(i % 4 != 0).select(
        i.alias("player_id"), (F.col("c_nationkey") + F.lit(0.25)).alias("fast_swing_rate"), (F.col("c_nationkey") * F.lit(2.0)).alias("avg_ev"))
    return joins.fill_gaps(left, src, ["player_id"], ["fast_swing_rate", "avg_ev", "xslg"], {"fast_swing_rate"})


@query("j12_preferred_fastball", f"""
WITH p AS (SELECT pitcher, CASE WHEN pitcher % 3 = 0 AND pitch_type = 'FF' THEN 'SI' ELSE pitch_type END AS pitch_type, release_speed FROM @pitches),
 g AS (SELECT pitcher, pitch_type, avg(release_speed) AS v, count(*) AS n FROM p WHERE pitch_type IN ('FF','SI') GROUP BY ALL)
SELECT pitcher, pitch_type, {r6_sql('v')} AS velo, n FROM (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY CASE pitch_type WHEN 'FF' THEN 0 ELSE 1 END) AS rn FROM g) WHERE rn = 1""")
def j12(spark, folder):
    # a third of the pitchers throw sinkers where the others throw four-seamers
    p = table(spark, folder, "pitches").withColumn("pitch_type", F.expr("CASE WHEN pitcher % 3 = 0 AND pitch_type = 'FF' THEN 'SI' ELSE pitch_type END"))
    g = p.groupBy("pitcher", "pitch_type").agg(F.avg("release_speed").alias("velo"), F.count(F.lit(1)).alias("n"))
    return r6(joins.preferred_fastball(g, "pitcher"), "velo")


@query("j13_row_preserving_join", """
WITH d AS (SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id) SELECT event_id, events.user_id, first_event FROM events LEFT JOIN d USING (user_id)""")
def j13(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id")
    return joins.join_unique(e, e.select("user_id", F.col("event_id").alias("first_event")), ["user_id"], [F.col("first_event")])


@query("j14_fuzzy_lookup", f"""
WITH t AS (SELECT upper(name) AS name, player_id AS value FROM @players WHERE player_id % 2 = 1 UNION ALL SELECT name, player_id FROM @players WHERE player_id % 10 = 0),
 e AS (SELECT name, min(value) AS v FROM t GROUP BY name),
 l AS (SELECT k, v FROM (SELECT {_token_key('name')} AS k, value AS v, row_number() OVER (PARTITION BY {_token_key('name')} ORDER BY encode(name), value) AS rn FROM t) WHERE rn = 1)
SELECT player_id, coalesce(e.v, l.v) AS value FROM @players p LEFT JOIN e USING (name) LEFT JOIN l ON l.k = {_token_key('p.name')}""")
def j14(spark, folder):
    p = table(spark, folder, "players").select("player_id", "name")
    odd = p.filter("player_id % 2 = 1").select(F.upper("name").alias("name"), F.col("player_id").alias("value"))
    t = odd.unionByName(p.filter("player_id % 10 = 0").select("name", F.col("player_id").alias("value")))
    return joins.fuzzy_lookup(p, t, "name", "value").select("player_id", "value")


_FB = """b AS (SELECT pitcher, avg(release_speed) AS fv, avg(pfx_x) AS fx, avg(pfx_z) AS fz, avg(release_pos_x) AS rx, avg(release_pos_z) AS rz, avg(release_spin_rate) AS fs, avg(release_extension) AS fe FROM @pitches WHERE pitch_type = 'FF' AND pitcher % 5 <> 0 GROUP BY pitcher)"""


@query("j15_m10_fastball_deltas", f"""WITH {_FB}
SELECT line_key, {r6_sql('coalesce(release_speed - fv, 0)')} AS delta_velo, {r6_sql('coalesce(pfx_x - fx, 0)')} AS delta_pfx_x, {r6_sql('coalesce(sqrt(pow(pfx_x - fx, 2) + pow(pfx_z - fz, 2)), 0)')} AS movement_separation,
 {r6_sql('coalesce(sqrt(pow(release_pos_x - rx, 2) + pow(release_pos_z - rz, 2)), 0)')} AS release_distance FROM @pitches LEFT JOIN b USING (pitcher)""")
def j15(spark, folder):
    from statloom.functions import physics

    p = table(spark, folder, "pitches")
    out = with_baselines(p).withColumns(physics.fastball_deltas())
    return r6(out.select("line_key", "delta_velo", "delta_pfx_x", "movement_separation", "release_distance"),
              "delta_velo", "delta_pfx_x", "movement_separation", "release_distance")


def with_baselines(p):
    """Pitches with their pitcher's fastball means, flight angles and tunnel anchors."""
    from statloom.functions import physics
    from statloom.operators.models import attach_baselines

    v, _ = physics.flight_angles("vx0", "vy0", "vz0", "ax", "ay", "az")
    p = p.withColumns({"vaa": v, **physics.tunnel_columns()})
    fb = p.filter((F.col("pitch_type") == "FF") & (F.col("pitcher") % 5 != 0)).groupBy("pitcher").agg(*[
        F.avg(c).alias(n) for n, c in {
            "fb_velo": "release_speed", "fb_pfx_x": "pfx_x", "fb_pfx_z": "pfx_z", "fb_spin": "release_spin_rate",
            "fb_extension": "release_extension", "fb_vaa": "vaa", "fb_release_x": "release_pos_x", "fb_release_z": "release_pos_z",
            "fb_tunnel_x": "tunnel_x", "fb_tunnel_z": "tunnel_z", "fb_plate_x": "plate_x", "fb_plate_z": "plate_z"}.items()])
    return attach_baselines(p, cut(fb, "baselines"))


_TT = "((-vy0 - sqrt(vy0 * vy0 - 4 * (0.5 * ay) * (50e0 - (17e0 / 12e0 + 23e0)))) / (2 * (0.5 * ay)))"


@query("m13_j15_tunnel_distances", f"""
WITH p AS (SELECT *, CASE WHEN {_TT} > 0 AND {_TT} < 0.5 THEN {_TT} END AS tt FROM @pitches),
 q AS (SELECT *, release_pos_x + vx0 * tt + 0.5 * ax * tt * tt AS tx, release_pos_z + vz0 * tt + 0.5 * az * tt * tt AS tz FROM p),
 b AS (SELECT pitcher, avg(tx) AS bx, avg(tz) AS bz, avg(plate_x) AS px, avg(plate_z) AS pz FROM q WHERE pitch_type = 'FF' AND pitcher % 5 <> 0 GROUP BY pitcher),
 d AS (SELECT line_key, sqrt(pow(tx - bx, 2) + pow(tz - bz, 2)) * 12 AS td, sqrt(pow(plate_x - px, 2) + pow(plate_z - pz, 2)) * 12 AS pd FROM q LEFT JOIN b USING (pitcher))
SELECT line_key, {r6_sql('coalesce(td, 0)', 5)} AS tunnel_distance, {r6_sql('coalesce(pd, 0)', 5)} AS plate_distance, {r6_sql('coalesce(pd - td, 0)', 5)} AS late_break FROM d""")
def m13_distances(spark, folder):
    from statloom.functions import physics

    out = with_baselines(table(spark, folder, "pitches")).withColumns(physics.tunnel_distances())
    return r6(out.select("line_key", "tunnel_distance", "plate_distance", "late_break"), "tunnel_distance", "plate_distance", "late_break", digits=5)


@query("j16_arm_angle_baselines", f"""
WITH b AS (SELECT pitcher, avg(arm_angle) AS u, stddev_samp(arm_angle) AS s FROM @pitches WHERE pitcher % 4 <> 0 GROUP BY pitcher)
SELECT line_key, {r6_sql('coalesce(arm_angle, u)')} AS arm_angle, {r6_sql('s')} AS arm_angle_std, {r6_sql('CASE WHEN u IS NOT NULL THEN coalesce(arm_angle - u, 0) END')} AS arm_angle_dev FROM @pitches LEFT JOIN b USING (pitcher)""")
def j16(spark, folder):
    p = table(spark, folder, "pitches")
    b = p.filter("pitcher % 4 <> 0").groupBy("pitcher").agg(F.avg("arm_angle").alias("arm_angle"), F.stddev_samp("arm_angle").alias("arm_angle_std"))
    out = joins.with_arm_angles(p.select("line_key", "pitcher", "arm_angle"), cut(b, "arm-angles")).drop("pitcher")
    return r6(out, "arm_angle", "arm_angle_std", "arm_angle_dev")


@query("j17_m12_slot_and_drag", f"""
WITH s AS (SELECT pitch_type, p_throws, regr_slope(pfx_x * CASE WHEN p_throws = 'L' THEN -1 ELSE 1 END, arm_angle) AS sx, regr_intercept(pfx_x * CASE WHEN p_throws = 'L' THEN -1 ELSE 1 END, arm_angle) AS ix,
   regr_slope(pfx_z, arm_angle) AS sz, regr_intercept(pfx_z, arm_angle) AS iz FROM @pitches WHERE pitch_type <> 'CU' GROUP BY ALL),
 d AS (SELECT pitch_type, avg(ay) AS i FROM @pitches WHERE pitch_type <> 'SL' GROUP BY pitch_type)
SELECT line_key, {r6_sql("pfx_x * CASE WHEN p_throws = 'L' THEN -1 ELSE 1 END - (sx * arm_angle + ix)")} AS pfx_x_dev_from_slot, {r6_sql('pfx_z - (sz * arm_angle + iz)')} AS pfx_z_dev_from_slot,
 {r6_sql('CASE WHEN i IS NULL THEN 0 ELSE ay - (i + 0.01e0 * release_speed + 0.0001e0 * release_spin_rate) END')} AS ay_residual FROM @pitches LEFT JOIN s USING (pitch_type, p_throws) LEFT JOIN d USING (pitch_type)""")
def j17(spark, folder):
    from statloom.functions.physics import arm_side_break

    p = table(spark, folder, "pitches").withColumn("arm_side_break", arm_side_break("pfx_x", "p_throws"))
    fitted = p.filter("pitch_type <> 'CU'")
    x = rates.linear_fit(fitted, ["pitch_type", "p_throws"], "arm_side_break", "arm_angle", "x_")
    z = rates.linear_fit(fitted, ["pitch_type", "p_throws"], "pfx_z", "arm_angle", "z_")
    slots = x.join(z, ["pitch_type", "p_throws"]).withColumnsRenamed(
        {"x_slope": "slope_x", "x_intercept": "intercept_x", "z_slope": "slope_z", "z_intercept": "intercept_z"})
    drags = p.filter("pitch_type <> 'SL'").groupBy("pitch_type").agg(F.avg("ay").alias("intercept")).withColumns(
        {"slope_velo": F.lit(0.01), "slope_spin": F.lit(0.0001)})
    out = joins.with_slot_and_drag(p, cut(slots, "slots"), cut(drags, "drags")).select("line_key", "pfx_x_dev_from_slot", "pfx_z_dev_from_slot", "ay_residual")
    return r6(out, "pfx_x_dev_from_slot", "pfx_z_dev_from_slot", "ay_residual")


@query("j19_prefer_type_mean", f"""
WITH m AS (SELECT pitch_type, avg(arm_angle) AS a FROM @pitches WHERE pitch_type IN ('FF','SL') GROUP BY pitch_type) SELECT line_key, {r6_sql('coalesce(a, arm_angle)')} AS arm_angle FROM @pitches LEFT JOIN m USING (pitch_type)""")
def j19(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", "pitch_type", "arm_angle")
    m = p.filter(F.col("pitch_type").isin("FF", "SL")).groupBy("pitch_type").agg(F.avg("arm_angle").alias("arm_angle"))
    return r6(joins.prefer_group_mean(p, cut(m, "type-means"), ["pitch_type"], "arm_angle").drop("pitch_type"), "arm_angle")


@query("j20_value_by_priority", f"""
WITH p AS (SELECT player_id, name, CASE WHEN player_id % 3 = 0 THEN 'AAA' ELSE 'MLB' END AS level FROM @players),
 pr AS (SELECT k, x FROM (SELECT {_token_key('name')} AS k, player_id / 4000e0 AS x, row_number() OVER (PARTITION BY {_token_key('name')} ORDER BY encode(name), player_id) AS rn FROM @players WHERE player_id % 5 <> 1) WHERE rn = 1)
SELECT player_id, level, coalesce(CASE WHEN level <> 'AAA' AND player_id % 4 = 0 THEN player_id / 2000e0 END, CASE WHEN level <> 'AAA' AND player_id % 2 = 0 THEN {half_up_sql('player_id / 3000e0', 3)} END, x) AS xwoba FROM p LEFT JOIN pr ON k = {_token_key('p.name')}""")
def j20(spark, folder):
    p = table(spark, folder, "players")
    i = F.col("player_id")
    players = p.select("player_id", "name", F.when(i % 3 == 0, "AAA").otherwise("MLB").alias("level"), F.lit(2025).alias("season"))
    game = p.filter(i % 4 == 0).select("player_id", (i / 2000.0).alias("xwoba"))
    bulk = p.filter(i % 2 == 0).select("player_id", (i / 3000.0).alias("xwoba"))
    prospects = p.filter(i % 5 != 1).select("name", F.lit(2025).alias("season"), (i / 4000.0).alias("xwoba"))
    return joins.value_by_priority(players, game, bulk, prospects).select("player_id", "level", "xwoba")


@query("j21_situation_columns", f"""
SELECT l_suppkey, {r6_sql("sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A')", 2)} AS ev5, {r6_sql("sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_linenumber > 1)", 2)} AS pk,
  {r6_sql("sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N' OR (l_returnflag = 'R' AND l_linenumber = 1))", 2)} AS pp FROM lineitem GROUP BY l_suppkey""")
def j21(spark, folder):
    situation = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "N").otherwise(F.col("l_returnflag"))
    per = table(spark, folder, "lineitem").groupBy("l_suppkey", situation.alias("situation")).agg(F.sum("l_extendedprice").alias("v"))
    out = joins.situation_columns(per, ["l_suppkey"], "situation", {"A": {"ev5": F.col("v")}, "R": {"pk": F.col("v")}, "N": {"pp": F.col("v")}})
    return r6(out, "ev5", "pk", "pp", digits=2)


@query("j22_head_to_head", f"""
WITH g AS (SELECT pitcher, {half_even_sql('avg(value)', 3)} AS v FROM @feed GROUP BY pitcher)
SELECT a.pitcher AS a, b.pitcher AS b, a.v AS a_value, b.v AS b_value, {r6_sql('greatest(a.v, b.v) / a.v')} AS a_speed, {r6_sql('greatest(a.v, b.v) / b.v')} AS b_speed, CASE WHEN a.v < b.v THEN a.pitcher WHEN b.v < a.v THEN b.pitcher END AS winner
FROM g a JOIN g b ON b.pitcher = a.pitcher + 1""")
def j22(spark, folder):
    g = table(spark, folder, "feed").groupBy("pitcher").agg(round_half_even(F.avg("value"), 3).alias("v"))
    asked = g.select(F.col("pitcher").alias("a"), (F.col("pitcher") + 1).alias("b"))
    return r6(joins.compare_pairs(g, asked, "pitcher", "v"), "a_speed", "b_speed")


@query("j23_parent_club", """
SELECT s_suppkey, n_nationkey AS club_id, n_name AS club_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND s_suppkey % 2 = 0""")
def j23(spark, folder):
    clubs = table(spark, folder, "nation").select(F.col("n_nationkey").alias("club_id"), F.col("n_name").alias("club_name"))
    s = table(spark, folder, "supplier")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    squad = lookup(s, n, ["s_nationkey"]).select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat("n_name", F.lit(" Prospects"))).otherwise(F.lit("National Squad")).alias("team"))
    return joins.remap_teams(squad, "team", clubs).select("s_suppkey", "club_id", "club_name")


# --- deduplication and consolidation --------------------------------------------------------------


@query("a30_natural_key_dedup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def a30(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return entities.dedup(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


@query("a30_whole_row_dedup", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def a30_rows(spark, folder):
    return table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").distinct()


_ENT = """d AS (SELECT c_custkey AS o, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 500 END AS player_id, concat(CASE WHEN c_custkey % 7 = 0 THEN 'JOSE' ELSE 'jose' END, ' r', c_custkey % 500) AS name,
  CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS v FROM customer),
 k AS (SELECT *, lower(name) AS nk FROM d), f AS (SELECT nk, arg_min(player_id, o) AS fid FROM k WHERE player_id IS NOT NULL GROUP BY nk),
 e AS (SELECT k.*, coalesce('id:' || CAST(coalesce(player_id, fid) AS VARCHAR), 'name:' || nk) AS entity FROM k LEFT JOIN f USING (nk))"""


@query("a31_entity_consolidation", f"""WITH {_ENT},
 g AS (SELECT entity, min(o) AS ordinal, count(*) AS n_rows, arg_min(player_id, o) FILTER (WHERE player_id IS NOT NULL) AS player_id, arg_min(v, o) FILTER (WHERE v IS NOT NULL) AS v, arg_min(name, o) AS first_name FROM e GROUP BY entity),
 b AS (SELECT e.entity, arg_max(name, o) AS better FROM e JOIN g USING (entity) WHERE o > ordinal AND (name <> lower(name) OR length(name) > length(first_name)) GROUP BY e.entity)
SELECT entity, ordinal, n_rows, player_id, v, coalesce(better, first_name) AS name FROM g LEFT JOIN b USING (entity)""")
def a31(spark, folder):
    return entities.consolidate(_entity_rows(spark, folder), "player_id", "name", "ordinal")


def _entity_rows(spark, folder):
    i = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        i.alias("ordinal"), F.when(i % 3 != 0, i % 500).alias("player_id"),
        F.concat(F.when(i % 7 == 0, "JOSE").otherwise("jose"), F.lit(" r"), i % 500).alias("name"),
        F.when(i % 2 == 0, F.col("c_acctbal")).alias("v"))


@query("a31_entity_chains", """
WITH RECURSIVE d AS (SELECT c_custkey AS o, CASE WHEN c_custkey % 3 <> 0 THEN 'id:' || CAST(c_custkey % 500 AS VARCHAR) END AS i, CASE WHEN c_custkey % 11 <> 0 THEN 'name:jose r' || CAST(c_custkey % 700 AS VARCHAR) END AS k,
  CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS v FROM customer),
 l AS (SELECT DISTINCT i, k FROM d WHERE i IS NOT NULL AND k IS NOT NULL), e AS (SELECT i AS a, k AS b FROM l UNION SELECT k, i FROM l),
 r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
 c AS (SELECT node, min(other) AS label FROM r GROUP BY node)
SELECT coalesce(label, coalesce(i, k), 'row:' || CAST(o AS VARCHAR)) AS entity, count(*) AS n_rows, min(o) AS ordinal, arg_min(v, o) FILTER (WHERE v IS NOT NULL) AS v, count(DISTINCT i) AS ids
FROM d LEFT JOIN c ON c.node = coalesce(i, k) GROUP BY 1""")
def a31_chains(spark, folder):
    """Ids with two names, names with several ids."""
    i = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        i.alias("ordinal"), F.when(i % 3 != 0, i % 500).alias("player_id"),
        F.when(i % 11 != 0, F.concat(F.when(i % 7 == 0, "JOSÉ").otherwise("jose"), F.lit(" r"), i % 700)).alias("name"), F.when(i % 2 == 0, F.col("c_acctbal")).alias("v"))
    whole = entities.consolidate(rows, "player_id", "name", "ordinal", chains=True).select("entity", "n_rows", "ordinal", "v")
    ids = entities.entity_chains(rows, "player_id", "name", "ordinal").groupBy("entity").agg(F.count_distinct("player_id").alias("ids"))
    return whole.join(ids, "entity")


@query("a32_category_consolidation", f"""WITH {_ENT}, l AS (SELECT nk AS name_key, o, concat('cat', o % 3) AS category, v FROM e)
SELECT name_key, category, v FROM (SELECT *, row_number() OVER (PARTITION BY name_key, category ORDER BY v IS NULL, o) AS rn FROM l) WHERE rn = 1""")
def a32(spark, folder):
    d = _entity_rows(spark, folder).withColumn("category", F.concat(F.lit("cat"), F.col("ordinal") % 3))
    return entities.consolidate_categories(d, "name", "ordinal", "category", ["v"], "v")


@query("a32_player_consolidation", f"""WITH {_ENT}
SELECT nk AS name_key, arg_min(name, o) AS name, arg_min(player_id, o) FILTER (WHERE player_id IS NOT NULL AND player_id <> 0) AS player_id, arg_min(v, o) FILTER (WHERE v IS NOT NULL AND v <> 0) AS v FROM e GROUP BY nk""")
def a32_players(spark, folder):
    return entities.consolidate_players(_entity_rows(spark, folder), "name", "ordinal", ["player_id", "v"])


@query("u1_union_with_tags", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS data_year, o_orderkey AS id, o_totalprice AS v, CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderpriority END AS extra FROM orders""")
def u1(spark, folder):
    """A table per season that the data has; those of odd seasons lack a column."""
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("extra"))
    years = [r["year"] for r in o.select("year").distinct().orderBy("year").collect()]
    seasons = {str(y): o.filter(F.col("year") == y).drop("year", *(["extra"] if y % 2 else [])) for y in years}
    return entities.union_tagged(seasons, "data_year")


@query("u2_first_source_wins", """
SELECT o_orderkey AS game_pk, CASE WHEN o_orderkey % 2 = 0 THEN 'regular' WHEN o_orderkey % 3 = 0 THEN 'breakout' ELSE 'world' END AS kind FROM orders""")
def u2(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("game_pk"))
    return entities.union_first_source([
        o.filter("game_pk % 2 = 0").withColumn("kind", F.lit("regular")), o.filter("game_pk % 3 = 0").withColumn("kind", F.lit("breakout")),
        o.withColumn("kind", F.lit("world"))], ["game_pk"])


@query("u3_k11_resplit_roles", """
WITH p AS (SELECT player_id, gs, pa, gs >= 20 AS is_starter FROM @players)
SELECT *, CASE WHEN pa IS NULL THEN NULL ELSE round_even((100 - (rank() OVER (PARTITION BY is_starter ORDER BY pa NULLS LAST) - 1) / count(pa) OVER (PARTITION BY is_starter) * 100e0) * 10, 0) / 10 END AS pctile FROM p""")
def u3(spark, folder):
    p = table(spark, folder, "players").select("player_id", "gs", "pa")
    starters, relievers = p.filter("gs >= 10"), p.filter("gs < 10")
    again = starters.unionByName(relievers).withColumn("is_starter", appearances.classify_role("gs", threshold=20))
    return ranks.add_strict_percentile(again, "pa", ["is_starter"], lower_better=True)


@query("u5_national_team_preferred", """
SELECT id, team FROM (SELECT l_suppkey AS id, concat('T', l_partkey) AS team, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber * 10 + l_suppkey % 10) AS rn FROM lineitem) WHERE rn = 1""")
def u5(spark, folder):
    p = table(spark, folder, "pitches").select(F.col("pitcher").alias("id"), F.concat(F.lit("T"), "batter").alias("team"), "batter", "line_key")
    return entities.union_preferring(p, ["id"], F.col("batter") % 50 == 0, "line_key").select("id", "team")


@query("k10_upsert", """
SELECT name, season, coalesce(nv, ov) AS xwoba, CASE WHEN nv IS NOT NULL AND ov IS NOT NULL THEN 'updated' WHEN nv IS NOT NULL THEN 'added' ELSE 'kept' END AS status FROM
 (SELECT c_name AS name, CAST(2025 AS INT) AS season, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS ov, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 <> 0 THEN c_acctbal + 1 END AS nv FROM customer) WHERE ov IS NOT NULL OR nv IS NOT NULL""")
def k10(spark, folder):
    from statloom.session import fresh_path
    from statloom.sources import sinks

    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("name"), F.lit(2025).alias("season"), F.col("c_acctbal").alias("xwoba"))
    old = c.filter("i % 2 = 0").drop("i")
    new = c.filter("i % 3 = 0 OR i % 2 <> 0").withColumn("xwoba", F.col("xwoba") + 1).drop("i")
    merged = entities.upsert(old, new, ["name", "season"], "xwoba")
    return spark.read.parquet(sinks.write_upsert(merged, fresh_path(spark, "upsert")))
