"""Writers: each query writes its document or table into the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.numeric import round_half_even
from statloom.operators import grids, ranks, rates, ratings, reshape
from statloom.plans import rating_queries, window_queries
from statloom.plans.aggregate_queries import _HIST
from statloom.plans.registry import SQL, half_even_sql, query, strict_sql, table
from statloom.plans.value_queries import _HITTERS, HITTER_SPECS, hitter_table
from statloom.session import fresh_path
from statloom.sources import sinks


@query("k1_season_documents", f"""WITH {_HITTERS}, p AS (SELECT *, {strict_sql('value', 'metric')} AS up, {strict_sql('value', 'metric', True)} AS down FROM e)
SELECT player_id, role, label, CASE WHEN metric = 'whiff_percent' THEN down ELSE up END AS pctile, value FROM p JOIN (SELECT player_id, role FROM @players) USING (player_id)""")
def k1(spark, folder):
    e = reshape.metric_entries(hitter_table(spark, folder), ["player_id", "season", "role"], HITTER_SPECS)
    docs = sinks.player_documents(e, ["player_id", "season", "role"])
    specs = spark.createDataFrame([(s["key"], s["label"], s["lower_better"]) for s in HITTER_SPECS], "key string, label string, lower_better boolean")
    path = sinks.write_season_documents(docs, fresh_path(spark, "k1"), specs)
    back = spark.read.schema("player_id BIGINT, season INT, role STRING, categories MAP<STRING, STRUCT<pctile: DOUBLE, value: DOUBLE, display: STRING>>").json(f"{path}/players")
    return back.select("player_id", "role", F.explode("categories").alias("label", "c")).select("player_id", "role", "label", "c.pctile", "c.value")


@query("k2_leaderboard_documents", f"""
SELECT player_id, CASE WHEN gs >= 10 THEN 'starter' ELSE 'reliever' END AS role, {strict_sql('pa', 'CASE WHEN gs >= 10 THEN 1 ELSE 0 END', True)} AS pctile FROM @players""")
def k2(spark, folder):
    p = table(spark, folder, "players").select(
        "player_id", "pa", F.lit(2025).alias("season"), F.when(F.col("gs") >= 10, "starter").otherwise("reliever").alias("role"))
    board = ranks.add_strict_percentile(p, "pa", ["role"], lower_better=True)
    path = sinks.write_leaderboard(board, fresh_path(spark, "k2"))
    return spark.read.schema("player_id BIGINT, pctile DOUBLE, season INT, role STRING").json(path).select("player_id", "role", "pctile")


@query("k3_n14_bucket_documents", f"WITH {_HIST} SELECT pitcher, CAST(total_bbe AS BIGINT) AS total_bbe, bucket, count, avg_ev FROM hist WHERE is_league = 0")
def k3(spark, folder):
    h = grids.angle_histogram(table(spark, folder, "pitches"), "pitcher", 30).filter("is_league = 0").drop("total_bbe")
    path = sinks.write_json(sinks.bucket_documents(h, ["pitcher"], ["count", "avg_ev"]), fresh_path(spark, "k3"))
    back = spark.read.schema("pitcher BIGINT, total_bbe BIGINT, buckets ARRAY<STRUCT<bucket: INT, count: BIGINT, avg_ev: DOUBLE>>").json(path)
    return back.select("pitcher", "total_bbe", F.explode("buckets").alias("b")).select("pitcher", "total_bbe", "b.bucket", "b.count", "b.avg_ev")


@query("k4_type_average_documents", f"SELECT season, pitch_type, count(*) AS count, {half_even_sql('avg(release_speed)', 1)} AS velo FROM @pitches GROUP BY ALL HAVING count(*) >= 500")
def k4(spark, folder):
    r = rates.league_rates(table(spark, folder, "pitches"), ["season", "pitch_type"], 500)
    path = sinks.write_json(sinks.type_documents(r, ["season"], "pitch_type", ["count", "velo"]), fresh_path(spark, "k4"))
    back = spark.read.schema("season INT, pitch_types MAP<STRING, STRUCT<count: BIGINT, velo: DOUBLE>>").json(path)
    return back.select("season", F.explode("pitch_types").alias("pitch_type", "r")).select("season", "pitch_type", "r.count", "r.velo")


@query("k5_rating_documents", f"""WITH r AS ({SQL['c6_goalie_ratings']})
SELECT name, season, c AS category, round_even(v * 10, 0) / 10 AS pctile, w AS weight FROM (
 {' UNION ALL '.join(f"SELECT name, season, {c!r} AS c, cat_{c} AS v, {round(w, 4)!r}e0 AS w FROM r" for c, w in ratings.GOALIE_WEIGHTS.items())})""")
def k5(spark, folder):
    rated = rating_queries.c6(spark, folder)
    cats = {c: (f"cat_{c}", F.lit(w)) for c, w in ratings.GOALIE_WEIGHTS.items()}
    path = sinks.write_json(sinks.rating_documents(rated, ["name", "season"], cats), fresh_path(spark, "k5"))
    back = spark.read.schema("name STRING, season INT, categories MAP<STRING, STRUCT<pctile: DOUBLE, weight: DOUBLE>>").json(path)
    return back.select("name", "season", F.explode("categories").alias("category", "c")).select("name", "season", "category", "c.pctile", "c.weight")


@query("k6_n10_game_grade_files", f"""
SELECT game_pk, concat(game_pk, '_', at_bat_number - 1, '_', pitch_number) AS key, {half_even_sql('value / 700', 5)} AS "xRV", {half_even_sql('xwoba_est / 7', 5)} AS stuff FROM @feed""")
def k6(spark, folder):
    scored = table(spark, folder, "feed").select(
        "game_pk", "at_bat_number", "pitch_number", (F.col("value") / 700).alias("xrv_final"), (F.col("xwoba_est") / 7).alias("xrv_stuff"),
        F.lit(0.0).alias("xrv_location"), F.lit(0.0).alias("xrv_tunnel"))
    path = sinks.write_game_grades(scored, fresh_path(spark, "k6"), spread=2)
    return spark.read.schema("key STRING, xRV DOUBLE, stuff DOUBLE, game_pk BIGINT").json(path)


@query("k7_season_grade_maps", f"""SELECT pitcher, pitch_type, count(xrv) AS n, {half_even_sql('avg(xrv) * 100', 3)} AS xrv FROM @pitches GROUP BY ALL""")
def k7(spark, folder):
    g = rates.grade_means(table(spark, folder, "pitches"), ["pitcher", "pitch_type"], ["xrv"])
    path = sinks.write_json(sinks.grade_documents(g, "pitcher", "pitch_type", ["n", "xrv"]), fresh_path(spark, "k7"))
    back = spark.read.schema("pitcher BIGINT, grades MAP<STRING, STRUCT<n: BIGINT, xrv: DOUBLE>>").json(path)
    return back.select("pitcher", F.explode("grades").alias("pitch_type", "g")).select("pitcher", "pitch_type", "g.n", "g.xrv")


@query("k8_compact_grade_map", f"WITH w AS ({SQL['w5_inverted_z_grade']}) SELECT pitcher, pitch_type, grade FROM w")
def k8(spark, folder):
    path = sinks.write_json(sinks.compact_grades(window_queries.w5(spark, folder), "pitcher", "pitch_type", "grade"), fresh_path(spark, "k8"))
    back = spark.read.schema("pitcher BIGINT, grades MAP<STRING, DOUBLE>").json(path)
    return back.select("pitcher", F.explode("grades").alias("pitch_type", "grade"))


@query("k9_trend_documents", f"SELECT pitcher, season, {half_even_sql('avg(release_speed)', 1)} AS velo FROM @pitches GROUP BY ALL")
def k9(spark, folder):
    s = table(spark, folder, "pitches").groupBy("pitcher", "season").agg(round_half_even(F.avg("release_speed"), 1).alias("velo"))
    path = sinks.write_json(rates.trend_series(s, ["pitcher"], "season", ["velo"]), fresh_path(spark, "k9"))
    back = spark.read.schema("pitcher BIGINT, series ARRAY<STRUCT<season: INT, velo: DOUBLE>>").json(path)
    return back.select("pitcher", F.explode("series").alias("s")).select("pitcher", "s.season", "s.velo")


@query("k12_table_sinks", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def k12(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    path = sinks.write_table(li, fresh_path(spark, "k12"), ["l_returnflag"])
    csv = sinks.write_csv(spark.read.parquet(path).drop("l_returnflag"), fresh_path(spark, "k12-csv"))
    return spark.read.schema("l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_quantity DOUBLE").csv(csv, header=True)
