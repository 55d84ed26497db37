"""Readers, joins, consolidation, grids, documents, models."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from statloom.functions.buckets import ANGLE_LABELS
from statloom.operators import entities, grids, joins, models, norms, ratings, rates, reshape
from statloom.session import fresh_path, shared_dir
from statloom.sources import html_tables, sinks, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_payload_kind(one):
    assert one(tables.payload_kind("x"), x="<!DOCTYPE html>") == "html"
    assert one(tables.payload_kind("x"), x="a,b\n<TABLE>") == "html"
    assert one(tables.payload_kind("x"), x="﻿Name,x\n1,2") == "csv"
    assert one(tables.payload_kind("x"), x=" \n") == "blank"


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing required columns: b"):
        reshape.require_columns(spark.range(1).toDF("a"), ["a", "b"])


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,±x ,name\n0,1,José\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("Unnamed: 0,±x ,name\n0,2,Núñez\n", encoding="latin-1")
    out = tables.csv_any_encoding(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert rows(out, "pmx", "name") == [("1", "José"), ("2", "Núñez")]


def test_strict_csv_drops_rows_of_another_width(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,name\n1,"a, b"\n2\n3,c,d\n4,e\n')
    out = tables.strict_csv(spark, str(tmp_path / "c.csv"), "id INT, name STRING")
    assert rows(out) == [(1, "a, b"), (4, "e")]
    assert rows(out, "id") == [(1,), (4,)]


def test_stepped_ranges_stop_yesterday(spark):
    spans = spark.sql("SELECT 2025 AS season, DATE'2025-03-27' AS start, DATE'2025-10-01' AS `end`")
    got = tables.stepped_ranges(spans, 14, F.lit("2025-04-15").cast("date"))
    assert [(r["chunk"], str(r["start"]), str(r["end"])) for r in got.orderBy("chunk").collect()] == [
        (1, "2025-03-27", "2025-04-09"), (2, "2025-04-10", "2025-04-14")]


def test_html_table(spark):
    html = ("<table><tr><td>1</td></tr></table><table class=a><tr><th>Player</th><th>Shots</th></tr><tr><th></th><th>On&amp;Off</th></tr>"
            "<tr><td>A <b>B</b></td><td> 3 </td></tr><tr><th></th><th>On&amp;Off</th></tr><tr><td>C</td><td>4</td></tr></table>")
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "id int, html string")
    got = [r["record"] for r in html_tables.table_records(pages, ["id"], "html").orderBy("row_no").collect()]
    assert got == [{"Player": "A B", "Shots On&Off": "3"}, {"Player": "C", "Shots On&Off": "4"}]


def test_consolidation(spark):
    d = spark.createDataFrame([
        (1, 10, "jose ramirez", None, 1.0), (2, None, "José Ramírez", 5.0, 2.0), (3, 11, "Jose Ramirez", 7.0, None), (4, None, "Ann", None, None)],
        "o int, id int, name string, a double, b double")
    got = {r["entity"]: r for r in entities.consolidate(d, "id", "name", "o").collect()}
    assert got["id:10"]["name"] == "José Ramírez" and (got["id:10"]["a"], got["id:10"]["b"]) == (5.0, 1.0)
    assert got["id:11"]["n_rows"] == 1 and got["name:ann"]["a"] is None
    merged = entities.consolidate(d, "id", "name", "o", by_name=True)
    assert sorted(r["n_rows"] for r in merged.collect()) == [1, 3]


def test_outer_join_falls_back_to_names(spark):
    a = spark.createDataFrame([(1, "A B", 1.0), (None, "José C", 2.0), (3, "Only", 3.0)], "id int, name string, x double")
    b = spark.createDataFrame([(1, "a b", 9.0), (2, "Jose C.", 8.0), (4, "Only", 7.0)], "id int, name string, y double")
    got = rows(joins.outer_join_with_name_fallback(a, b, "id", "name"), "id", F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)))
    # two different ids under one name stay apart
    assert got == [(1, 1.0, 9.0), (2, 2.0, 8.0), (3, 3.0, 0.0), (4, 0.0, 7.0)]


def test_preferred_fastball(spark):
    d = spark.createDataFrame([(1, "FC", 90.0, 5), (1, "SI", 93.0, 2), (2, "FF", None, 9), (2, "FC", 88.0, 3)],
                              "player_id int, pitch_type string, velo double, n int")
    assert rows(joins.preferred_fastball(d), "player_id", "pitch_type") == [(1, "SI"), (2, "FC")]


def test_unique_join_keeps_the_row_count(spark):
    left = spark.range(10).withColumn("k", F.col("id") % 3)
    right = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "k long, v int")
    assert joins.join_unique(left, right, ["k"], [F.col("v")]).count() == 10


def test_upsert_status(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "n string, v double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "n string, v double")
    assert rows(entities.upsert(old, new, ["n"], "v")) == [("a", 1.0, "kept"), ("b", 3.0, "updated"), ("c", 4.0, "added")]


def test_histogram_has_every_bucket_and_merge_keeps_counts(spark):
    d = spark.createDataFrame([(1, 90.0 + i, float(a)) for i, a in enumerate((-10, 3, 3, 40, 41))] + [(2, 50.0, 0.0)], "p int, launch_speed double, launch_angle double")
    h = grids.angle_histogram(d, "p", 5)
    league = h.filter("is_league = 1").orderBy("bucket").collect()
    assert [r["label"] for r in league] == list(ANGLE_LABELS) and sum(r["count"] for r in league) == 6
    assert h.filter("is_league = 0").select("p").distinct().count() == 1
    assert league[5]["avg_ev"] is None
    wide = grids.merge_angle_buckets(h, ["is_league", "p"]).filter("is_league = 1")
    assert wide.agg(F.sum("count")).first()[0] == 6 and wide.count() == 7


def test_density_peaks_at_the_point(spark):
    d = spark.createDataFrame([("a", 0.0, 2.5)], "k string, x double, z double")
    g = grids.density_grid(d, ["k"], "x", "z", (-2.0, 2.0), (0.0, 5.0), 40, 50)
    top = g.orderBy(F.desc("density")).first()
    assert (top["row"], top["col"], top["relative"]) == (25, 20, 1.0) and g.agg(F.min("density")).first()[0] < 0.02


def test_z_grade_skips_kinds_without_spread(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "kind string, v double")
    got = rows(norms.inverted_z_grade(d, "v", "kind"), "kind", "grade")
    assert got == [("a", 92.9), ("a", 107.1)]


def test_weighted_means_skip_nulls(spark):
    d = spark.createDataFrame([(1, 10.0, 1.0), (1, None, 5.0), (1, 40.0, 3.0), (2, None, 1.0)], "k int, r double, w double")
    assert rows(rates.weighted_means(d, ["k"], ["r"], "w")) == [(1, 32.5), (2, None)]


def test_box_line_beats_plays(spark):
    box = spark.createDataFrame([(1, 7, 18, None)], "g int, p int, outs int, k int")
    pbp = spark.createDataFrame([(1, 7, 17, 4), (2, 7, 3, 1)], "g int, p int, outs int, k int")
    assert rows(rates.prefer_box(box, pbp, ["g", "p"], ["outs", "k"])) == [(1, 7, True, 18, 0), (2, 7, False, 3, 1)]


def test_goalie_blend_and_seasons(spark):
    d = spark.createDataFrame([("a", "x", 2025, 30.0, 3600.0, 2.0, 0.5), ("a", "y", 2024, 20.0, 7200.0, 1.0, 0.4), ("b", "z", 2023, 60.0, 3600.0, 1.0, 0.9)],
                              "name string, team string, season int, gp double, icetime_sec double, r double, gp_share double")
    got = ratings.blend_goalies(ratings.blended_key(d), ["r"], []).collect()
    assert [(g["name_key"], g["team"], g["gp"]) for g in got] == [("a", "x", 50.0)]
    w1, w2 = 0.53 * 60, 0.31 * 120
    assert abs(got[0]["r"] - (2 * w1 + w2) / (w1 + w2)) < 1e-12


def test_game_files_are_compressed_json(spark, tmp_path):
    d = spark.createDataFrame([(5, 1, i, 0.1234567, 0.0, 0.0, 0.0) for i in range(20)],
                              "game_pk long, at_bat_number int, pitch_number int, xrv_final double, xrv_stuff double, xrv_location double, xrv_tunnel double")
    # tiny partitions are merged at run time unless that is switched off; the spread itself is looked at here
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = sinks.write_game_grades(d, str(tmp_path / "games"), spread=4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in os.listdir(f"{path}/game_pk=5") if f.endswith(".json.gz")]
    text = "".join(gzip.open(f"{path}/game_pk=5/{f}", "rt").read() for f in files)
    assert len(files) > 1 and text.count('"xRV":0.12346') == 20 and '"key":"5_0_3"' in text


def test_scores_default_where_features_are_missing(spark):
    d = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).cast("double").alias("b"),
                                F.when(F.col("id") % 2 == 0, "FF").otherwise("FO").alias("pitch_type")).withColumn("y", F.col("a") + 1)
    fits = models.train_per_type(d.withColumn("pitch_type", F.lit("FS")), ["FS"], ["a", "b"], "y", maxIter=2, maxDepth=2)
    out = models.score_per_type(d, fits, ["a", "b"], "s").collect()
    assert len(out) == 200
    for r in out:
        assert (r["s"] != 0) == (r["pitch_type"] == "FO" and r["b"] is not None)


def test_split_does_not_depend_on_layout(spark):
    d = spark.range(1000)
    a = rows(models.key_split(d, ["id"]).filter("is_test"), "id")
    b = rows(models.key_split(d.repartition(7), ["id"]).filter("is_test"), "id")
    assert a == b and 120 < len(a) < 280


def test_player_games_are_not_moved_as_pairs(spark):
    games = spark.createDataFrame([(1, "A", "B"), (2, "B", "C"), (3, "A", "A"), (4, None, "A"), (4, "C", "B")], "game_pk int, away string, home string")
    log = spark.createDataFrame([(9, 1), (9, 1), (9, 7)], "player_id int, game_pk int")
    players = spark.createDataFrame([(5, "A"), (5, "B"), (5, "A"), (6, "C"), (7, None), (9, "A")], "player_id int, team string")
    got = joins.player_games(games, log, players)
    assert rows(got) == [(5, 1), (5, 2), (5, 3), (5, 4), (6, 2), (6, 4), (9, 1)]
    plan = got._jdf.queryExecution().optimizedPlan()
    pairs = [plan.children().apply(i).toString() for i in range(plan.children().size())][1]
    assert "Aggregate [player_id" not in pairs.split("Join Inner")[0]


def test_player_games_join_packs(spark, monkeypatch):
    monkeypatch.setattr(joins, "GAMES_TOGETHER", 100, raising=False)
    monkeypatch.setattr(joins, "PLAYERS_TOGETHER", 7, raising=False)
    names = [(i, f"T{i % 4}", f"T{(i + 1) % 4}") for i in range(400)] + [(0, "T2", None), (None, "T1", "T3")]
    own = {p: {f"T{p % 4}"} | ({"T1"} if p % 5 == 0 else set()) for p in range(40)}
    games = spark.createDataFrame(names, "game_pk long, away string, home string")
    players = spark.createDataFrame([(p, t) for p, ts in own.items() for t in ts], "player_id long, team string")
    log = spark.createDataFrame([(3, 1), (3, 999)], "player_id long, game_pk long")
    got = joins.player_games(games, log, players)
    pairs = list(map(tuple, got.collect()))
    want = {(p, g) for p, ts in own.items() if p != 3 for g, away, home in names if ts & {away, home}} | {(3, 1)}
    assert len(pairs) == len(want) and set(pairs) == want
    # runs of a player over a slice of games: what is written packs well, and no row is a pair before the last step
    assert sum(a[0] != b[0] for a, b in zip(pairs, pairs[1:], strict=False)) < len(pairs) / 4
    assert "__games" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pitching_lines_parse_a_document_once(spark):
    from statloom.sources import game_json

    doc = """{"allPlays": [{"result": {"type": "atBat", "event": "Walk"}, "matchup": {"pitcher": {"id": 1}}, "runners": null, "playEvents": [{"isPitch": true}]},
     {"result": {"type": "atBat", "event": "Single"}, "matchup": {"pitcher": {"id": 1}}, "runners": [null, {"movement": {"isOut": true}}, {"movement": {"end": "score"}},
      {"movement": {"end": "score"}, "details": {"isEarned": true}}, {"movement": {"end": "score"}, "details": {"responsiblePitcher": {"id": 2}}}]},
     {"result": {"type": "action"}, "matchup": {"pitcher": {"id": 3}}}]}"""
    docs = spark.createDataFrame([(7, doc)], "game_pk int, doc string")
    for schema in (game_json.PLAYS_SCHEMA, game_json.LINES_SCHEMA):
        got = game_json.pitching_lines(game_json.playlist(docs, "doc", ["game_pk"], schema), ["game_pk"])
        assert rows(got, "pitcher", "bf", "bb", "h", "outs", "runs", "er") == [(1, 2, 1, 1, 1, 2, 1), (3, 0, 0, 0, 0, 0, 0)]
        assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_pitches_need_no_runners(spark):
    from statloom.sources import game_json

    doc = """{"allPlays": [{"atBatIndex": 4, "result": {"event": "Walk"}, "matchup": {"pitcher": {"id": 1}}, "runners": [{"movement": {"isOut": true}}],
     "playEvents": [{"isPitch": true, "pitchNumber": 1, "count": {"balls": 1, "strikes": 0}, "pitchData": {"startSpeed": 90.5}},
      {"isPitch": true, "pitchNumber": 2, "pitchData": {"startSpeed": 91.5}}]}]}"""
    docs = spark.createDataFrame([(7, doc)], "game_pk int, doc string")
    whole, less = [game_json.pitches(game_json.playlist(docs, "doc", ["game_pk"], s), ["game_pk"]).collect() for s in (game_json.PLAYS_SCHEMA, game_json.PITCHES_SCHEMA)]
    assert whole == less and [(r["pitch_number"], r["velo"], r["balls"]) for r in less] == [(1, 90.5, 0), (2, 91.5, 1)]
