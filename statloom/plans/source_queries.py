"""Readers. Files they read are first written from the given tables, whole, into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import physics
from statloom.operators import rates, reshape
from statloom.operators.keys import lookup
from statloom.plans.aggregate_queries import event_column
from statloom.plans.aggregate_queries import _EVENT_SQL as EVENT
from statloom.plans.registry import half_even_sql, half_up_sql, query, r6, r6_sql, table
from statloom.session import fresh_path, spread
from statloom.sources import game_json, html_tables, sinks, tables


@query("s1_leaderboard_csv", """
SELECT c_custkey AS player_id, c_name AS player_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS velo FROM customer WHERE c_custkey % 10 <> 0""")
def s1(spark, folder):
    c, i = table(spark, folder, "customer"), F.col("c_custkey")
    keep = i % 10 != 0
    out = c.select(F.when(keep, i).alias("player_id"), F.when(keep, F.col("c_name")).alias("player_name"),
                   F.when(keep & (i % 5 != 0), F.col("c_acctbal")).alias("velo"))
    path = sinks.write_csv(out, fresh_path(spark, "s1"))
    return tables.leaderboard_csv(spark, path, "player_id BIGINT, player_name STRING, velo DOUBLE")


@query("s2_any_encoding_csv", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, strip_accents('x') AS pm_diff, concat('é', lang) AS accented FROM documents""")
def s2(spark, folder):
    d = table(spark, folder, "documents").select(
        F.lit("0").alias("Unnamed: 0"), "doc_id", F.col("lang").alias("lang "), F.lit("x").alias("±_diff"), F.concat(F.lit("é"), "lang").alias("accented"))
    even, odd = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")
    a = sinks.write_csv(even, fresh_path(spark, "s2-utf8"))
    b = sinks.write_csv(odd, fresh_path(spark, "s2-latin1"), encoding="ISO-8859-1")
    out = tables.csv_any_encoding(spark, [a, b])
    return out.select("doc_id", "lang", "pm_diff", "accented")


@query("s3_strict_csv", """
SELECT s_suppkey AS id, concat(s_name, ', "Jr"') AS name, s_acctbal AS v FROM supplier WHERE s_suppkey % 4 NOT IN (1, 2)""")
def s3(spark, folder):
    k = F.col("s_suppkey")
    good = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), "s_name", F.lit(', \\"Jr\\""')), F.col("s_acctbal").cast("string"))
    short = F.concat_ws(",", k.cast("string"), F.col("s_name"))
    long = F.concat(good, F.lit(",extra"))
    line = F.when(k % 4 == 1, short).when(k % 4 == 2, long).otherwise(good)
    lines = table(spark, folder, "supplier").select(line.alias("value"))
    path = fresh_path(spark, "s3")
    # a task's first line is preceded by the header, so that every part file has one
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.when(first, F.array(F.lit("id,name,v"), F.col("value"))).otherwise(F.array("value"))
    lines.select(F.explode(header).alias("value")).write.text(path)
    return tables.strict_csv(spark, path, "id BIGINT, name STRING, v DOUBLE")


@query("s4_payload_gate", """
SELECT kind, count(*) AS n FROM (SELECT 'html' AS kind FROM pages UNION ALL SELECT CASE WHEN trim(text, E' \\t\\n') = '' THEN 'blank' WHEN lower(text) LIKE '%<table%' OR lower(ltrim(text, E' \\t\\n')) LIKE '<!%' OR lower(ltrim(text, E' \\t\\n')) LIKE '<html%' THEN 'html' ELSE 'csv' END FROM documents) GROUP BY kind""")
def s4(spark, folder):
    p = table(spark, folder, "pages").select(F.col("html").alias("payload"))
    d = table(spark, folder, "documents").select(F.col("text").alias("payload"))
    return p.unionByName(d).select(tables.payload_kind("payload").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s4_usable_payloads", """
SELECT doc_id FROM documents WHERE lower(text) NOT LIKE '%<table%' AND lower(ltrim(text)) NOT LIKE '<!%' AND lower(ltrim(text)) NOT LIKE '<html%' AND trim(text) <> ''""")
def s4_usable(spark, folder):
    good, _ = tables.split_payloads(table(spark, folder, "documents"), "text")
    return good.select("doc_id")


@query("s5_page_list_harvest", """
WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul\\s*>', 1)) AS body, generate_subscripts(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul\\s*>', 1), 1) AS o FROM pages),
 b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len(regexp_extract_all(body, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)) DESC, o) AS rn FROM u),
 r AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)) AS li, generate_subscripts(regexp_extract_all(body, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1), 1) - 1 AS row_no FROM b WHERE rn = 1)
SELECT page_id, CAST(row_no AS INT) AS row_no, trim(regexp_replace(regexp_extract(li, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), '\\s+', ' ', 'g')) AS entry FROM r WHERE regexp_matches(li, '(?is)<a\\b[^>]*>(.*?)</a\\s*>')""")
def s5(spark, folder):
    p = table(spark, folder, "pages").select("page_id", "html")
    rows = html_tables.block_rows(p, ["page_id"], "html", container="ul", row="li", cell="a")
    return rows.select("page_id", "row_no", F.col("cells")[0].alias("entry"))


@query("s5_html_tables", """
SELECT c_nationkey AS page_id, CAST(count(*) AS BIGINT) AS records, CAST(sum(c_custkey) AS BIGINT) AS id_sum FROM (SELECT c_nationkey, c_custkey FROM customer UNION ALL SELECT c_nationkey, c_custkey FROM customer WHERE false) GROUP BY c_nationkey""")
def s5_tables(spark, folder):
    # one page per 20 customers of a nation: a title block of two stacked header rows, a repeated header, a decoy table
    c = table(spark, folder, "customer").withColumn("part", F.floor(F.col("c_custkey") / 500))
    row = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td><td><b>"), F.col("c_name"), F.lit("</b></td></tr>"))
    pages = c.groupBy("c_nationkey", "part").agg(F.array_join(F.collect_list(row), "").alias("body"))
    head = "<tr><th>Player</th><th>Full</th></tr><tr><th>Id</th><th>Name</th></tr>"
    html = F.concat(F.lit("<html><table class='x'><tr><td>1</td></tr></table><TABLE id=t>" + head), "body", F.lit("<tr><th>Id</th><th>Name</th></tr></TABLE></html>"))
    records = html_tables.table_records(pages.select("c_nationkey", "part", html.alias("html")), ["c_nationkey", "part"], "html")
    one = records.select("c_nationkey", "part", F.col("record")["Player Id"].try_cast("bigint").alias("id"), F.col("record")["Full Name"].alias("n"))
    got = one.filter(F.col("n").isNotNull()).groupBy(F.col("c_nationkey").alias("page_id")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("id").alias("id_sum"))
    return got


@query("s5_nested_tables", """
SELECT c_nationkey, c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('home ', c_mktsegment, ' acct ', CAST(c_acctbal AS VARCHAR)) ELSE c_mktsegment END AS contact FROM customer""")
def s5_nested(spark, folder):
    """Cells that hold a table of their own, rows without end tags, a comment and a script with tags in them, and a larger table inside a smaller one."""
    c = table(spark, folder, "customer").withColumn("part", F.floor(F.col("c_custkey") / 500))
    inner = F.concat(F.lit("<table><tr><th>home</th><td>"), "c_mktsegment", F.lit("</td></tr><tr><td>acct</td><td>"), F.col("c_acctbal").cast("string"), F.lit("</td></tr></table>"))
    cell = F.when(F.col("c_custkey") % 3 == 0, inner).otherwise(F.col("c_mktsegment"))
    end = F.when(F.col("c_custkey") % 2 == 0, "</td></tr>").otherwise("")
    row = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td><td><b>"), "c_name", F.lit("</b><td>"), cell, end, F.lit("<!-- <tr><td>no</td></tr> -->"))
    pages = c.groupBy("c_nationkey", "part").agg(F.array_join(F.collect_list(row), "").alias("body"))
    html = F.concat(F.lit("<html><script>'<table>'</script><table class='lay'><tr><td>menu</td></tr><tr><td>about<td><TABLE id=t><tr><th>Id</th><th>Name</th><th>Contact</th></tr>"),
                    "body", F.lit("</TABLE></td></tr></table></html>"))
    records = html_tables.table_records(pages.select("c_nationkey", "part", html.alias("html")), ["c_nationkey", "part"], "html")
    r = F.col("record")
    return records.select("c_nationkey", r["Id"].cast("bigint").alias("id"), r["Name"].alias("name"), r["Contact"].alias("contact"))


@query("s6_required_columns", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS pitchers FROM lineitem")
def s6(spark, folder):
    t = tables.parquet_table(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_suppkey"])
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("pitchers"))


@query("s7_season_files", f"""
SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS v FROM orders""")
def s7(spark, folder):
    base = fresh_path(spark, "s7")
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    years = sorted(r["y"] for r in o.select("y").distinct().na.drop().collect())  # a row per season
    for y in years:
        sinks.write_csv(o.filter(F.col("y") == y).drop("y"), f"{base}/{y}{tables.SEASON_FILE_TYPES['pp_indiv']}.csv")
    got = tables.season_tables(spark, base, [min(years, default=0) - 1, *years], {"pp_indiv": "id BIGINT, v DOUBLE", "qoc": "id BIGINT"})
    assert got["qoc"] is None
    return got["pp_indiv"]


# --- nested documents -----------------------------------------------------------------------------

# one play per line item: two tracked pitches, a tracked third without a count before it, and a pick-off throw
_PLAYS = """to_json(named_struct('allPlays', array(named_struct(
  'atBatIndex', l_linenumber, 'result', named_struct('type', 'atBat', 'event', ev),
  'matchup', named_struct('pitcher', named_struct('id', l_suppkey), 'batter', named_struct('id', l_partkey), 'batSide', named_struct('code', CASE WHEN l_partkey % 2 = 0 THEN 'L' ELSE 'R' END)),
  'runners', array(
     named_struct('movement', named_struct('isOut', l_partkey % 3 = 0, 'end', CASE WHEN l_partkey % 4 = 0 THEN 'score' ELSE '1B' END), 'details', named_struct('responsiblePitcher', CASE WHEN l_partkey % 8 = 0 THEN named_struct('id', l_suppkey + 1) END, 'isEarned', l_partkey % 5 = 0)),
     named_struct('movement', named_struct('isOut', true, 'end', CAST(NULL AS STRING)), 'details', CAST(NULL AS STRUCT<responsiblePitcher: STRUCT<id: BIGINT>, isEarned: BOOLEAN>))),
  'playEvents', array(
     named_struct('isPitch', true, 'pitchNumber', 1, 'count', named_struct('balls', 1, 'strikes', 0), 'details', named_struct('call', named_struct('code', 'B'), 'type', named_struct('code', 'FF', 'description', 'Four')), 'pitchData', named_struct('startSpeed', 80 + l_quantity, 'extension', 6.0D, 'coordinates', named_struct('pX', l_tax, 'pZ', 2.5D, 'z0', 5.5D, 'vY0', -130.0D - l_quantity / 10, 'vZ0', -4.0D, 'aY', 25.0D, 'aZ', -20.0D))),
     named_struct('isPitch', false, 'pitchNumber', CAST(NULL AS INT), 'count', named_struct('balls', 3, 'strikes', 2), 'details', NULL, 'pitchData', NULL),
     named_struct('isPitch', true, 'pitchNumber', 2, 'count', NULL, 'details', named_struct('call', named_struct('code', 'S'), 'type', NULL), 'pitchData', named_struct('startSpeed', 70 + l_quantity, 'extension', 6.0D, 'coordinates', named_struct('pX', l_tax, 'pZ', 2.5D, 'z0', 5.5D, 'vY0', CAST(NULL AS DOUBLE), 'vZ0', CAST(NULL AS DOUBLE), 'aY', CAST(NULL AS DOUBLE), 'aZ', CAST(NULL AS DOUBLE)))),
     named_struct('isPitch', true, 'pitchNumber', 3, 'count', named_struct('balls', 1, 'strikes', 1), 'details', named_struct('call', named_struct('code', 'X'), 'type', named_struct('code', 'SL', 'description', 'Slide')), 'pitchData', named_struct('startSpeed', 75 + l_quantity, 'extension', CAST(NULL AS DOUBLE), 'coordinates', CAST(NULL AS STRUCT<pX: DOUBLE, pZ: DOUBLE, z0: DOUBLE, vY0: DOUBLE, vZ0: DOUBLE, aY: DOUBLE, aZ: DOUBLE>))))))))"""


def play_documents(spark, folder):
    li = spread(table(spark, folder, "lineitem")).withColumn("ev", event_column())
    return li.selectExpr("l_orderkey AS game_pk", f"{_PLAYS} AS doc")


_T2 = "((-vy - sqrt(vy * vy - 2 * 25e0 * (50e0 - 17e0 / 12e0))) / 25e0)"


@query("s8_play_by_play_pitches", f"""
WITH p AS (SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, l_suppkey AS pitcher, l_partkey AS batter, {EVENT} AS result, l_quantity AS q, l_tax, -130e0 - l_quantity / 10 AS vy FROM lineitem)
SELECT game_pk, at_bat_index, pitcher, batter, result, n AS pitch_number, CASE n WHEN 1 THEN 'FF' WHEN 2 THEN 'UN' ELSE 'SL' END AS pitch_type, CASE n WHEN 1 THEN 80 WHEN 2 THEN 70 ELSE 75 END + q AS velo, CASE n WHEN 1 THEN 0 ELSE 1 END AS balls, 0 AS strikes,
 n > 1 AS is_swing, n = 2 AS is_whiff, CASE n WHEN 1 THEN {half_up_sql(f'degrees(atan((-4e0 + -20e0 * {_T2}) / abs(vy + 25e0 * {_T2})))', 1)} WHEN 2 THEN {half_up_sql('degrees(atan((2.5e0 - 5.5e0) / (60.5e0 - 6e0)))', 1)} END AS vaa
FROM p, (SELECT unnest([1, 2, 3]) AS n)""")
def s8(spark, folder):
    plays = game_json.playlist(play_documents(spark, folder), "doc", ["game_pk"], game_json.PITCHES_SCHEMA)
    return game_json.pitches(plays, ["game_pk"]).select(
        "game_pk", "at_bat_index", "pitcher", "batter", "result", "pitch_number", "pitch_type", "velo", "balls", "strikes", "is_swing", "is_whiff", "vaa")


_LINES = f"""pl AS (SELECT l_orderkey AS game_pk, l_suppkey AS pitcher, {EVENT} AS ev, l_partkey AS k FROM lineitem),
 pb AS (SELECT game_pk, pitcher, count(*) AS bf, count(*) FILTER (WHERE ev IN ('Strikeout','Strikeout Double Play')) AS k, count(*) FILTER (WHERE ev IN ('Walk','Intent Walk')) AS bb, count(*) FILTER (WHERE ev = 'Hit By Pitch') AS hbp,
  count(*) FILTER (WHERE ev IN ('Single','Double','Triple','Home Run')) AS h, count(*) FILTER (WHERE ev = 'Home Run') AS hr, CAST(sum(1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS outs,
  count(*) FILTER (WHERE k % 4 = 0 AND k % 8 <> 0) AS runs, count(*) FILTER (WHERE k % 4 = 0 AND k % 8 <> 0 AND k % 5 = 0) AS er FROM pl GROUP BY ALL)"""


@query("a23_pitching_lines", f"WITH {_LINES} SELECT * FROM pb")
def a23(spark, folder):
    plays = game_json.playlist(play_documents(spark, folder), "doc", ["game_pk"], game_json.LINES_SCHEMA)
    return game_json.pitching_lines(plays, ["game_pk"])


def _stat_struct(kind: str) -> str:
    if kind == "pitching":
        return ("named_struct('inningsPitched', concat(o_orderkey % 7, '.', o_orderkey % 3), 'hits', o_orderkey % 9, 'runs', o_orderkey % 5, 'earnedRuns', o_orderkey % 4, "
                "'strikeOuts', o_orderkey % 10, 'baseOnBalls', o_orderkey % 3, 'hitBatsmen', IF(o_orderkey % 4 = 0, 0, NULL), 'hitByPitch', IF(o_orderkey % 8 = 1, NULL, 0), 'homeRuns', o_orderkey % 2, 'battersFaced', 20 + o_orderkey % 9, 'pitchesThrown', o_orderkey % 2)")
    return ("named_struct('plateAppearances', 3 + o_orderkey % 3, 'atBats', 3, 'hits', 1 + o_orderkey % 2, 'doubles', o_orderkey % 2, 'triples', 0, 'homeRuns', 0, 'baseOnBalls', o_orderkey % 2, "
            "'hitByPitch', 0, 'sacFlies', 0)")


def _side(player: str, team: str, stats: str) -> str:
    return (f"named_struct('team', named_struct('id', {team}, 'abbreviation', concat('T', {team})), 'players', map(concat('ID', {player}), named_struct("
            f"'person', named_struct('id', {player}, 'fullName', concat('P ', {player})), 'position', named_struct('abbreviation', 'P', 'type', 'Pitcher'), 'stats', {stats})))")


def box_documents(spark, folder):
    away = _side("o_custkey % 50", "o_orderkey % 30", f"named_struct('pitching', {_stat_struct('pitching')}, 'batting', {_stat_struct('batting')})")
    home = _side("o_custkey + 1000", "(o_orderkey + 7) % 30", f"named_struct('pitching', named_struct(), 'batting', {_stat_struct('batting')})").replace(
        "'pitching', named_struct()", "'pitching', CAST(NULL AS STRUCT<hits: INT>)")
    o = table(spark, folder, "orders")
    return o.selectExpr("o_orderkey AS game_pk", f"to_json(named_struct('teams', named_struct('away', {away}, 'home', {home}))) AS doc")


def box_rows(spark, folder):
    return game_json.box_players(game_json.parse(box_documents(spark, folder), "doc", game_json.BOX_SCHEMA, ["game_pk"]), ["game_pk"])


@query("s9_box_score_players", """
SELECT o_orderkey AS game_pk, 'away' AS side, o_custkey % 50 AS player_id, concat('T', o_orderkey % 30) AS team, 'pitcher' AS role FROM orders WHERE o_orderkey % 2 >= 1 OR concat(o_orderkey % 7, '.', o_orderkey % 3) <> '0.0'
UNION ALL SELECT o_orderkey, 'away', o_custkey % 50, concat('T', o_orderkey % 30), 'hitter' FROM orders UNION ALL SELECT o_orderkey, 'home', o_custkey + 1000, concat('T', (o_orderkey + 7) % 30), 'hitter' FROM orders""")
def s9(spark, folder):
    return game_json.played_roles(box_rows(spark, folder)).select("game_pk", "side", "player_id", "team", "role")


@query("a24_a26_season_pitching_totals", f"""
WITH {_LINES}, bx AS (SELECT o_orderkey AS game_pk, o_custkey % 50 AS pitcher, (o_orderkey % 7) * 3 + o_orderkey % 3 AS outs, o_orderkey % 4 AS er, o_orderkey % 10 AS k, o_orderkey % 3 AS bb, o_orderkey % 2 AS hr, 20 + o_orderkey % 9 AS bf FROM orders),
 j AS (SELECT coalesce(bx.game_pk, pb.game_pk) AS game_pk, coalesce(bx.pitcher, pb.pitcher) AS pitcher, coalesce(bx.outs, pb.outs) AS outs, coalesce(bx.er, pb.er) AS er, coalesce(bx.k, pb.k) AS k, coalesce(bx.bb, pb.bb) AS bb, coalesce(bx.hr, pb.hr) AS hr, coalesce(bx.bf, pb.bf) AS bf,
  CASE WHEN bx.pitcher IS NOT NULL THEN 1 ELSE 0 END AS b FROM pb FULL JOIN bx ON bx.game_pk = pb.game_pk AND bx.pitcher = pb.pitcher)
SELECT pitcher, count(*) AS games, CAST(sum(b) AS BIGINT) AS box_games, CAST(sum(outs) AS BIGINT) AS outs, CAST(sum(er) AS BIGINT) AS er, CAST(sum(k) AS BIGINT) AS k, CAST(sum(bb) AS BIGINT) AS bb, CAST(sum(hr) AS BIGINT) AS hr, CAST(sum(bf) AS BIGINT) AS bf FROM j GROUP BY pitcher""")
def a24(spark, folder):
    plays = game_json.playlist(play_documents(spark, folder), "doc", ["game_pk"], game_json.LINES_SCHEMA)
    stats = ["outs", "er", "k", "bb", "hr", "bf"]
    games = rates.prefer_box(game_json.box_pitching(box_rows(spark, folder), ["game_pk"]), game_json.pitching_lines(plays, ["game_pk"]), ["game_pk", "pitcher"], stats)
    return games.groupBy("pitcher").agg(
        F.count(F.lit(1)).alias("games"), F.count_if("from_box").alias("box_games"), *[F.sum(s).alias(s) for s in stats])


@query("a25_season_batting_totals", f"""
WITH b AS (SELECT o_orderkey AS g, o_custkey % 50 AS batter FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1000 FROM orders),
 l AS (SELECT batter, sum(3 + g % 3) AS pa, sum(3) AS ab, sum(1 + g % 2) AS h, sum(g % 2) AS bb, 0 AS hbp, 0 AS sf, sum(1 + g % 2 + g % 2) AS tb FROM b GROUP BY batter)
SELECT batter, CAST(pa AS BIGINT) AS pa, CAST(ab AS BIGINT) AS ab, CAST(h AS BIGINT) AS h, CAST(tb AS BIGINT) AS tb, {half_up_sql('(h + bb + hbp) / (ab + bb + hbp + sf)', 3)} AS obp, {half_up_sql('tb / ab', 3)} AS slg FROM l""")
def a25(spark, folder):
    b = game_json.box_batting(box_rows(spark, folder), ["game_pk"]).groupBy("batter").agg(
        *[F.sum(c).alias(c) for c in ("pa", "ab", "h", "bb", "hbp", "sf", "tb")])
    return rates.batting_rates(b.withColumn("k", F.lit(0))).select("batter", "pa", "ab", "h", "tb", "obp", "slg")


@query("s10_schedule_games", """
SELECT o_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Scheduled' ELSE 'In Progress' END AS status, o_orderstatus = 'P' AS is_live,
 o_custkey % 60 AS away_id, (o_custkey + 31) % 60 AS home_id, CAST(o_orderkey % 11 AS INT) AS away_score, (o_custkey % 60 < 25 OR (o_custkey + 31) % 60 < 25) AS is_exhibition FROM orders""")
def s10(spark, folder):
    team = "named_struct('score', {s}, 'team', named_struct('id', {i}, 'name', concat('Team ', {i})))"
    doc = ("to_json(named_struct('dates', array(named_struct('date', date_format(o_orderdate, 'yyyy-MM-dd'), 'games', array(named_struct('gamePk', o_orderkey, 'status', named_struct("
           "'abstractGameState', CASE o_orderstatus WHEN 'P' THEN 'Live' ELSE 'Other' END, 'detailedState', CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Scheduled' ELSE 'In Progress' END), "
           f"'teams', named_struct('away', {team.format(s='o_orderkey % 11', i='o_custkey % 60')}, 'home', {team.format(s='o_orderkey % 7', i='(o_custkey + 31) % 60')})))))))")
    docs = table(spark, folder, "orders").selectExpr(f"{doc} AS doc")
    clubs = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("club_id"))
    g = game_json.schedule_games(game_json.parse(docs, "doc", game_json.SCHEDULE_SCHEMA, []), [], clubs)
    return g.select("game_pk", "date", "status", "is_live", "away_id", "home_id", "away_score", "is_exhibition")


@query("s11_rosters", """
SELECT concat('T', c_nationkey) AS team, c_custkey AS player_id, c_name AS name FROM customer WHERE c_custkey % 3 = 0""")
def s11(spark, folder):
    doc = ("to_json(named_struct('roster', array(named_struct('person', named_struct('id', c_custkey, 'fullName', c_name), 'position', named_struct('type', CASE c_custkey % 3 WHEN 0 THEN 'Pitcher' ELSE 'Infielder' END)), "
           "named_struct('person', named_struct('id', -c_custkey - 1, 'fullName', 'x'), 'position', named_struct('type', 'Outfielder')))))")
    docs = table(spark, folder, "customer").selectExpr("concat('T', c_nationkey) AS team", f"{doc} AS doc")
    r = game_json.roster_players(game_json.parse(docs, "doc", game_json.ROSTER_SCHEMA, ["team"]), ["team"], pitchers=True)
    return r.select("team", "player_id", "name")


@query("s12_stat_leader_pages", """
WITH r AS (SELECT l_returnflag AS grp, l_orderkey AS page, l_suppkey AS player_id, l_linestatus AS team, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linestatus) AS rn FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_suppkey, l_linestatus FROM lineitem))
SELECT grp AS "group", player_id, team FROM r WHERE rn = 1""")
def s12(spark, folder):
    # a page holds the lines of an order; the split list of a page is ordered by team
    li = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_suppkey", "l_linestatus").distinct()
    doc = ("to_json(named_struct('stats', array(named_struct('splits', array(named_struct('player', named_struct('id', l_suppkey, 'fullName', 'p'), 'team', named_struct('abbreviation', l_linestatus)))))))")
    docs = li.selectExpr("l_returnflag AS `group`", "l_orderkey * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS page", f"{doc} AS doc")
    return game_json.leader_players(game_json.parse(docs, "doc", game_json.LEADERS_SCHEMA, ["group", "page"]), "group", "page").select("group", "player_id", "team")


@query("s13_grade_map_rows", f"""
SELECT pitcher, pitch_type, count(xrv) AS n, {half_even_sql('avg(xrv) * 100', 3)} AS "xRV" FROM @pitches GROUP BY ALL""")
def s13(spark, folder):
    g = rates.grade_means(table(spark, folder, "pitches"), ["pitcher", "pitch_type"], ["xrv", "stuff"]).withColumnRenamed("xrv", "xRV")
    docs = sinks.grade_documents(g, "pitcher", "pitch_type", ["n", "xRV", "stuff"])
    text = docs.select(F.to_json(F.map_from_arrays(F.array(F.col("pitcher").cast("string")), F.array("grades"))).alias("doc"))
    return game_json.grade_rows(text, "doc").select("pitcher", "pitch_type", "n", "xRV")


@query("s14_season_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def s14(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("year"))
    return tables.season_rows(o, "year", 1997).drop("year")


@query("s15_numeric_table", """
SELECT p_name, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price FROM part""")
def s15(spark, folder):
    p = table(spark, folder, "part").select(
        "p_name", F.col("p_size").cast("string").alias("size"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("--").alias("price"))
    return tables.numeric_table(p, ["p_name"])


@query("s16_stepped_ranges", """
WITH s AS (SELECT season, min(game_date) AS a, max(game_date) AS b FROM @pitches GROUP BY season),
 c AS (SELECT s.season, CAST(floor((game_date - a) / 14) + 1 AS INT) AS chunk, count(*) AS n FROM @pitches JOIN s USING (season) GROUP BY ALL)
SELECT c.season, chunk, a + (chunk - 1) * 14 AS start, least(a + (chunk - 1) * 14 + 13, b) AS "end", n FROM c JOIN s USING (season)""")
def s16(spark, folder):
    p = table(spark, folder, "pitches").select("season", "game_date")
    spans = p.groupBy("season").agg(F.min("game_date").alias("start"), F.max("game_date").alias("end"))
    plan = tables.stepped_ranges(spans, 14)
    first = spans.select("season", F.col("start").alias("__first"))
    counts = lookup(p, first, ["season"]).groupBy("season", tables.chunk_of("game_date", "__first").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return plan.join(counts, ["season", "chunk"]).select("season", "chunk", "start", "end", "n")


@query("s16_fixed_ranges", """
WITH r(chunk, a, b) AS (VALUES (1,'03-20','04-15'),(2,'04-16','04-30'),(3,'05-01','05-15'),(4,'05-16','05-31'),(5,'06-01','06-15'),(6,'06-16','06-30'),(7,'07-01','07-15'),(8,'07-16','07-31'),(9,'08-01','08-15'),(10,'08-16','08-31'),(11,'09-01','09-15'),(12,'09-16','10-02'))
SELECT season, CAST(chunk AS INT) AS chunk, count(*) AS n FROM @pitches JOIN r ON strftime(game_date, '%m-%d') BETWEEN a AND b GROUP BY ALL""")
def s16_fixed(spark, folder):
    p = table(spark, folder, "pitches").select("season", "game_date")
    seasons = sorted(r["season"] for r in p.select("season").distinct().na.drop().collect())  # a row per season
    plan = tables.fixed_ranges(spark, seasons, "R").select(
        "season", "chunk", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("game_date"))
    return p.join(plan, ["season", "game_date"]).groupBy("season", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query("s16_spring_ranges", """
WITH r(chunk, a, b) AS (VALUES (1,'02-20','03-10'),(2,'03-11','03-28')), y AS (SELECT DISTINCT season FROM @pitches WHERE season IS NOT NULL),
 c AS (SELECT season, CAST(chunk AS INT) AS chunk, CAST(concat(season, '-', a) AS DATE) AS start, CAST(concat(season, '-', b) AS DATE) AS "end" FROM y, r)
SELECT c.*, (SELECT count(*) FROM @pitches p WHERE p.game_date BETWEEN c.start AND c."end") AS n FROM c""")
def s16_spring(spark, folder):
    """The two ranges of spring for every season, with the pitches of each; ranges without any have none."""
    p = table(spark, folder, "pitches").select("season", "game_date")
    seasons = sorted(r["season"] for r in p.select("season").distinct().na.drop().collect())  # a row per season
    plan = tables.fixed_ranges(spark, seasons, "S")
    days = plan.select("season", "chunk", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("game_date"))
    counts = p.drop("season").join(days, "game_date").groupBy("season", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(counts, ["season", "chunk"], "left").na.fill(0, ["n"])
