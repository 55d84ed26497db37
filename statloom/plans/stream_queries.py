"""Streaming forms over the event table, run to the end of the data and compared with batch SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from statloom.functions.numeric import round_half_even
from statloom.operators.ranks import add_strict_percentile
from statloom.plans.bindings import FEED
from statloom.plans.registry import half_even_sql, query, r6, r6_sql, strict_sql
from statloom.streaming import live


def feed(spark, folder):
    """The pitch feed as a stream."""
    return live.stream_table(spark, folder, "events.parquet").selectExpr(*[f"{e} AS {c}" for c, e in FEED.items()])


def local_times(df):
    """Times without a zone again, as the tables have them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"})


@query("st1_running_leaderboard", f"""
WITH t AS (SELECT pitcher, count(*) AS n, {half_even_sql('sum(value)', 2)} AS total FROM @feed GROUP BY pitcher), m AS (SELECT *, {half_even_sql('total / n', 3)} AS mean, pitcher % 2 AS pool FROM t)
SELECT pitcher, n, total, mean, pool, {strict_sql('mean', 'pool')} AS pctile FROM m""")
def st1(spark, folder):
    t = live.running_totals(feed(spark, folder), ["pitcher"], n=F.count(F.lit(1)), total=F.sum("value"))
    t = t.withColumn("total", round_half_even("total", 2))
    t = t.withColumns({"mean": round_half_even(F.col("total") / F.col("n"), 3), "pool": F.col("pitcher") % 2})
    return live.ranked_board(t, "mean", ["pool"])


@query("st2_duplicates_suppressed", "SELECT event_id, user_id FROM events")
def st2(spark, folder):
    # every event arrives twice
    twice = live.stream_table(spark, folder, "events.parquet").select("ts", "event_id", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = live.without_duplicates(twice, "ts", ["event_id", "user_id"], "1 hour")
    return live.run_to_table(once.select("event_id", "user_id"), "st2")


@query("st3_fortnight_sums", f"""
SELECT CAST(time_bucket(INTERVAL 14 DAYS, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS period_start, event_type, count(*) AS n, {r6_sql('sum(value)', 2)} AS total FROM events GROUP BY ALL""")
def st3(spark, folder):
    e = live.stream_table(spark, folder, "events.parquet")
    out = live.period_sums(e, "ts", ["event_type"], "1 day", 14, n=F.count(F.lit(1)), total=F.sum("value"))
    return r6(local_times(out), "total", digits=2)


@query("st3_half_month_sums", f"""
SELECT CASE WHEN day(ts) <= 15 THEN CAST(date_trunc('month', ts) AS DATE) ELSE CAST(date_trunc('month', ts) AS DATE) + 15 END AS half_month, event_type, count(*) AS n, {r6_sql('sum(value)', 2)} AS total FROM events GROUP BY ALL""")
def st3_half(spark, folder):
    e = live.stream_table(spark, folder, "events.parquet")
    return r6(live.half_month_sums(e, "ts", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value")), "total", digits=2)


@query("st4_daily_then_60_days", f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(value) AS n, sum(value) AS s FROM events GROUP BY ALL)
SELECT user_id, day, CAST(sum(n) OVER w AS BIGINT) AS n, {r6_sql('sum(s) OVER w / sum(n) OVER w', 9)} AS mean FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW)""")
def st4(spark, folder):
    e = live.stream_table(spark, folder, "events.parquet")
    return r6(live.daily_then_rolling(e, "ts", "user_id", "value", 60), "mean", digits=9)


@query("st5_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
 r AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, sid)
SELECT user_id, start, "end", n FROM r WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st5(spark, folder):
    e = live.stream_table(spark, folder, "events.parquet")
    return local_times(live.sessions(e, "ts", ["user_id"], "6 hours", "1 hour", n=F.count(F.lit(1))))


@query("st5_open_and_closed_sessions", """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
 r AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n, round_even(sum(value) * 100, 0) / 100 + 0.0 AS total FROM s GROUP BY user_id, sid)
SELECT user_id, start, "end", n, total, "end" > (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) AS open FROM r""")
def st5_live(spark, folder):
    """Every session; the last ones are still open."""
    e = live.stream_table(spark, folder, "events.parquet")
    return r6(local_times(live.live_sessions(e, "ts", ["user_id"], timedelta(hours=6), "1 hour", {"total": F.col("value")})), "total", digits=2)


@query("st6_latest_attribute", """
SELECT user_id, arg_max(event_type, event_id) AS latest, max(ts) AS updated FROM events GROUP BY user_id""")
def st6(spark, folder):
    e = live.stream_table(spark, folder, "events.parquet")
    return local_times(live.latest_attribute(e, "ts", "user_id", "event_type", "event_id"))


@query("st7_live_appearances", """
SELECT conv_id, count(*) AS pitches, min(turn + 1) FILTER (WHERE length(text) % 3 >= 2) AS pitches_to_two_strikes, arg_max(CAST(length(text) % 3 AS INT), turn) AS strikes FROM conversations GROUP BY conv_id""")
def st7(spark, folder):
    c = live.stream_table(spark, folder, "conversations.parquet").select(
        "conv_id", (F.col("turn") + 1).alias("pitch_number"), (F.length("text") % 3).cast("int").alias("strikes_after"))
    out = live.live_appearances(c, ["conv_id"], "pitch_number", "strikes_after")
    return out.select("conv_id", "pitches", "pitches_to_two_strikes", "strikes")
