"""Streams in many batches: tables of one row per key, bounded state, open sessions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from statloom.streaming import live
from statloom.streaming.sessionize import merge
from statloom.streaming.upserts import Upserts

EVENTS = "ts timestamp, user long, kind string, value double"
START = datetime(2024, 1, 30)


def files(spark, folder, batches):
    """One file per batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder / f"part{i:03d}"))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.fixture
def days(spark, tmp_path):
    """Twelve days in twelve batches, some rows a few hours late."""
    batches = [[(START + timedelta(days=d, hours=h, minutes=7 * u), u, f"k{(d + h) % 3}", float(d + h + u)) for h in range(0, 24, 5) for u in range(4)] for d in range(12)]
    for d in range(1, 12):
        batches[d].append((START + timedelta(days=d, hours=-2), 9, "late", 1.5))
    return files(spark, tmp_path, batches), [r for b in batches for r in b]


def test_table_keeps_one_row_per_key(spark, tmp_path):
    table = Upserts(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], "k long, v long").schema, buckets=3)
    want = {}
    for batch in range(50):
        rows = [(None if batch % 10 == 9 else batch % 7, batch), (batch % 5 + 10, -batch)]
        want |= dict(rows)
        assert table.merge(spark.createDataFrame(rows, "k long, v long"), batch)
    assert {r["k"]: r["v"] for r in table.read().collect()} == want and table.read().count() == len(want)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "t/rows")).count()
    assert stored <= 2 * len(want)  # two versions of a bucket at most
    again = Upserts(spark, str(tmp_path / "t"), ["k"], table.schema)
    assert not again.merge(spark.createDataFrame([(1, 999)], "k long, v long"), 49)
    assert {r["k"]: r["v"] for r in again.read().collect()} == want


def test_table_after_a_batch_that_was_not_committed(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    table = Upserts(spark, str(tmp_path / "t"), ["k"], schema, buckets=2)
    table.merge(spark.createDataFrame([(1, 1), (2, 2)], schema), 0)
    lost = Upserts(spark, str(tmp_path / "t"), ["k"], schema)
    slots = dict(lost.slots)
    out = spark.createDataFrame([(1, 7, 1 - slots[b], b) for b in slots], "k long, v long, __slot int, __bucket int")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__slot", "__bucket").parquet(str(tmp_path / "t/rows"))
    again = Upserts(spark, str(tmp_path / "t"), ["k"], schema)
    assert sorted(map(tuple, again.read().collect())) == [(1, 1), (2, 2)]
    again.merge(spark.createDataFrame([(1, 5)], schema), 1)
    assert sorted(map(tuple, again.read().collect())) == [(1, 5), (2, 2)]


def test_greater_row_stays(spark, tmp_path):
    table = Upserts(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], "k long, at long, v string").schema, buckets=2)
    for batch, at in enumerate([5, 3, 9, 1]):
        table.merge(spark.createDataFrame([(1, at, f"v{at}")], "k long, at long, v string"), batch, ["at"])
    assert [tuple(r) for r in table.read().collect()] == [(1, 9, "v9")]


def test_rolling_days_with_bounded_state(spark, days):
    stream, rows = days
    progress = []
    got = {(r["user"], r["day"]): (r["n"], r["mean"]) for r in live.daily_then_rolling(stream, "ts", "user", "value", 3, "6 hours", progress).collect()}
    for user, day in {(r[1], r[0].date()) for r in rows}:
        held = [r[3] for r in rows if r[1] == user and timedelta(0) <= day - r[0].date() <= timedelta(days=3)]
        assert got[user, day] == (len(held), pytest.approx(sum(held) / len(held)))
    assert len(got) == len({(r[1], r[0].date()) for r in rows})
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(state) >= 12 and max(state) <= 3 * 5 and state[-1] <= 2 * 5  # users times days within the watermark


def test_half_months_with_bounded_state(spark, days):
    stream, rows = days
    progress = []
    out = live.half_month_sums(stream, "ts", ["kind"], "6 hours", progress, n=F.count(F.lit(1)), total=F.sum("value"))
    want = {}
    for at, _, kind, value in rows:
        half = at.date().replace(day=1 if at.day <= 15 else 16)
        n, total = want.get((half, kind), (0, 0.0))
        want[half, kind] = (n + 1, total + value)
    assert {(r["half_month"], r["kind"]): (r["n"], r["total"]) for r in out.collect()} == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 3 * 4


def test_latest_attribute_over_batches(spark, days):
    stream, rows = days
    got = live.latest_attribute(stream, "ts", "user", "kind", "value", "6 hours").collect()
    for r in got:
        last = max((x for x in rows if x[1] == r["user"]), key=lambda x: (x[0], x[3]))
        assert (r["latest"], r["updated"]) == (last[2], last[0])
    assert len(got) == 5


def test_sessions_over_batches(spark, tmp_path):
    """Sessions that go on over batches, two that a late event joins, and a null key."""
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [(at(0), 1, "a", 1.0), (at(1), 1, "a", 2.0), (at(0), 2, "a", 1.0), (at(0), None, "a", 1.0)],
        [(at(2.5), 1, "a", 4.0), (at(4), 2, "a", 1.0)],
        [(at(2), 2, "a", 8.0), (at(5), 3, "a", 1.0)],
        [(at(20), 3, "a", 1.0), (at(20), None, "a", 3.0)],
        [(at(40), 1, "a", 1.0)],
    ]
    progress = []
    got = live.live_sessions(files(spark, tmp_path, batches), "ts", ["user"], timedelta(hours=2, minutes=30), "4 hours", {"total": F.col("value")}, progress)
    rows = sorted(((r["user"] or 0, r["start"], r["end"], r["n"], r["total"], r["open"]) for r in got.collect()))
    end = lambda h: at(h) + timedelta(hours=2, minutes=30)
    assert rows == [
        (0, at(0), end(0), 1, 1.0, False), (0, at(20), end(20), 1, 3.0, False),
        (1, at(0), end(2.5), 3, 7.0, False), (1, at(40), end(40), 1, 1.0, True),
        (2, at(0), end(4), 3, 10.0, False),
        (3, at(5), end(5), 1, 1.0, False), (3, at(20), end(20), 1, 1.0, False),
    ]
    assert progress[-1]["stateOperators"][0]["customMetrics"] is not None


def test_parts_merge_in_any_order():
    assert merge([(0, 3, 1), (6, 6, 1)], 3) == [(0, 3, 1), (6, 6, 1)]
    assert merge([(6, 6, 1), (0, 3, 1), (5, 5, 1)], 3) == [(0, 6, 3)]


def test_stream_of_a_table_in_one_file_and_in_a_folder(spark, tmp_path):
    rows = [(i, i * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, v long")
    df.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("many.parquet", "one.parquet"):
        got = live.run_to_table(live.stream_table(spark, str(tmp_path), name), "whole")
        assert sorted(map(tuple, got.collect())) == rows


def test_many_sessions_of_a_key_are_one_value(spark, tmp_path):
    batches = [[(START + timedelta(hours=5 * i), 1, "k", 1.0) for i in range(30)], [(START + timedelta(days=60), 2, "k", 1.0)]]
    progress = []
    got = live.live_sessions(files(spark, tmp_path, batches), "ts", ["user"], timedelta(hours=2), "1 hour", {"total": F.col("value")}, progress)
    assert got.groupBy("user", "open").count().sort("user").collect() == [(1, False, 30), (2, True, 1)]
    # a value and a timer (kept in both of its orders) of a key, not of a session
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 2 * 3
