"""Incremental metrics on a pitch or event stream.

Streams run with the available-now trigger here; a deployment passes its own trigger. State and output
live in the shared folder, so a lost executor costs a retry, not the result.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.dates import half_month_start
from statloom.session import fresh_path
from statloom.streaming.sessionize import PIECES, SessionProcessor, pieces, session_schema
from statloom.streaming.upserts import Upserts


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet table of a name in a folder, one file or a folder of files, as a stream with its schema.

    Times without a zone are read as session time, since event time needs one.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    local = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    # a pattern of one name: as a plain path a file is refused
    return reader.parquet(f"{folder}/{{{name}}}").withColumns({c: F.col(c).cast("timestamp") for c in local})


def _run(writer, checkpoint: str) -> list:
    """Runs a stream to the end of its data; the progress of its batches."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query.recentProgress


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream into a Parquet table and reads it back."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    _run(stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data"), f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_with_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None], mode: str = "update",
                     path: str | None = None, progress: list | None = None) -> None:
    """Runs a stream whose batches a function handles by batch id; it may be called again with a batch after a failure."""
    path = path or fresh_path(stream.sparkSession, name)

    def once(df: DataFrame, batch: int) -> None:
        # the handler reads a batch several times; its state must be asked once
        df.persist()
        try:
            handle(df, batch)
        finally:
            df.unpersist()

    done = _run(stream.writeStream.outputMode(mode).foreachBatch(once), f"{path}/state")
    if progress is not None:
        progress.extend(done)


def upserted(stream: DataFrame, name: str, keys: list[str], newest: list[str] | None = None, mode: str = "update", progress: list | None = None) -> DataFrame:
    """Runs a stream of rows per key into a table of one row per key."""
    path = fresh_path(stream.sparkSession, name)
    table = Upserts(stream.sparkSession, f"{path}/table", keys, stream.schema)
    run_with_batches(stream, name, lambda df, batch: table.merge(df, batch, newest), mode, path, progress)
    return table.read()


def running_totals(stream: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """ST1: totals kept by the state store, current value per key in a table that each batch rewrites in part."""
    return upserted(stream.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]), "totals", keys)


def without_duplicates(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """ST2: first row per natural key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def period_sums(stream: DataFrame, time: str, keys: list[str], delay: str, days: int = 14, **aggregates: Column) -> DataFrame:
    """ST3: tumbling windows of some days."""
    agg = stream.withWatermark(time, delay).groupBy(F.window(time, f"{days} days").alias("period"), *keys).agg(
        *[a.alias(n) for n, a in aggregates.items()]
    )
    flat = agg.select(F.col("period.start").alias("period_start"), *keys, *aggregates)
    return upserted(flat, "periods", ["period_start", *keys])


def _daily(stream: DataFrame, time: str, keys: list[str], delay: str, aggregates: dict[str, Column]) -> DataFrame:
    """Rows per day and key; the state of a day goes when the watermark has passed it."""
    agg = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("__w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return agg.select(*keys, F.col("__w.start").cast("date").alias("day"), *aggregates)


def _roll_up(stream: DataFrame, name: str, keys: list[str], out_keys: list[str], roll: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType,
             progress: list | None) -> DataFrame:
    """Keeps a table of days and, inside each batch, renews what rolls up from the days that the batch changed.

    roll(days of the table, changed days) gives the rows to renew.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    days = Upserts(spark, f"{path}/days", [*keys, "day"], stream.schema, by=keys)
    rolled = Upserts(spark, f"{path}/rolled", out_keys, schema)

    def handle(df: DataFrame, batch: int) -> None:
        days.merge(df, batch)
        rolled.merge(roll(days.read(of=df), df), batch)

    run_with_batches(stream, name, handle, path=path, progress=progress)
    return rolled.read()


def half_month_sums(stream: DataFrame, time: str, keys: list[str], delay: str = "1 day", progress: list | None = None, **aggregates: Column) -> DataFrame:
    """ST3: calendar half months, rolled up from days; aggregates are counts and sums, for days add up."""
    daily = _daily(stream, time, keys, delay, aggregates)
    half = half_month_start(F.col("day"))

    def roll(table: DataFrame, changed: DataFrame) -> DataFrame:
        touched = changed.select(*keys, half.alias("half_month")).distinct()
        rows = table.withColumn("half_month", half)
        return rows.join(touched, [*keys, "half_month"], "left_semi").groupBy("half_month", *keys).agg(*[F.sum(n).alias(n) for n in aggregates])

    types = {f.name: f.dataType for f in daily.schema.fields}
    schema = T.StructType([T.StructField("half_month", T.DateType()), *[T.StructField(c, types[c]) for c in [*keys, *aggregates]]])
    return _roll_up(daily, "half-months", keys, ["half_month", *keys], roll, schema, progress)


def daily_then_rolling(stream: DataFrame, time: str, key: str, value: str, days: int = 60, delay: str = "1 day", progress: list | None = None) -> DataFrame:
    """ST4: the stream keeps sums of the days that are not past the watermark; the trailing means of the days that a batch can change are
    rolled up in that batch from the table of days."""
    from pyspark.sql import Window

    daily = _daily(stream, time, [key], delay, {"n": F.count(value), "s": F.sum(value)})

    def roll(table: DataFrame, changed: DataFrame) -> DataFrame:
        span = changed.groupBy(key).agg(F.min("day").alias("__from"), F.max("day").alias("__to"))
        rows = table.join(span, key).filter((F.col("day") >= F.date_sub("__from", days)) & (F.col("day") <= F.date_add("__to", days)))
        w = Window.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(-days, 0)  # a key has one row a day
        out = rows.withColumns({"__n": F.sum("n").over(w), "__s": F.sum("s").over(w)}).filter(F.col("day") >= F.col("__from"))
        return out.select(key, "day", F.col("__n").alias("n"), (F.col("__s") / F.col("__n")).alias("mean"))

    schema = T.StructType([daily.schema[key], T.StructField("day", T.DateType()), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType())])
    return _roll_up(daily, "rolling", [key], [key, "day"], roll, schema, progress)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, delay: str, **aggregates: Column) -> DataFrame:
    """ST5: sessions per key that end after a gap; a session is written once the watermark has passed it.

    Sessions are merged before the shuffle as well, so a busy key sends sessions, not events.
    """
    agg = stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("session")).agg(
        *[a.alias(n) for n, a in aggregates.items()]
    )
    flat = agg.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), *aggregates)
    with _setting(stream.sparkSession, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        return run_to_table(flat, "sessions")


def live_sessions(stream: DataFrame, time: str, keys: list[str], gap: timedelta, delay: str, sums: dict[str, Column] | None = None,
                  progress: list | None = None) -> DataFrame:
    """ST5: all sessions per key, those that may still grow marked open: keys, start, end, n, sums, open.

    A session is in the table from its first event on; a timer at its end closes it once the watermark is there and drops its state. Events are merged
    into pieces of sessions before the shuffle, so a busy key sends pieces; an event that joins two open sessions makes them one.
    """
    spark, sums = stream.sparkSession, sums or {}
    flat = stream.select(*keys, F.unix_micros(time).alias("__at"), *[c.cast("double").alias(n) for n, c in sums.items()]).filter("__at IS NOT NULL")
    key_fields = [flat.schema[k] for k in keys]
    us = gap // timedelta(microseconds=1)
    piece_schema = T.StructType([*key_fields, *PIECES, *[T.StructField(n, T.DoubleType()) for n in sums]])
    merged = flat.mapInArrow(pieces(keys, us, list(sums)), piece_schema).withColumn("seen", F.timestamp_micros("last")).withWatermark("seen", delay)
    out_schema = session_schema(key_fields, list(sums))
    rows = merged.groupBy(*keys).transformWithStateInPandas(SessionProcessor([(f.name, f.dataType.simpleString()) for f in key_fields], us, list(sums)),
                                                            out_schema, "Update", "EventTime")
    path = fresh_path(spark, "sessions")
    table = Upserts(spark, f"{path}/table", [*keys, "start"], out_schema, gone="gone")
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        run_with_batches(rows, "sessions", lambda df, batch: table.merge(df, batch), path=path, progress=progress)
    out = table.read()
    return out.select(*keys, F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("last") + us).alias("end"), "n", *sums, "open")


def latest_attribute(stream: DataFrame, time: str, key: str, attribute: str, tie: str, delay: str = "1 day", progress: list | None = None) -> DataFrame:
    """ST6: newest value of an attribute per key, ties broken by a unique column.

    The state holds the newest value of each day that the watermark has not passed, the table the newest of all; later rows of days that are past are dropped.
    """
    newest = F.max(F.struct(F.col(time).alias("updated"), F.col(tie).alias("tie"), F.col(attribute).alias("latest"))).alias("__m")
    agg = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("__w"), key).agg(newest).select(key, "__m.*")
    return upserted(agg, "latest", [key], ["updated", "tie"], progress=progress).select(key, "latest", "updated")


def live_appearances(stream: DataFrame, keys: list[str], order: str, strikes_after: str) -> DataFrame:
    """ST7: running state per plate appearance: pitches so far, pitches before two strikes, latest count.

    Pitch numbers count from 1 within the appearance, so the state is a few numbers, not the list of pitches.
    """
    out = running_totals(
        stream, keys,
        pitches=F.count(F.lit(1)),
        first_two_strike_pitch=F.min(F.when(F.col(strikes_after) >= 2, F.col(order))),
        strikes=F.max_by(strikes_after, F.when(F.col(strikes_after).isNotNull(), F.col(order))),
    )
    return out.withColumn("pitches_to_two_strikes", F.col("first_two_strike_pitch"))


def ranked_board(totals: DataFrame, value: str, pool: list[str]) -> DataFrame:
    """Percentiles over current totals: row-order windows are not allowed on the stream itself."""
    from statloom.operators.ranks import add_strict_percentile

    return add_strict_percentile(totals, value, pool)
