"""Writers. Documents are JSON lines, one player or group per line, so no document passes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.names import pitch_key
from statloom.functions.numeric import round_half_even

STAMP = "yyyy-MM-dd HH:mm:ss 'UTC'"


def stamped(df: DataFrame) -> DataFrame:
    """Adds the time of writing, UTC."""
    return df.withColumn("generated_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), STAMP))


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), fmt: str = "parquet", **options) -> str:
    w = df.write.mode("overwrite").options(**options).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path


def write_json(df: DataFrame, path: str, partition_by: list[str] = (), **options) -> str:
    return write_table(df, path, partition_by, "json", **options)


def write_csv(df: DataFrame, path: str, **options) -> str:
    return write_table(df, path, fmt="csv", header=True, **options)


def categories_map(label: str, *fields: str) -> Column:
    """{label: {fields}} of the metric rows in a group; as long as the metric list."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), F.struct(*fields)))))


def player_documents(entries: DataFrame, ids: list[str], label: str = "label",
                     fields: tuple = ("pctile", "value", "display")) -> DataFrame:
    """One document per player: its ids and a map of its metrics."""
    return entries.groupBy(*ids).agg(categories_map(label, *fields).alias("categories"))


def write_season_documents(documents: DataFrame, path: str, specs: DataFrame | None = None) -> str:
    """Player documents by season and role, the metric list and the time of writing beside them."""
    write_json(documents, f"{path}/players", ["season", "role"])
    if specs is not None:
        write_json(stamped(specs), f"{path}/metrics")
    return path


def write_leaderboard(board: DataFrame, path: str, role: str = "role") -> str:
    return write_json(board, path, ["season", role])


def bucket_documents(hist: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """One document per player with its buckets in order; a player has a fixed number of buckets."""
    b = F.sort_array(F.collect_list(F.struct("bucket", *fields)))
    return hist.groupBy(*ids).agg(b.alias("buckets"), F.sum("count").alias("total_bbe"))


def type_documents(rates: DataFrame, by: list[str], kind: str, fields: list[str]) -> DataFrame:
    """One document per season: {type: rates}."""
    return rates.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(kind), F.struct(*fields))))).alias("pitch_types"))


def rating_documents(rated: DataFrame, ids: list[Column | str], categories: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """One document per player with {category: {pctile, weight}}."""
    def part(cat, weight):
        w = F.col(weight) if isinstance(weight, str) else weight
        return F.struct(round_half_even(cat, 1).alias("pctile"), round_half_even(w, 4).alias("weight"))

    entries = []
    for name, (cat, weight) in categories.items():
        entries += [F.lit(name), part(cat, weight)]
    return rated.select(*ids, F.create_map(*entries).alias("categories"))


def write_game_grades(scored: DataFrame, path: str, spread: int = 16) -> str:
    """Compressed JSON lines in one folder per game, each with its pitch key and rounded grades.

    Rows are spread over `spread` tasks per game, so a huge game is no single task's work.
    """
    keyed = scored.select(
        "game_pk", pitch_key("game_pk", "at_bat_number", "pitch_number").alias("key"),
        *[round_half_even(c, 5).alias(n) for c, n in
          {"xrv_final": "xRV", "xrv_stuff": "stuff", "xrv_location": "loc", "xrv_tunnel": "tun"}.items()],
    )
    salted = keyed.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(spread)))
    return write_json(salted.repartition("game_pk", "__salt").drop("__salt"), path, ["game_pk"], compression="gzip")


def grade_documents(grades: DataFrame, player: str, kind: str, fields: list[str]) -> DataFrame:
    """One line per player: {type: {fields}}; as long as there are types."""
    return grades.groupBy(player).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(kind), F.struct(*fields))))).alias("grades")
    )


def compact_grades(grades: DataFrame, player: str, kind: str, grade: str) -> DataFrame:
    """One line per player: {type: grade}."""
    return grades.groupBy(player).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, grade)))).alias("grades")
    )


def write_upsert(merged: DataFrame, path: str) -> str:
    """Result of an upsert to a new path; the old one is left alone until readers have moved."""
    return write_table(merged, path)
