"""Delimited and Parquet tables: quality gate, encodings, season files, date ranges."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions import as_col
from statloom.functions.dates import REGULAR_RANGES, SPRING_RANGES
from statloom.operators.reshape import clean_headers, numeric_columns, require_columns

# The nine situational tables and two context tables of a season, and their file suffixes.
SEASON_FILE_TYPES = {
    "5v5_indiv": "5v5individualrates", "5v5_onice": "5v5onicerates", "5v5_counts": "5v5onicecounts",
    "5v5_rel": "5v5relativerates", "all_str": "allsituationsrates", "pp_indiv": "ppindividualrates",
    "pp_onice": "pponicerates", "pk_indiv": "pkindividualrates", "pk_onice": "pkonicerates",
    "qoc": "qoc", "qot": "qot",
}


def payload_kind(text) -> Column:
    """blank, html or csv, from the whole of a downloaded text."""
    whole = F.lower(F.coalesce(as_col(text), F.lit("")))
    body = F.regexp_replace(whole, "^[\\s\\ufeff]+", "")
    return (
        F.when(body == "", "blank")
        .when(body.startswith("<!") | body.startswith("<html") | whole.contains("<table"), "html")
        .otherwise("csv")
    )


def split_payloads(payloads: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(usable, set aside) by payload kind."""
    kind = payload_kind(text)
    return payloads.filter(kind == "csv"), payloads.filter(kind != "csv")


def file_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text, for the gate."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", F.lit("UTF-8")).alias("text"))


def leaderboard_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and a declared schema; rows without any value are dropped."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE").na.drop("all")


def text_columns(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV with every column as text, headers cleaned."""
    return clean_headers(spark.read.csv(path, header=True, inferSchema=False, encoding=encoding))


def csv_any_encoding(spark: SparkSession, paths: list[str]) -> DataFrame:
    """UTF-8 tables as such, others as Latin-1: a file with bytes that are no UTF-8 counts as Latin-1.

    One scan of all files gives a row per file, its first line and whether its bytes are UTF-8; then files of one encoding and one header are read
    together. So the number of scans goes with the kinds of files, not with the files. Columns that a file lacks are null.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("at"))
    found = lines.groupBy("path").agg(F.bool_or(~F.is_valid_utf8("value")).alias("bad"), F.min_by(F.col("value").cast("binary"), F.struct("start", "at")).alias("head"))
    kinds: dict[tuple, list[str]] = {}
    for r in found.orderBy("path").collect():  # a row per file, as many as the driver lists anyway
        kinds.setdefault((r["bad"], bytes(r["head"])), []).append(unquote(r["path"]))
    frames = [text_columns(spark, group, "ISO-8859-1" if bad else "UTF-8") for (bad, _), group in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def strict_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Quoted CSV in which rows with another number of fields than the header are dropped.

    Column pruning is off for this scan: with it, a short row would pass when its missing columns are not read.
    """
    return (
        spark.read.schema(schema).option("columnPruning", "false")
        .csv(path, header=True, quote='"', mode="DROPMALFORMED", enforceSchema=False)
    )


def parquet_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Parquet scan that fails at once when a required column is missing."""
    return require_columns(spark.read.parquet(path), required)


def season_files(spark: SparkSession, folder: str, years: list[int], suffix: str, schema: str) -> DataFrame | None:
    """`{year}{suffix}.csv` of the given years with a year column; absent files are skipped, none gives None."""
    if not years:
        return None
    try:  # one glob for all years
        found = spark.read.schema(schema).csv(f"{folder}/{{{','.join(map(str, years))}}}{suffix}.csv", header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    year = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4})[^/]*\.csv(?:/|$)", 1).cast("int")
    return found.select("*", year.alias("year"))


def season_tables(spark: SparkSession, folder: str, years: list[int], schemas: dict[str, str]) -> dict[str, DataFrame | None]:
    return {k: season_files(spark, folder, years, SEASON_FILE_TYPES[k], s) for k, s in schemas.items()}


def season_rows(df: DataFrame, column: str, season: int) -> DataFrame:
    """Rows of one season; the season may be stored as text."""
    return df.filter(F.col(column).cast("string").try_cast("int") == season)


def numeric_table(df: DataFrame, text: list[str]) -> DataFrame:
    """Every column but the named text ones as numbers."""
    return numeric_columns(df, keep=text)


def fixed_ranges(spark: SparkSession, seasons: list[int], kind: str = "R") -> DataFrame:
    """Half-month pull ranges of regular seasons (R) or the two ranges of spring (S)."""
    ranges = REGULAR_RANGES if kind == "R" else SPRING_RANGES
    rows = [(y, i + 1, f"{y}-{a}", f"{y}-{b}") for y in seasons for i, (a, b) in enumerate(ranges)]
    out = spark.createDataFrame(rows, "season int, chunk int, start_text string, end_text string")
    return out.select("season", "chunk", F.to_date("start_text").alias("start"), F.to_date("end_text").alias("end"))


def stepped_ranges(spans: DataFrame, days: int = 14, today: Column | None = None) -> DataFrame:
    """(keys, chunk, start, end) in steps of `days` from start to end, never beyond yesterday."""
    stop = F.least(F.col("end"), F.date_sub(today if today is not None else F.current_date(), 1))
    keys = [c for c in spans.columns if c not in ("start", "end")]
    steps = F.when(F.col("start") <= stop, F.sequence(F.col("start"), stop, F.expr(f"interval {days} days")))
    cut = spans.select(*keys, stop.alias("__stop"), F.posexplode(steps).alias("chunk", "start"))
    return cut.select(*keys, (F.col("chunk") + 1).alias("chunk"), "start",
                      F.least(F.date_add("start", days - 1), "__stop").alias("end"))


def chunk_of(date, start, days: int = 14) -> Column:
    """Number of the step a date falls in, so that rows meet their range by equality."""
    return (F.floor(F.date_diff(as_col(date), as_col(start)) / days) + 1).cast("int")
