"""Helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the contracts: runs of ASCII digits, lower-case letters and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


def fold(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % parts


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple | Iterable[tuple]]], schema: str, many: bool = False,
             chunk: int = 2000) -> DataFrame:
    """Runs a Python function over rows in Arrow batches.

    make() is called once per task and gives the function, which takes a row's values and returns a row (many: rows).
    Output is emitted every `chunk` rows, so a batch of long results stays bounded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            done: list[tuple] = []
            for start in range(0, batch.num_rows, 256):  # a few rows at a time as Python values
                part = batch.slice(start, 256)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    done.extend(f(*row)) if many else done.append(f(*row))
                    if len(done) >= chunk:
                        yield arrow_rows(done, out)
                        done = []
            if done:
                yield arrow_rows(done, out)

    return df.mapInArrow(run, schema)


def count_in_tasks(df: DataFrame, make: Callable[[], Callable[..., None]], schema: str, limit: int = 200_000) -> DataFrame:
    """Sums counts inside tasks before a shuffle: make() gives (feed, table); rows are fed, the table is emitted when it has
    `limit` keys and at the end. Keys are tuples, values numbers; the caller sums the emitted rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed, drain, size = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    feed(*row)
                    if size() >= limit:
                        yield from chunks(drain(), out)
        yield from chunks(drain(), out)

    return df.mapInArrow(run, schema)


def chunks(rows: Iterable[tuple], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield arrow_rows(held, schema)
            held = []
    if held:
        yield arrow_rows(held, schema)
