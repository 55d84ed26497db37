"""A table of one row per key that batches of a stream rewrite in part."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Upserts:
    """One row per key under a path in the shared folder.

    Keys are dealt to buckets by their hash. A batch rewrites the buckets it touches and no others: old rows of the bucket and new ones, into the one of
    two slots that the bucket does not use, then one small commit names the slot of every bucket. So a reader sees a batch as a whole or not at all, a
    batch that failed half-way is written again, one that was committed changes nothing when it comes again, and at most two versions of a bucket
    exist. gone: name of a boolean column of rows that take their key out of the table. by: the key columns that name the bucket (all, if not given).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, buckets: int | None = None, gone: str | None = None,
                 by: list[str] | None = None):
        self.spark, self.path, self.keys, self.schema, self.gone, self.by = spark, path, keys, schema, gone, by or keys
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = [c for c in map(self._commit, (0, 1)) if c]
        last = max(found, key=lambda c: c["batch"], default={"batch": -1, "slots": {}, "buckets": self.buckets})
        self.batch, self.slots, self.buckets = last["batch"], {int(b): s for b, s in last["slots"].items()}, last["buckets"]

    def _commit(self, slot: int) -> dict | None:
        try:
            row = self.spark.read.text(f"{self.path}/commit/{slot}").first()
        except AnalysisException:  # no commit yet
            return None
        return json.loads(row["value"]) if row else None

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _rows(self, wanted) -> DataFrame:
        paths = [f"{self.path}/rows/__slot={s}/__bucket={b}" for b, s in sorted(self.slots.items()) if b in wanted]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.filter(~F.col(self.gone)) if self.gone else rows

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The table; of: only the buckets that hold keys of these rows."""
        return self._rows(self.slots if of is None else self._touched(of))

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # a number per bucket

    def merge(self, rows: DataFrame, batch: int, newest: list[str] | None = None) -> bool:
        """Puts rows in place of those with their keys; newest: columns by which the greater row stays. False for a batch that is in already."""
        if batch <= self.batch:
            return False
        touched = self._touched(rows)
        if touched:
            new, old = rows.select(*self.schema.names), self._rows(touched)
            if newest:
                order = F.struct(*newest)
                both = old.unionByName(new).groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), order).alias("__row"))
                merged = both.select("__row.*")
            else:
                merged = old.join(new.select(*self.keys), [old[k].eqNullSafe(new[k]) for k in self.keys], "left_anti").unionByName(new)
            to = {b: 1 - self.slots.get(b, 1) for b in touched}
            slot = F.element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), F.col("__bucket"))
            out = merged.withColumn("__bucket", self._bucket()).withColumn("__slot", slot).repartition("__bucket")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__slot", "__bucket").parquet(f"{self.path}/rows")
            self.slots |= to
        self.batch = batch
        said = json.dumps({"batch": batch, "slots": self.slots, "buckets": self.buckets})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/commit/{batch % 2}")
        return True
