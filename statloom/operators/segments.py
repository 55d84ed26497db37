"""Ordered work inside a key without bringing the whole key into one task.

Rows are dealt by ranges of (key, order) and written once with the number of their range, their part. Window functions then run per
(key, part), and what earlier parts of the key contribute is added from a table with one row per key and part, of the keys that are in several.
Ranges are about equal in rows whatever the keys, so a key with a third of all rows is in a third of the parts; how the cuts fall does not
show in the results. The plan is the same for every size and every skew; only rows that are equal in the key and all order columns stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.keys import lookup
from statloom.session import cut

PART = "__part"


def deal(df: DataFrame, keys: list[str], order: list[str], name: str = "parts") -> DataFrame:
    """Rows with their part, written in ranges of keys and order."""
    return cut(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), name)


def add_earlier_parts(out: DataFrame, dealt: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Adds each aggregate summed over the earlier parts of the key (name) and over the whole key (name + '_all'); null where a key is in one part."""
    per = dealt.groupBy(*keys, PART).agg(*[a.alias(n) for n, a in sums.items()])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    table = per.select(
        *keys, PART, F.count(F.lit(1)).over(whole).alias("__parts"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums],
    )
    # ranges are contiguous, so a part shares at most its first and its last key with others: the table is small
    return lookup(out, cut(table.filter("__parts > 1").drop("__parts"), "earlier-parts"), [*keys, PART])


def row_index(df: DataFrame, keys: list[str], order: list[str], index: str = "idx", size: str | None = None) -> DataFrame:
    """0-based position of each row in its key, and the key's row count if size is named.

    order is a list of columns that together order the rows fully.
    """
    dealt = deal(df, keys, order)
    part = Window.partitionBy(*keys, PART)
    out = dealt.withColumn("__sx_i", F.row_number().over(part.orderBy(*order)) - 1)
    if size:
        out = out.withColumn("__sx_n", F.count(F.lit(1)).over(part))
    out = add_earlier_parts(out, dealt, keys, __sx_before=F.count(F.lit(1)))
    out = out.withColumn(index, (F.col("__sx_i") + F.coalesce("__sx_before", F.lit(0))).cast("long"))
    if size:
        out = out.withColumn(size, F.coalesce("__sx_before_all", "__sx_n"))
    return out.drop(PART, "__sx_i", "__sx_n", "__sx_before", "__sx_before_all")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """For each (new name: column) the last non-null value on earlier rows of the key."""
    dealt = deal(df, keys, order)
    prev = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"__sx_{n}": F.last(c, ignorenulls=True).over(prev) for n, c in columns.items()})
    last_in = dealt.groupBy(*keys, PART).agg(*[
        F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__sxc_{n}") for n, c in columns.items()
    ])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in.select(*keys, PART, F.count(F.lit(1)).over(whole).alias("__parts"),
                           *[F.last(f"__sxc_{n}", ignorenulls=True).over(before).alias(f"__sxc_{n}") for n in columns])
    out = lookup(out, cut(carry.filter("__parts > 1").drop("__parts"), "carried"), [*keys, PART])
    out = out.withColumns({n: F.coalesce(f"__sx_{n}", f"__sxc_{n}") for n in columns})
    return out.drop(PART, *[f"__sx_{n}" for n in columns], *[f"__sxc_{n}" for n in columns])
