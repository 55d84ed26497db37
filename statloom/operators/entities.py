"""Deduplication, consolidation, unions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.names import name_key
from statloom.operators.components import connected_components
from statloom.operators.keys import lookup, pick_first
from statloom.session import cut


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; order plus all other columns make the choice reproducible."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return pick_first(df, keys, [F.col(c).asc_nulls_last() for c in [*order, *rest]])


def entity_keys(df: DataFrame, id_col: str, name_col: str, ordinal: str, by_name: bool = True) -> DataFrame:
    """Adds `entity`: the id; without one the id first seen under the same normalized name; else the name.

    by_name also joins rows of different ids under one name (the id seen first), as older tables need.
    """
    keyed = df.withColumn("__k", F.nullif(name_key(name_col), F.lit("")))
    first_id = (
        keyed.filter(F.col(id_col).isNotNull() & F.col("__k").isNotNull())
        .groupBy("__k")
        .agg(F.min_by(F.col(id_col), F.struct(ordinal, id_col)).alias("__id"))
    )
    out = lookup(keyed, first_id, ["__k"])
    ident = F.coalesce("__id", id_col) if by_name else F.coalesce(id_col, "__id")
    own = F.concat(F.lit("row:"), F.col(ordinal).cast("string"))
    entity = F.coalesce(F.concat(F.lit("id:"), ident.cast("string")), F.concat(F.lit("name:"), F.col("__k")), own)
    return out.withColumn("entity", entity).drop("__k", "__id")


def entity_chains(df: DataFrame, id_col: str, name_col: str, ordinal: str) -> DataFrame:
    """Adds `entity`: rows of one id or of one normalized name are one entity, and so on along chains of both.

    An entity is named after the smallest of its ids as text, without any after the smallest name; a row with neither is one of its own. Ids and names are
    counted as pairs first, so an id or a name with very many rows is one link.
    """
    given = F.col(id_col).cast("string")
    keyed = df.withColumns({"__i": F.when(given.isNotNull(), F.concat(F.lit("id:"), given)), "__k": F.nullif(name_key(name_col), F.lit(""))})
    keyed = keyed.withColumn("__k", F.when(F.col("__k").isNotNull(), F.concat(F.lit("name:"), F.col("__k"))))
    pairs = keyed.select("__i", "__k").distinct()
    of = cut(connected_components(pairs, "__i", "__k").select(F.col("node").alias("__node"), "label"), "entities")
    node = F.coalesce("__i", "__k")
    out = lookup(keyed.withColumn("__node", node), of, ["__node"])
    own = F.concat(F.lit("row:"), F.col(ordinal).cast("string"))
    return out.withColumn("entity", F.coalesce("label", "__node", own)).drop("__i", "__k", "__node", "label")


def consolidate(df: DataFrame, id_col: str, name_col: str, ordinal: str, by_name: bool = False, chains: bool = False) -> DataFrame:
    """One row per entity: per column the first value that is not null in row order.

    The name is the last one in row order that carries accents or capitals or is longer than the first. chains: an id with several names and a
    name with several ids make one entity of all of them; by_name: as published, a name goes to the id seen first under it.
    """
    keyed = entity_chains(df, id_col, name_col, ordinal) if chains else entity_keys(df, id_col, name_col, ordinal, by_name)
    columns = [c for c in df.columns if c not in (name_col, ordinal)]
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in columns
    ]
    base_name = F.min_by(name_col, F.when(F.col(name_col).isNotNull(), F.col(ordinal)))
    rows = keyed.groupBy("entity").agg(
        F.min(ordinal).alias(ordinal), F.count(F.lit(1)).alias("n_rows"), *first, base_name.alias("__first")
    )
    better = lookup(keyed.select("entity", name_col, F.col(ordinal).alias("__o")), rows.select("entity", "__first", ordinal), ["entity"])
    better = better.filter(
        (F.col("__o") > F.col(ordinal))
        & ((F.col(name_col) != name_key(name_col)) | (F.length(name_col) > F.length("__first")))
    ).groupBy("entity").agg(F.max_by(name_col, "__o").alias("__better"))
    out = lookup(rows, better, ["entity"])
    return out.withColumn(name_col, F.coalesce("__better", "__first")).drop("__first", "__better")


def consolidate_categories(long: DataFrame, name_col: str, ordinal: str, category: str, values: list[str],
                           pctile: str) -> DataFrame:
    """(name key, category): the first row in order, one with a percentile before one without."""
    keyed = long.withColumn("name_key", name_key(name_col, "token"))
    order = [F.col(pctile).isNull(), F.col(ordinal)]
    return pick_first(keyed, ["name_key", category], order).select("name_key", category, *values)


def consolidate_players(players: DataFrame, name_col: str, ordinal: str, fills: list[str]) -> DataFrame:
    """One row per name key: longest name, first value per column that is neither null, blank nor zero."""
    keyed = players.withColumn("name_key", name_key(name_col, "token"))
    aggs = [F.max_by(name_col, F.struct(F.length(name_col), -F.col(ordinal))).alias(name_col)]
    for c in fills:
        text = F.trim(F.col(c).cast("string"))
        given = F.col(c).isNotNull() & ~text.isin("", "0", "0.0")
        aggs.append(F.min_by(c, F.when(given, F.col(ordinal))).alias(c))
    return keyed.groupBy("name_key").agg(*aggs)


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stacks tables by column name with a tag column; columns a table lacks are null."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def union_first_source(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Stacks tables; a key listed by several keeps the row of the earliest table."""
    stacked = union_tagged({f"{i:04d}": f for i, f in enumerate(frames)}, "__src")
    rest = [c for c in stacked.columns if c not in keys and c != "__src"]
    return pick_first(stacked, keys, [F.col("__src"), *[F.col(c).asc_nulls_last() for c in rest]]).drop("__src")


def union_preferring(df: DataFrame, keys: list[str], prefer: Column, ordinal: str) -> DataFrame:
    """One row per key: a preferred row beats an earlier one, else the earliest stays."""
    return pick_first(df, keys, [F.when(prefer, 0).otherwise(1), F.col(ordinal)])


def metric_coverage(df: DataFrame, expected: list[str], by: list[str]) -> DataFrame:
    """Per expected metric: is the column there, and how many rows have a value."""
    present = [m for m in expected if m in df.columns]
    absent = [m for m in expected if m not in df.columns]
    wide = df.select(*by, *[F.col(m).cast("double").alias(m) for m in present],
                     *[F.lit(None).cast("double").alias(m) for m in absent])
    counts = wide.unpivot(by, expected, "metric", "value").groupBy(*by, "metric").agg(
        F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n_rows")
    )
    return counts.withColumn("present", F.col("metric").isin(*present) if present else F.lit(False))


def disambiguate(df: DataFrame, name: str, tag: str, out: str = "display_name", unknown: str = "?") -> DataFrame:
    """'name (tag)' for names that occur more than once."""
    from statloom.operators.keys import with_group_stats

    counted = with_group_stats(df, [name], __n=F.count(F.lit(1)))
    shown = F.concat(F.col(name), F.lit(" ("), F.coalesce(F.col(tag), F.lit(unknown)), F.lit(")"))
    return counted.withColumn(out, F.when(F.col("__n") > 1, shown).otherwise(F.col(name))).drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New values win; status tells added, updated and kept rows."""
    o = old.select(*keys, F.col(value).alias("__o"), F.lit(True).alias("__had"))
    n = new.select(*keys, F.col(value).alias("__n"), F.lit(True).alias("__new"))
    both = o.join(n, keys, "full")
    status = F.when(F.col("__new") & F.col("__had"), "updated").when(F.col("__new"), "added").otherwise("kept")
    return both.select(
        *keys, F.when(F.col("__new"), F.col("__n")).otherwise(F.col("__o")).alias(value), status.alias("status")
    )
