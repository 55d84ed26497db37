"""Column clean-up and wide/long changes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.numeric import round_half_even, to_number


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def first_existing(df: DataFrame, candidates: list[str], kind: str = "string") -> Column:
    """First non-null among the candidate columns the table has; null if it has none."""
    have = [F.col(f"`{c}`").cast(kind) for c in candidates if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def numeric_columns(df: DataFrame, columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Numbers from text in the named columns, or in all but `keep`."""
    todo = columns if columns is not None else [c for c in df.columns if c not in keep]
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in todo if c in df.columns})


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keeps the first of columns that share a name."""
    positional = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    first = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c, i)
    return positional.select(*[F.col(f"__{i}").alias(c) for c, i in first.items()])


def ensure_columns(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def clean_header(name: str) -> str:
    folded = unicodedata.normalize("NFKD", name.replace("±", "pm")).encode("ascii", "ignore").decode()
    return folded.strip()


def clean_headers(df: DataFrame) -> DataFrame:
    """Drops unnamed columns; folds headers to trimmed ASCII, with plus-minus written pm."""
    kept = [c for c in df.columns if not re.match(r"^(Unnamed|_c\d+$)", c)]
    return df.select(*[F.col(f"`{c}`").alias(clean_header(c)) for c in kept])


def metric_entries(df: DataFrame, ids: list[str], specs: list[dict]) -> DataFrame:
    """One row per player and metric: value, strict percentile in its pool and display text.

    specs: {key, label, lower_better, decimals, scale}. A missing value keeps its row, with a dash.
    The pool is the metric over all rows, plus any `season` column among the ids.
    """
    from statloom.operators.ranks import strict_percentile, with_positions

    have = [s for s in specs if s["key"] in df.columns]
    wide = df.select(*ids, *[to_number(s["key"]).alias(s["key"]) for s in have])
    long = wide.unpivot(ids, [s["key"] for s in have], "metric", "value")
    pool = [c for c in ("season",) if c in ids]
    ranked = with_positions(long, "value", [*pool, "metric"])

    def by_metric(field, default=None):
        out = F
        for s in have:
            out = out.when(F.col("metric") == s["key"], F.lit(s.get(field, default)))
        return out

    lower = by_metric("lower_better", False).otherwise(False)
    shown = F.col("value") * by_metric("scale", 1.0).otherwise(1.0)
    text = F
    for d in sorted({s["decimals"] for s in have}):
        text = text.when(by_metric("decimals").otherwise(None) == d, F.format_string(f"%.{d}f", shown))
    return ranked.select(
        *ids, "metric", by_metric("label").otherwise(None).alias("label"), "value",
        strict_percentile(lower).alias("pctile"),
        F.when(F.col("value").isNull(), "—").otherwise(text.otherwise(None)).alias("display"),
    )


def to_columns(long: DataFrame, ids: list[str], name: str, names: list, value: str) -> DataFrame:
    """Long entries to one column per listed name."""
    return long.groupBy(*ids).pivot(name, names).agg(F.first(value, ignorenulls=True))


def export(df: DataFrame, columns: dict[str, tuple[str, int | None, float]]) -> DataFrame:
    """Ordered export columns: {name: (source, digits or None, factor)}."""
    return df.select(*[
        (F.col(s) if d is None else round_half_even(F.col(s) * factor, d)).alias(n)
        for n, (s, d, factor) in columns.items()
    ])


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def count_incomplete(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    from statloom.functions.numeric import all_present

    ok = all_present(columns)
    return df.groupBy(*by).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def competitive_swings(swings: DataFrame, batter: str = "batter", share: float = 0.10, floor: float = 60.0,
                       hard: float = 90.0) -> DataFrame:
    """Swings at or above the batter's own slow end, or fast enough with a hard-hit ball."""
    from statloom.operators.keys import lookup
    from statloom.operators.ranks import exact_quantiles
    from statloom.session import cut

    tracked = swings.filter(F.col("bat_speed").isNotNull())
    slow = cut(exact_quantiles(tracked, "bat_speed", [batter], {"__cut": share}).drop("n"), "slow-swings")
    fast = (F.col("bat_speed") >= floor) & F.coalesce(F.col("launch_speed") >= hard, F.lit(False))
    return lookup(tracked, slow, [batter]).filter((F.col("bat_speed") >= F.col("__cut")) | fast).drop("__cut")


def playable(status) -> Column:
    """False for games not yet or never played."""
    return ~F.lower(F.coalesce(F.col(status), F.lit(""))).rlike("scheduled|preview|postponed|cancelled|suspended")


def matches_search(query: str, *columns: str) -> Column:
    """Accent- and case-insensitive contains over several columns."""
    from statloom.functions.names import search_key

    q = search_key(F.lit(query))
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(search_key(c).contains(q), F.lit(False))
    return out


def even_stride(df: DataFrame, keys: list[str], order: list[str], most: int = 200) -> DataFrame:
    """At most `most` rows per key, evenly spaced in order; keys with fewer rows stay whole.

    A reporting operator: it thins points for a plot.
    """
    from statloom.operators.segments import row_index

    at = row_index(df, keys, order, "__i", "__n")
    step = F.col("__n") / F.lit(float(most))
    changes = F.floor(F.col("__i") / step) != F.floor((F.col("__i") - 1) / step)
    keep = (F.col("__n") <= most) | (F.col("__i") == 0) | changes
    return at.filter(keep).drop("__i", "__n")
