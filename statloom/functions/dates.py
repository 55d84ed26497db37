"""Innings notation, seasons and date windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import as_col
from statloom.functions.numeric import round_half_even

# Season windows by competition, as ((from month, day), (to month, day)).
SEASON_WINDOWS = {"S": ((2, 20), (3, 28)), "R": ((3, 20), (11, 5)), "P": ((10, 1), (11, 15))}

# Half-month pull ranges of a regular season and of spring.
REGULAR_RANGES = (
    ("03-20", "04-15"), ("04-16", "04-30"), ("05-01", "05-15"), ("05-16", "05-31"),
    ("06-01", "06-15"), ("06-16", "06-30"), ("07-01", "07-15"), ("07-16", "07-31"),
    ("08-01", "08-15"), ("08-16", "08-31"), ("09-01", "09-15"), ("09-16", "10-02"),
)
SPRING_RANGES = (("02-20", "03-10"), ("03-11", "03-28"))


def outs_to_innings(outs, compat: bool = False) -> Column:
    """Innings notation (5.2 is five and two thirds). compat repeats the published arithmetic slip."""
    o = as_col(outs)
    whole = o / 3 if compat else F.floor(o / 3)
    return round_half_even(whole + (o % 3) * 0.1, 1)


def innings_to_outs(ip) -> Column:
    """Outs from innings text such as '5.2'."""
    parts = F.split(as_col(ip).cast("string"), "\\.")
    return parts[0].try_cast("int") * 3 + F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))


def actual_innings(outs) -> Column:
    return as_col(outs) / 3


def season_of(date) -> Column:
    """Year of a date or of date text; text that is no date gives null."""
    return F.year(as_col(date).try_cast("date"))


def in_season_window(date, season, kind: str) -> Column:
    (m1, d1), (m2, d2) = SEASON_WINDOWS[kind]
    y = as_col(season)
    return as_col(date).between(F.make_date(y, F.lit(m1), F.lit(d1)), F.make_date(y, F.lit(m2), F.lit(d2)))


def minimum_appearances(season, run_date, early: int = 25, full: int = 100) -> Column:
    """25 before 1 June of the running season, else 100."""
    y, d = as_col(season), as_col(run_date)
    return F.when((F.year(d) == y) & (F.month(d) < 6), early).otherwise(full)


def half_month_start(date) -> Column:
    """First day of the half month (1st or 16th) a date falls in."""
    d = as_col(date)
    first = F.trunc(d, "month")
    return F.when(F.dayofmonth(d) <= 15, first).otherwise(F.date_add(first, 15))
