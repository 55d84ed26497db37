"""Name keys, team and position codes, labels and composite keys."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import as_col

# Name suffixes in the order they are taken off.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")

# Codes read as defence and as forward.
DEFENCE_CODES = ("D", "LD", "RD", "DEFENSE", "DEFENCE", "DEFENSEMAN", "DEFENCEMAN")
FORWARD_CODES = ("F", "C", "LW", "RW", "L", "R", "W", "FORWARD")

# Dotted team codes and their standard form; other codes stay as they are.
TEAM_CODES = {"T.B": "TBL", "S.J": "SJS", "N.J": "NJD", "L.A": "LAK"}

# Pitch codes and names.
PITCH_NAMES = {
    "FF": "4-Seam", "SI": "Sinker", "FC": "Cutter", "SL": "Slider",
    "CU": "Curveball", "CH": "Changeup", "FS": "Splitter", "ST": "Sweeper",
    "KC": "Knuckle Curve", "CS": "Slow Curve", "SV": "Slurve", "KN": "Knuckleball",
    "FO": "Forkball", "FA": "Fastball", "EP": "Eephus", "SC": "Screwball",
}


@lru_cache(maxsize=None)
def accent_table(form: str = "NFD") -> tuple[str, str]:
    """(from, to) character strings for translate(), derived from the Unicode decompositions."""
    source, target = [], []
    for code in list(range(0x00A0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize(form, ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def fold_accents(c, form: str = "NFD") -> Column:
    """Letters without their marks; also drops marks that stand as separate characters."""
    source, target = accent_table(form)
    return F.regexp_replace(F.translate(as_col(c), source, target), "[\\u0300-\\u036f]", "")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def name_key(c, style: str = "suffix") -> Column:
    """Comparable form of a person name.

    suffix: hyphen becomes a blank, one trailing suffix of each kind is removed.
    ascii:  hyphen and apostrophe are removed, a trailing position tag such as (LW) too.
    token:  hyphen is removed, suffixes go wherever they stand as a word.
    """
    c = as_col(c)
    if style == "suffix":
        k = F.lower(fold_accents(c))
        k = F.regexp_replace(F.regexp_replace(k, "[.,]", ""), "-", " ")
        for s in SUFFIXES:
            k = F.regexp_replace(k, f" {s}$", "")
        return F.coalesce(_squeeze(k), F.lit(""))
    if style == "ascii":
        k = F.lower(F.trim(fold_accents(c, "NFKD")))
        k = F.regexp_replace(k, "[^\\x00-\\x7f]", "")
        k = F.regexp_replace(k, "[.'\\-]", "")
        k = F.regexp_replace(k, "\\s*\\([dclr]w?\\)\\s*$", "")
        return _squeeze(k)
    if style == "token":
        k = F.regexp_replace(F.lower(fold_accents(c)), "[.\\-,]", "")
        k = F.regexp_replace(k, "\\b(" + "|".join(SUFFIXES) + ")\\b", "")
        return _squeeze(k)
    raise ValueError(f"unknown name style {style!r}")


def search_key(c) -> Column:
    """Accent- and case-insensitive form for contains() searches."""
    return F.lower(fold_accents(c))


def flip_last_first(c) -> Column:
    """'Last, First' to 'First Last'; other texts stay."""
    return F.regexp_replace(as_col(c), "^(.*?), (.*)$", "$2 $1")


def full_name(first, last) -> Column:
    return F.concat_ws(" ", as_col(first), as_col(last))


def position_group(c) -> Column:
    """F, D or null from a position text that may list several positions."""
    first = F.trim(F.split(F.upper(F.trim(as_col(c))), ",")[0])
    return F.when(first.isin(*DEFENCE_CODES), "D").when(first.isin(*FORWARD_CODES), "F")


def current_team(c) -> Column:
    """Last team of a comma list."""
    return F.trim(F.element_at(F.split(as_col(c), ","), -1))


def standard_team(c, codes: dict[str, str] | None = None) -> Column:
    code = F.upper(current_team(c))
    out = F
    for k, v in (codes or TEAM_CODES).items():
        out = out.when(code == k, v)
    return out.otherwise(code)


def pitch_key(game, at_bat, pitch) -> Column:
    """game_atbat_pitch with the at-bat counted from zero."""
    return F.concat_ws(
        "_", as_col(game).cast("string"), (as_col(at_bat) - 1).cast("string"), as_col(pitch).cast("string")
    )


def season_label(year) -> Column:
    """2025 -> 25-26."""
    y = as_col(year).cast("int")
    return F.concat(F.lpad((y % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_span(year) -> Column:
    """2025 -> 20252026."""
    y = as_col(year).cast("int")
    return F.concat(y.cast("string"), (y + 1).cast("string"))


def strip_team_prefix(c) -> Column:
    """'Team Mexico' -> 'Mexico', in any case."""
    return F.trim(F.regexp_replace(as_col(c), "(?i)^Team\\s+", ""))


def parent_team_key(c) -> Column:
    """Key of the parent club of a prospect squad."""
    return F.lower(F.trim(F.regexp_replace(as_col(c), "(?i)\\s*Prospects?\\s*", "")))


def pitch_name(code) -> Column:
    c = as_col(code)
    out = F
    for k, v in PITCH_NAMES.items():
        out = out.when(c == k, v)
    return out.otherwise(c)


def contains_any(c, words) -> Column:
    """True when the lower-cased text holds one of the words; null counts as empty."""
    low = F.lower(F.coalesce(as_col(c), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out
