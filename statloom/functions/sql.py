"""The scalar metrics as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from statloom.functions.curve import CEILING, SHAPE, series_coefficients
from statloom.functions.names import SUFFIXES, accent_table


def _curve_sql() -> str:
    acc = "0.0D"
    for c in reversed(series_coefficients()):
        acc = f"({acc} * n + ({c!r}D))"
    part = f"element_at(transform(array(least(v, 1.0D - v)), n -> pow(n, {SHAPE}D) * {acc}), 1)"
    value = f"CASE WHEN v <= 0 THEN 0.0D WHEN v >= 1 THEN 1.0D WHEN v <= 0.5 THEN {part} ELSE 1.0D - {part} END"
    return f"CASE WHEN p IS NOT NULL THEN 100 * element_at(transform(array(least(p / {CEILING}D, 1.0D)), v -> {value}), 1) END"


def _name_key_sql() -> str:
    src, dst = accent_table()
    k = f"regexp_replace(lower(regexp_replace(translate(s, '{src}', '{dst}'), '[\\\\u0300-\\\\u036f]', '')), '[.,]', '')"
    k = f"regexp_replace({k}, '-', ' ')"
    for suffix in SUFFIXES:
        k = f"regexp_replace({k}, ' {suffix}$', '')"
    return f"coalesce(trim(regexp_replace({k}, '\\\\s+', ' ')), '')"


FUNCTIONS = {
    "round_half_up(x DOUBLE, digits INT) RETURNS DOUBLE": "floor(x * pow(10, digits) + 0.5D) / pow(10, digits)",
    "round_to_even(x DOUBLE, digits INT) RETURNS DOUBLE": "rint(x * pow(10, digits)) / pow(10, digits)",
    "safe_pct(n DOUBLE, d DOUBLE) RETURNS DOUBLE": "CASE WHEN d > 0 THEN n / d * 100 END",
    "in_strike_zone(x DOUBLE, z DOUBLE, top DOUBLE, bottom DOUBLE, half_width DOUBLE) RETURNS BOOLEAN":
        "CASE WHEN x IS NOT NULL AND z IS NOT NULL THEN abs(x) <= half_width "
        "AND z >= coalesce(nullif(bottom, 0), 1.5) AND z <= coalesce(nullif(top, 0), 3.5) END",
    "angle_bucket(a DOUBLE) RETURNS INT": "CASE WHEN a IS NOT NULL THEN CAST(greatest(0, least(11, ceil((a + 10) / 5) )) AS INT) END",
    "count_bucket(b INT, s INT) RETURNS STRING":
        "CASE WHEN b = 0 AND s = 0 THEN 'first' WHEN b = 3 AND s = 2 THEN 'full' "
        "WHEN b <= 2 AND s <= 2 AND b < s THEN 'ahead' WHEN b <= 2 AND s <= 2 AND b = s THEN 'even' "
        "WHEN b <= 3 AND s <= 1 AND b > s THEN 'behind' END",
    "vaa_straight(release_z DOUBLE, extension DOUBLE) RETURNS DOUBLE":
        "CASE WHEN extension < 60.5 THEN rint(degrees(atan((2.5D - release_z) / (60.5D - extension))) * 100) / 100 END",
    "outs_to_innings(outs BIGINT) RETURNS DOUBLE": "rint((floor(outs / 3) + (outs % 3) * 0.1D) * 10) / 10",
    "stretch_percentile(p DOUBLE) RETURNS DOUBLE": _curve_sql(),
    "name_key(s STRING) RETURNS STRING": _name_key_sql(),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names. They expand to native expressions."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
