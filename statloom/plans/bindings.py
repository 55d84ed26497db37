"""Sports-shaped views of the given tables.

Every column is an expression that Spark and the checking engine read alike, so a view is the same
SELECT in both. Views are lazy selections: only the columns a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.operators.ratings import ATTACK_COLUMNS, DEFENCE_COLUMNS, TEAMMATE_COLUMNS, rated_metrics

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_TYPE = (
    "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'FF' WHEN 'AO' THEN 'SI' WHEN 'NF' THEN 'SL' "
    "WHEN 'NO' THEN 'CH' WHEN 'RF' THEN 'CU' ELSE 'FS' END"
)
_DESCRIPTION = (
    "CASE l_partkey % 8 WHEN 0 THEN 'ball' WHEN 1 THEN 'called_strike' WHEN 2 THEN 'swinging_strike' WHEN 3 THEN 'foul' "
    "WHEN 4 THEN 'hit_into_play' WHEN 5 THEN 'foul_tip' WHEN 6 THEN 'swinging_strike_blocked' ELSE 'blocked_ball' END"
)

# Tracked pitches and swings: one per line item.
PITCHES = {
    "game_pk": "l_orderkey",
    "at_bat_number": "1 + l_linenumber % 3",
    "pitch_number": "l_linenumber",
    "pitcher": "l_suppkey",
    "batter": "l_partkey",
    "pitch_type": _TYPE,
    "p_throws": "CASE WHEN l_suppkey % 3 = 0 THEN 'L' ELSE 'R' END",
    "stand": "CASE WHEN l_partkey % 2 = 0 THEN 'L' ELSE 'R' END",
    "game_date": "CAST(l_shipdate AS DATE)",
    "season": "CAST(year(l_shipdate) AS INT)",
    "description": _DESCRIPTION,
    "balls": "(l_linenumber + l_suppkey) % 4",
    "strikes": "(l_linenumber + l_partkey) % 3",
    "launch_speed": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 20 + l_extendedprice / 1103e0 END",
    "launch_angle": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity * 2 - 40 END",
    "bat_speed": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 50 + l_quantity * 0.6e0 + l_discount * 50 END",
    "swing_length": "5 + l_tax * 20",
    "attack_angle": "l_quantity - 15",
    "attack_direction": "l_discount * 200 - 10",
    "swing_path_tilt": "20 + l_tax * 200",
    "xwoba_est": "CASE WHEN l_partkey % 8 = 4 THEN l_discount * 8 + l_quantity / 100e0 END",
    "release_speed": "78 + l_quantity * 0.4e0",
    "release_spin_rate": "CASE WHEN l_orderkey % 40 = 0 THEN 0e0 ELSE 1200 + l_extendedprice / 53e0 END",
    "spin_axis": "CAST(l_partkey % 360 AS DOUBLE)",
    "pfx_x": "(l_tax - 0.04e0) * 20",
    "pfx_z": "(l_discount - 0.05e0) * 30",
    "plate_x": "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE (l_quantity - 25.5e0) / 20 END",
    "plate_z": "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE 1 + l_extendedprice / 35000e0 END",
    "sz_top": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 3.3e0 + (l_partkey % 5) / 10e0 END",
    "sz_bot": "CASE WHEN l_partkey % 13 = 0 THEN 0e0 ELSE 1.4e0 + (l_partkey % 3) / 10e0 END",
    "release_extension": "5.5e0 + l_discount * 15",
    "release_pos_x": "l_tax * 10 - 2",
    "release_pos_z": "5.2e0 + l_tax * 10",
    "vx0": "2 + l_tax * 50",
    "vy0": "0 - (113 + l_quantity * 0.58e0)",
    "vz0": "0 - (4 + l_discount * 30)",
    "ax": "(l_tax - 0.04e0) * 300",
    "ay": "20 + l_quantity * 0.2e0",
    "az": "l_discount * 150 - 32",
    "arm_angle": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 20e0 + l_suppkey % 50 + l_linenumber END",
    "hit_x": "CASE WHEN l_orderkey % 9 = 0 THEN 0e0 ELSE 40 + l_quantity * 3.5e0 END",
    "hit_y": "l_extendedprice / 500e0",
    "xrv": "l_discount - 0.05e0 + (l_quantity - 25) / 1000e0",
    "stuff": "(l_quantity - 25) / 500e0",
    "location": "l_discount - 0.05e0",
    "tunnel": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax - 0.04e0 END",
    "line_key": "l_orderkey * 1000000 + l_partkey * 100 + l_linenumber * 10 + l_suppkey % 10",
}

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# Pitch feed with plate appearances: one per event; a pitcher has one appearance a day.
FEED = {
    "pitch_number": "event_id",
    "pitcher": "user_id",
    "batter": "event_id % 97",
    "game_pk": "CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)",
    "game_date": "CAST(ts AS DATE)",
    "at_bat_number": "1 + user_id % 9",
    "inning": "1 + user_id % 3",
    "inning_topbot": "CASE WHEN user_id % 2 = 0 THEN 'Top' ELSE 'Bot' END",
    "home_team": "concat('H', day(ts) % 10)",
    "away_team": "CASE WHEN user_id % 19 = 1 THEN '' ELSE concat('A', day(ts) % 7) END",
    "player_name": "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('Last', user_id, ', First', day(ts) % 3) END",
    "description": "CASE event_type WHEN 'click' THEN 'foul' WHEN 'view' THEN 'ball' WHEN 'error' THEN 'swinging_strike' "
                   "WHEN 'purchase' THEN 'hit_into_play' ELSE 'called_strike' END",
    "events": f"CASE WHEN event_type = 'purchase' THEN (CASE {_K} % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'field_out' "
              f"WHEN 2 THEN 'grounded_into_double_play' WHEN 3 THEN 'walk' WHEN 4 THEN 'hit_by_pitch' ELSE 'triple_play' END) "
              f"WHEN event_type = 'error' AND {_K} % 5 = 0 THEN 'strikeout' ELSE '' END",
    "xwoba_est": f"CASE WHEN event_type = 'purchase' AND {_K} % 3 <> 0 THEN value / 500e0 END",
    "strikes": f"CASE WHEN {_K} % 13 = 0 THEN NULL ELSE {_K} % 3 END",
    "balls_after": f"CASE WHEN {_K} % 10 = 0 THEN NULL ELSE {_K} % 4 END",
    "strikes_after": f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE {_K} % 3 END",
    "ts": "ts",
    "value": "value",
    "k": _K,
    "event_type": "event_type",
}

_FIRST = (
    "CASE c_custkey % 8 WHEN 0 THEN 'José' WHEN 1 THEN 'Andrés' WHEN 2 THEN 'Luis' WHEN 3 THEN 'Aaron' WHEN 4 THEN 'J.T.' "
    "WHEN 5 THEN 'Jean-Luc' WHEN 6 THEN 'Björn' ELSE 'Ronald' END"
)
_LAST = (
    "concat(CASE c_custkey % 5 WHEN 0 THEN 'Ramírez' WHEN 1 THEN 'Muñoz' WHEN 2 THEN 'De La Cruz' WHEN 3 THEN 'Smith' "
    "ELSE 'Nuñez' END, c_custkey % 300)"
)
_SUFFIX = "CASE c_custkey % 17 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' WHEN 2 THEN ' (LW)' ELSE '' END"

# Players: one per customer.
PLAYERS = {
    "player_id": "c_custkey",
    "first_name": _FIRST,
    "last_name": _LAST,
    "name": f"concat({_FIRST}, ' ', {_LAST}, {_SUFFIX})",
    "listed": f"CASE WHEN c_custkey % 4 = 0 THEN {_LAST} ELSE concat({_LAST}, ', ', {_FIRST}) END",
    "team": "CASE WHEN c_nationkey % 4 = 0 THEN 'T.B' WHEN c_nationkey % 4 = 1 THEN 'BOS, NYR' WHEN c_nationkey % 4 = 2 "
            "THEN 'S.J, l.a' ELSE concat('N', c_nationkey) END",
    "position": "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'C, LW' WHEN 'MACHINERY' THEN 'D' WHEN 'FURNITURE' THEN 'rw' "
                "WHEN 'BUILDING' THEN 'Defence, C' ELSE 'G' END",
    "role": "CASE WHEN c_custkey % 2 = 0 THEN 'pitcher' ELSE 'hitter' END",
    "pa": "CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_custkey % 400 END",
    "ip": "CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE (c_custkey % 180) / 1e0 END",
    "gs": "CAST(c_custkey % 33 AS INT)",
    "acct": "c_acctbal",
    "nation": "c_nationkey",
    "segment": "c_mktsegment",
}


def _metric(i: int) -> str:
    p, m = 37 + 24 * i, 211 + 18 * i
    gap = 11 + i % 6
    return f"CASE WHEN (c_custkey + {i}) % {gap} = 0 THEN NULL ELSE ((c_custkey * {p} + {i}) % {m}) / 10e0 END"


def skater_metric_names() -> list[str]:
    derived = {"penalty_ratio", "dz_shift_pct", "ev_toi_per_gp", "pp_toi_per_gp", "pk_toi_per_gp"}
    names = set(rated_metrics()) | set(TEAMMATE_COLUMNS) | set(ATTACK_COLUMNS) | set(DEFENCE_COLUMNS)
    return sorted((names - derived) | {"all_pim_per60", "all_pen_drawn_per60"})


SKATER_METRICS = skater_metric_names()

# Skater seasons: one per customer.
SKATERS = {
    "player_id": "c_custkey",
    "name": f"concat({_FIRST}, ' ', {_LAST})",
    "team": "concat('N', c_nationkey)",
    "position": PLAYERS["position"],
    "pos_group": "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'F' WHEN 'MACHINERY' THEN 'D' WHEN 'FURNITURE' THEN 'F' "
                 "WHEN 'BUILDING' THEN 'D' END",
    "gp": "CAST(c_custkey % 83 AS DOUBLE)",
    "toi_min": "100 + (c_custkey * 31) % 1500 / 1e0",
    "toi_min_pp": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 7) % 300 / 1e0 END",
    "toi_min_pk": "CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE (c_custkey * 11) % 200 / 1e0 END",
    "cnt_dz": "CASE WHEN c_custkey % 20 = 0 THEN 0e0 ELSE (c_custkey * 3) % 90 / 1e0 END",
    "cnt_oz": "CASE WHEN c_custkey % 20 = 0 THEN 0e0 ELSE (c_custkey * 5) % 110 / 1e0 END",
    "cnt_nz": "CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE (c_custkey * 13) % 70 / 1e0 END",
    **{m: _metric(i) for i, m in enumerate(SKATER_METRICS)},
}

SELECTS = {
    "pitches": ("lineitem", PITCHES),
    "feed": ("events", FEED),
    "players": ("customer", PLAYERS),
    "skaters": ("customer", SKATERS),
}


def select_sql(name: str) -> str:
    base, columns = SELECTS[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {base}"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table or a binding."""
    if name in BASE_TABLES:
        return read(spark, folder, name)
    base, columns = SELECTS[name]
    return read(spark, folder, base).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
