"""Runs queries and their SQL side by side and compares the results.

usage: python tools/check_sql.py [--dir FOLDER] [name-part ...]
"""

import argparse
import os
import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from statloom.plans import catalog  # noqa: E402
from statloom.plans.bindings import BASE_TABLES  # noqa: E402


def session():
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def kind(values: pd.Series) -> str:
    for v in values:
        if v is not None and v == v:
            n = type(v).__name__
            return {"int32": "int", "int64": "int", "int8": "int", "bool_": "bool", "float64": "float", "float32": "float",
                    "int16": "int", "Timestamp": "time", "datetime": "time", "ndarray": "list"}.get(n, n)
    return "empty"


def canonical(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "null"
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return repr(float(v))
    if type(v).__name__.startswith("int") or isinstance(v, int):
        return str(int(v))
    if type(v).__name__ in ("Timestamp", "datetime", "date"):
        return str(pd.Timestamp(v))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canonical(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canonical(v.asDict())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark, con = session(), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.dir}/{t}.parquet'")
    queries, sql = catalog.queries(), catalog.oracle_sql()
    picked = [n for n in queries if not a.names or any(p in n for p in a.names)]
    bad = 0
    for n in picked:
        t = time.time()
        try:
            df = queries[n](spark, a.dir)
            got_cols, got = df.columns, df.collect()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: spark: {str(e)[:700]}")
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
            continue
        spent = time.time() - t
        if n not in sql:
            print(f"rows {n}: {len(got)} rows, {spent:.1f}s")
            continue
        try:
            r = con.sql(sql[n])
            want_cols, types, want = r.columns, [str(x) for x in r.types], r.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: sql: {str(e)[:700]}")
            continue
        notes = []
        if sorted(got_cols) != sorted(want_cols):
            notes.append(f"columns {sorted(got_cols)} vs {sorted(want_cols)}")
        else:
            st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            wt = dict(zip(want_cols, types))
            for c in got_cols:
                s, w = st[c], wt[c]
                ok = ((s in ("int", "bigint", "smallint", "tinyint") and w in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT"))
                      or (s in ("double", "float") and w in ("DOUBLE", "FLOAT")) or (s == "string" and w == "VARCHAR")
                      or (s == "boolean" and w == "BOOLEAN") or (s == "date" and w == "DATE")
                      or (s.startswith("timestamp") and w.startswith("TIMESTAMP"))
                      or (s.startswith(("array", "map", "struct")) and not w.isalpha()))
                if not ok:
                    notes.append(f"type {c}: {s} vs {w}")
            g, w = rows(got_cols, got), rows(want_cols, want)
            if len(g) != len(w):
                notes.append(f"{len(g)} rows vs {len(w)}")
            if g != w:
                gs, ws = set(g), set(w)
                only_g, only_w = sorted(gs - ws)[:2], sorted(ws - gs)[:2]
                notes.append(f"differ: {len(gs - ws)}/{len(ws - gs)}\n   cols  {sorted(got_cols)}\n   spark {only_g}\n   sql   {only_w}")
        if len(got) == 0:
            notes.append("no rows")
        bad += bool(notes)
        print(f"{'FAIL' if notes else 'ok  '} {n}: {len(got)} rows, {spent:.1f}s " + "; ".join(notes), flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
