"""Compare every registered query with its oracle SQL: python tests/oracle_check.py [sf] [prefix..]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype) == "Int64":  # integers with nulls; Spark's arrive as floats
            df[c] = df[c].astype("float64") if df[c].isna().any() else df[c].astype("int64")
        if df[c].map(lambda v: isinstance(v, (list, np.ndarray))).any():
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)))
    text = df.astype(object).where(df.notna(), None).map(repr)
    order = text.apply(lambda r: "|".join(r), axis=1).argsort() if len(text) else []
    return df.iloc[list(order)].reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> list[str]:
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(set(a.columns) ^ set(b.columns))}"]
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    a, b = canon(a), canon(b)
    out = []
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            out.append(f"{c}: type {a[c].dtype} != {b[c].dtype}")
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            x, y = a[c].to_numpy(), b[c].to_numpy()
            same = (x == y) | (np.isnan(x) & np.isnan(y))
        else:
            x, y = a[c].astype(object), b[c].astype(object)
            same = ((x == y) | (x.isna() & y.isna())).to_numpy()
        if not same.all():
            i = int(np.argmin(same))
            out.append(f"{c}: {int((~same).sum())} differ, first {x[i]!r} != {y[i]!r}")
    return out


def main(sf: str, prefixes: list[str]) -> int:
    spark, con, bad = session(), duck(sf), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            t0 = time.time()
            got = fn(spark, sf).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            t2 = time.time()
            diff = differences(got, want)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            bad += 1
            continue
        bad += bool(diff)
        state = "FAIL" if diff else "ok  "
        print(f"{state} {name}: {len(got)} rows {t1 - t0:.1f}s/{t2 - t1:.1f}s {diff[:6]}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(main(sf, [a for a in args if not a.startswith("/")]))
