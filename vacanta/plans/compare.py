"""Side-by-side check of a Spark query against its DuckDB oracle.

Used by the tests and by hand; mirrors the driver's gate: row count, column
names, and an order-insensitive comparison of values (floats compared after
rounding to a relative precision).
"""
from __future__ import annotations

import datetime as _dt
import decimal
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        if f == 0:
            return 0.0
        if f.is_integer() and abs(f) < 1e15:
            return float(int(f))
        mag = math.floor(math.log10(abs(f)))
        return round(f, min(9 - mag, 12))
    if isinstance(v, int):
        return float(v)
    if isinstance(v, _dt.datetime):
        return v.isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, repr(x)) for x in row)


def normalise_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=_key)


def compare(spark_df, con, sql: str) -> dict:
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = {"spark_rows": len(srows), "oracle_rows": len(drows),
           "columns_match": sorted(scols) == sorted(dcols)}
    if not out["columns_match"]:
        out["spark_columns"] = scols
        out["oracle_columns"] = dcols
        out["match"] = False
        return out
    a = normalise_rows(scols, srows)
    b = normalise_rows(dcols, drows)
    out["match"] = a == b
    if not out["match"]:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out["columns"] = sorted(scols)
        out["spark_only"] = diff_a
        out["oracle_only"] = diff_b
    return out
