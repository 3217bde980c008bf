"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import decimal
import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal, list, tuple)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return f"{float(v):.6f}".replace("-0.000000", "0.000000")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def duck(folder):
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return con
