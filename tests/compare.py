"""Rows of a Spark query and of DuckDB SQL, brought to one form."""

import datetime
import decimal
import math
import os

from gleaner.session import TABLES


def plain(x):
    if x is None or isinstance(x, str | bytes | bool):
        return x
    if isinstance(x, int):
        return x
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return str(x)


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = con.execute(sql)
    return in_order([d[0] for d in r.description], r.fetchall())


def of_spark(df):
    return in_order(df.columns, [tuple(r) for r in df.collect()])
