"""Run a query and its SQL twin side by side and compare rows as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value, digits: int | None = None):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if digits is not None:
            value = round(value, digits)
        value = value + 0.0
        return repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(plain(v, digits)) for v in value) + "]"
    return str(value)


def compare(spark, con, folder, function, sql, digits=None):
    """Return (ok, message)."""
    got = function(spark, folder)
    names = sorted(got.columns)
    rows = [tuple(plain(r[n], digits) for n in names) for r in got.collect()]
    result = con.execute(sql)
    wanted_names = [d[0] for d in result.description]
    order = sorted(range(len(wanted_names)), key=lambda i: wanted_names[i])
    if [wanted_names[i] for i in order] != names:
        return False, f"columns {names} != {sorted(wanted_names)}"
    wanted = [tuple(plain(r[i], digits) for i in order) for r in result.fetchall()]
    a, b = Counter(rows), Counter(wanted)
    if a == b:
        return True, f"{len(rows)} rows"
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{len(rows)} vs {len(wanted)} rows; names={names}\n   spark only: {extra}\n   sql only:   {missing}"
