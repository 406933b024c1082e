"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("T00:00:00", "")
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return comparable(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql, sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    made = con.execute(sql)
    return comparable([d[0] for d in made.description], made.fetchall())
