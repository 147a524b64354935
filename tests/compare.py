"""Rows of a Spark result and of its DuckDB SQL, in one form."""

import os

import duckdb


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if hasattr(v, "quantize") or isinstance(v, float):
        v = float(v)
        return str(int(v)) if v == int(v) else str(round(v, 5))
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
