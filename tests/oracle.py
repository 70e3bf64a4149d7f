"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

import datetime
import decimal
import glob
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if v == v else "nan"
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    assert len(mine) == len(theirs), f"{len(mine)} rows, {len(theirs)} in SQL"
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, f"\n{sorted(df.columns)}\nspark {a}\nsql   {b}"
