"""Spark rows against DuckDB rows over the same Parquet files."""

import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if glob.glob(path):
            c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)


def same(df, sql, connection):
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    theirs = connection.sql(f"select {quoted} from ({sql.strip()})")
    return cols == sorted(connection.sql(sql).columns) and rows_of(df.select(*cols).collect()) == rows_of(theirs.fetchall())
