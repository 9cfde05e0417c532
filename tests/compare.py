"""Rows of a Spark result and of a DuckDB query in one form."""

import decimal
import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    return cols, sorted(repr(tuple(norm(dict(zip(names, x))[c]) for c in cols)) for x in r.fetchall())
