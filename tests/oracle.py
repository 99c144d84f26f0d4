"""A query's rows and those of its SQL, in a form that can be compared."""

import math
import os

import duckdb


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool | str | bytes):
        return str(value)
    if isinstance(value, int | float):
        return repr(round(float(value), 7))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
