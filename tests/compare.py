"""Runs a query and its SQL on the same tables."""

import datetime

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, datetime.datetime):
        return str(v)[:19]
    return float(v) if hasattr(v, "as_tuple") else v


def rows(names, found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)


def both(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, wanted = query(spark, sf_dir), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(wanted.columns)
    select = wanted.select(*[f'"{n}"' for n in names]).fetchall()
    return rows(names, df.select(names).collect()), rows(names, select)
