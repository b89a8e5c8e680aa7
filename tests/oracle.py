"""Compares a query with its DuckDB SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def compare(df, con, sql):
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    other = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert mine == other
    return mine
