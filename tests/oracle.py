"""Compares a registered query with its DuckDB SQL on one of the data folders."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def same(spark, d, f, sql):
    df = f(spark, d)
    cols = sorted(df.columns)
    ours = sorted(repr([_norm(r[c]) for c in cols]) for r in df.collect())
    r = connect(d).sql(sql)
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    theirs = sorted(repr([_norm(x[i]) for i in at]) for x in r.fetchall())
    assert ours == theirs
    return len(ours)
