"""Comparing a query's rows with those of its SQL."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([canonical(x) for x in v])
    return repr(v)


def same_rows(df, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(tuple(canonical(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    assert got == want
