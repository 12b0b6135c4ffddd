"""Comparison of a query with its SQL, as sorted rows with rounded numbers."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v


def rows(values):
    return sorted((tuple(map(_plain, r)) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, c, sql):
    names = sorted(df.columns)
    got = rows(df.select(*[f"`{n}`" for n in names]).collect())
    cursor = c.execute(sql)
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    want = rows([tuple(r[have.index(n)] for n in names) for r in cursor.fetchall()])
    assert got == want
    return len(got)
