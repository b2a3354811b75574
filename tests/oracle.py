"""Runs a query and its DuckDB text side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        return v

    return sorted(([value(r[k]) for k in order] for r in data), key=repr), sorted(columns)


def same(spark, name, query, sql, folder):
    got = query(spark, folder)
    data, names = rows(got.columns, [tuple(r) for r in got.collect()])
    cur = connection(folder).execute(sql)
    want, want_names = rows([c[0] for c in cur.description], cur.fetchall())
    assert names == want_names, f"{name}: {names} {want_names}"
    assert len(data) == len(want), f"{name}: {len(data)} rows, not {len(want)}"
    off = []
    for a, b in zip(data, want):
        for c, x, y in zip(names, a, b):
            if x != y and not (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6)):
                off.append((c, a, b))
                break
    assert not off, f"{name}: {len(off)} of {len(data)} rows differ: {off[:2]}"
    exact = sum(a == b for a, b in zip(data, want))
    return len(data), exact
