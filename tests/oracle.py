"""Spark rows and DuckDB rows in one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def asked(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    return list(r.columns), r.fetchall()


def same(df, sql, sf_dir):
    names, rows = asked(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows(names, rows)
