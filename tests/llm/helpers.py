"""Rows of a query and of its SQL, for comparison."""

import duckdb


def sql_rows(sf_dir, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(r[i] for i in sorted(range(len(names)), key=names.__getitem__)) for r in cur.fetchall()), key=repr), sorted(names)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), names


def same(df, sf_dir, sql, tables=("documents",)):
    got, names = spark_rows(df)
    want, expected = sql_rows(sf_dir, sql, tables)
    assert names == expected
    assert got == want
