"""Compares a query with the SQL that must give the same rows, column by column and without order."""

from pathlib import Path

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(folder).iterdir()):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


def rows(got, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in got)


def same(spark, folder, plan, sql):
    df = plan(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(got, df.columns) == rows(cur.fetchall(), names)
