"""Rows of a Spark query and of its SQL in DuckDB, brought to one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, (bool, int)):
        return str(value)
    if isinstance(value, float):
        return f"{value:.5f}".replace("-0.00000", "0.00000")
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


def of_duckdb(sql, sf):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = con.execute(sql)
        return rows([c[0] for c in found.description], found.fetchall())


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
