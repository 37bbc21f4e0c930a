"""What tests share."""

DATA = "/root/testdata"


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return [tuple(r) for r in df.select(*columns).collect()]


def shown(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def same_as_sql(spark, query, sql, folder):
    """Runs a query and SQL over the same tables and compares names and rows."""
    import os

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = query(spark, folder)
    want = con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert shown(rows_of(found, columns)) == shown(want.select(*(f'"{c}"' for c in columns)).fetchall())
