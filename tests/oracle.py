"""Compare a registered query with its DuckDB SQL on the same tables."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    return sorted(tuple(shown(v) for v in r) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = rows_of(columns, [[r[c] for c in columns] for r in df.collect()])
    theirs = con.sql(sql)
    assert sorted(theirs.columns) == columns
    expected = rows_of(columns, theirs.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == expected
    return len(ours)
