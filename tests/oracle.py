"""Compare a query with its SQL over the same tables."""

import glob
import math
import os

import duckdb


def connection(directory):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "HugeInt"):
        return f"{float(x):.9g}" if not isinstance(x, int) else str(x)
    return str(x)


def compared(spark, directory, query, sql):
    """(rows of the query, rows of the SQL), columns by name, rows sorted."""
    df = query(spark, directory)
    names = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    con = connection(directory)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    order = [cols.index(c) for c in names]
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    norm = lambda rows: sorted(tuple(_as_number(v) for v in r) for r in rows)
    return norm(ours), norm(theirs)


def _as_number(v):
    try:
        return f"{float(v):.9g}" if v not in ("NULL", "nan", "inf") and not v.isdigit() else v
    except ValueError:
        return v
