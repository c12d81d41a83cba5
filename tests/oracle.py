"""Compare a query's rows with its DuckDB statement's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(df, sql: str, con) -> str:
    """Empty if both give the same columns and rows, in any order."""
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    extra, lack = [x for x in got if x not in want][:3], [x for x in want if x not in got][:3]
    return f"{len(got)} and {len(want)} rows; only here: {extra}; only there: {lack}"[:900]
