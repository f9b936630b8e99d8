"""Compares a query with its SQL in DuckDB: columns by name, rows as a bag."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    have = rows_of(df.columns, df.collect())
    if have == want:
        return None if have else "no rows"
    return f"{len(have)} and {len(want)} rows; only here {[x for x in have if x not in set(want)][:3]}; only there {[x for x in want if x not in set(have)][:3]}"
