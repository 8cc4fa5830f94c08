"""Compares registered queries with their SQL oracles."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: float(v) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(repr(clean(r[i])) for i in order) for r in rows))


def differences(df, con, sql: str) -> str | None:
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} against {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None
