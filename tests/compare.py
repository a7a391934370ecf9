"""Holds a Spark result against the oracle's: same columns, kinds of types and rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    con.execute(sql)
    return [x[0] for x in con.description], con.fetchall()


def normal(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(frame, sf_dir: str, sql: str) -> str:
    """Empty if equal; else what differs."""
    names, rows = oracle(sf_dir, sql)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    got, want = normal(frame.columns, [tuple(r) for r in frame.collect()]), normal(names, rows)
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{a} and {b}"
    return ""
