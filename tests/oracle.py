"""Compare a query with its SQL twin: column names, row counts, values regardless of order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One form per value, so that both engines' types compare."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, function, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = function(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    theirs = rows_of(columns, relation.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if mine == theirs:
        return None
    only_mine = sorted(set(mine) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(mine))[:3]
    return f"rows {len(mine)} vs {len(theirs)}; spark {only_mine}; sql {only_theirs}"
