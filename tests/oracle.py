"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(t: str) -> str:
    t = t.lower()
    if t in ("int", "integer", "bigint", "smallint", "tinyint", "hugeint"):
        return "int"
    if t.startswith(("double", "float", "decimal")):
        return "double"
    if t in ("string", "varchar"):
        return "string"
    return t.replace("timestamp_ntz", "timestamp")


def cell(v):
    if v is None:
        return (1, "")
    if isinstance(v, bool):
        return (0, str(v))
    if isinstance(v, float):
        return (0, "nan") if math.isnan(v) else (0, f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return (0, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (0, str([cell(x) for x in v]))
    return (0, str(v))


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when they agree."""
    rel = con.sql(sql)
    names, got_names = sorted(rel.columns), sorted(df.columns)
    if names != got_names:
        return [f"columns {got_names} != {names}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    problems = [
        f"type of {c}: {t} != {types[c]}" for c, t in df.dtypes if kind(t) != kind(types[c])
    ]
    want = sorted(tuple(cell(v) for v in r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall())
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    if len(want) != len(got):
        problems.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {[x[1] for x in bad[0][0]]} != {[x[1] for x in bad[0][1]]}")
    return problems
