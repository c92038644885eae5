"""Run a registered query in Spark and its SQL twin in DuckDB, and compare."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return ("float", "nan" if v != v else repr(v + 0.0))
    if isinstance(v, (dt.datetime, dt.date)):
        return (type(v).__name__, v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(plain(x) for x in v))
    return (type(v).__name__, str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
}


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; an empty list means equal."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    duck = res.fetchall()
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    duck_types = {r[0]: r[1] for r in described}
    spark_rows = df.collect()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for field in df.schema:
        kind = field.dataType.simpleString()
        if duck_types[field.name] not in SAME_TYPE.get(kind, {duck_types[field.name]}):
            problems.append(f"type of {field.name}: {kind} != {duck_types[field.name]}")
    if len(spark_rows) != len(duck):
        problems.append(f"rows {len(spark_rows)} != {len(duck)}")
    a = canonical(df.columns, [tuple(r) for r in spark_rows])
    b = canonical(names, duck)
    if a != b:
        off = [(x, y) for x, y in zip(a, b) if x != y]
        cols = sorted(names)
        for x, y in off[:2]:
            parts = [f"{c}: {p[1]} != {q[1]}" for c, p, q in zip(cols, x, y) if p != q]
            problems.append(f"{len(off)} rows differ, e.g. {'; '.join(parts)[:400]}")
    return problems
