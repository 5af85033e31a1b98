"""Runs a registered query in Spark and its SQL in DuckDB and compares rows, order aside."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(float(value)) if not isinstance(value, int) else repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.typeName() for f in df.schema.fields}


DUCK_KINDS = {
    "BIGINT": "long",
    "INTEGER": "integer",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    duck_types = {d[0]: str(d[1]) for d in relation.description}
    duck = relation.fetchall()
    spark = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in kinds(df).items():
        if DUCK_KINDS.get(duck_types[name], duck_types[name]) != kind:
            problems.append(f"type of {name}: {kind} != {duck_types[name]}")
    left, right = rows_of(df.columns, spark), rows_of(names, duck)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)} rows")
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        problems.append(f"only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}; {len(a)}/{len(b)}")
    return problems
