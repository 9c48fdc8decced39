"""Helpers shared by the tests."""

from __future__ import annotations

import math
import os

import duckdb

DATA = "/root/testdata"


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    return value


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    ordered = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(ordered, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return canonical([c[0] for c in cur.description], cur.fetchall())


def spark_kinds(df) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def oracle_kinds(con, sql: str) -> dict[str, str]:
    names = {
        "BIGINT": "bigint", "HUGEINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp_ntz", "DATE": "date",
    }
    return {r[0]: names.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
