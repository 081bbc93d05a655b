"""Compare a Spark result with DuckDB's: column names, kinds of type, and all rows in any order."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "float": "float", "double": "float", "string": "text", "varchar": "text", "date": "date",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _normal(value):
    return float(f"{value:.12g}") if isinstance(value, float) else value


def _sorted(rows, names, order):
    places = [names.index(name) for name in order]
    return sorted((tuple(_normal(row[i]) for i in places) for row in rows), key=repr)


def differences(df, connection, sql) -> str | None:
    """None when both agree, else what differs."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    kinds = {column[0]: KINDS.get(str(column[1]).lower(), str(column[1])) for column in cursor.description}
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours_kinds = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    if ours_kinds != kinds:
        return f"types {ours_kinds} against {kinds}"
    ours = [tuple(row) for row in df.collect()]
    order = sorted(names)
    left, right = _sorted(ours, df.columns, order), _sorted(theirs, names, order)
    if left != right:
        wrong = [pair for pair in zip(left, right) if pair[0] != pair[1]][:2]
        return f"{len(left)} rows against {len(right)}; first differences {wrong}"
    return None
