"""Holds a frame against DuckDB SQL over small tables."""

from __future__ import annotations

import duckdb


def same_rows(found, sql: str, **tables) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, frame in tables.items():
        con.register(f"_{name}", frame.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = sorted((tuple(row[columns.index(c)] for c in sorted(columns)) for row in result.fetchall()), key=str)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(row[c] for c in sorted(columns)) for row in found.collect()), key=str) == expected
