"""Runs registered queries next to their SQL in DuckDB and compares columns, types and values.

Standalone: python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "hugeint": "int", "integer": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
    "timestamp": "time", "timestamp_ntz": "time",
}


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    if dtype.startswith("array<") or dtype.endswith("[]"):
        return "list"
    if dtype.startswith("decimal"):
        return "decimal"
    return KINDS.get(dtype, dtype)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(names: list[str], all_names: list[str], rows) -> list[tuple]:
    order = [all_names.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sorted_rows(names: list[str], all_names: list[str], rows) -> list[tuple]:
    order = [all_names.index(n) for n in names]
    return [tuple(plain(r[i]) for i in order) for r in rows]


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    ours = query(spark, sf_dir)
    theirs = con.execute(sql)
    their_types = {d[0]: kind(str(d[1])) for d in theirs.description}
    our_types = {name: kind(t) for name, t in ours.dtypes}
    names = sorted(our_types)
    if names != sorted(their_types):
        return f"columns: {names} / {sorted(their_types)}"
    types = {n: (our_types[n], their_types[n]) for n in names if our_types[n] != their_types[n]}
    if types:
        return f"types: {types}"
    a = rows_of(names, ours.columns, ours.collect())
    b = rows_of(names, [d[0] for d in theirs.description], theirs.fetchall())
    if len(a) != len(b):
        return f"rows: {len(a)} / {len(b)}"
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    if not differing and re.search(r"ORDER BY [^)]*$", sql):  # a sorted result: in the order of the SQL
        a, b = (sorted_rows(names, *x) for x in ((ours.columns, ours.collect()), ([d[0] for d in theirs.description], con.execute(sql).fetchall())))
        differing = [(x, y) for x, y in zip(a, b) if x != y]
        return f"order differs at {differing[0]}" if differing else None
    return f"{len(differing)} of {len(a)} rows differ, columns {names}, first: {differing[0]}" if differing else None


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tidelayer.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("oracle", cpus=8)
    con = connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, query, oracle[name]) if name in oracle else "no SQL"
        except Exception as error:  # report and go on
            result = f"error: {type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        print(f"{name:24} {time.time() - start:6.2f}s {result or 'ok'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
