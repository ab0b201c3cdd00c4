"""The registered queries: name -> query over a data folder, and name -> the same in SQL for a check."""

from __future__ import annotations

from tidelayer.suite import checks, files, guards, layers, mechanisms, relational, streams, tables

_PARTS = (files, relational, layers, guards, checks, tables, streams, mechanisms)


def queries():
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
