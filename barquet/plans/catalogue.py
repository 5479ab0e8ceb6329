"""Registered queries of the reference's operators, with their DuckDB SQL."""

from __future__ import annotations

from barquet.plans import acquisition, bars, engine, runs, series

FLAGSHIP = "backtest_comparison"
QUERIES: dict = {**runs.QUERIES, **bars.QUERIES, **acquisition.QUERIES, **series.QUERIES, **engine.QUERIES}
ORACLE_SQL: dict = {**runs.ORACLE_SQL, **bars.ORACLE_SQL, **acquisition.ORACLE_SQL, **series.ORACLE_SQL, **engine.ORACLE_SQL}
