"""Pinned schemas of the logical tables, and the names that queries may use."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, N = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


BARS = _table(
    ("timestamp", N, False), ("symbol", S, False), ("open", D, True), ("high", D, True), ("low", D, True), ("close", D, True),
    ("volume", D, True), ("adj_close", D, True), ("dividend_amount", D, True), ("split_coefficient", D, True), ("source", S, True),
)
BACKTEST_RUNS = _table(
    ("id", S, False), ("strategy_name", S, False), ("symbol", S, False), ("start_date", N, False), ("end_date", N, False), ("params_json", S, False),
    ("initial_capital", D, False), ("commission_pct", D, False), ("slippage_pct", D, False), ("created_at", N, False),
)
TRADES = _table(
    ("id", L, False), ("backtest_id", S, False), ("entry_date", N, False), ("exit_date", N, True), ("direction", S, False), ("entry_price", D, False),
    ("exit_price", D, True), ("quantity", I, False), ("pnl", D, True), ("pnl_pct", D, True), ("commission", D, False),
)
EQUITY_CURVE = _table(("id", L, False), ("backtest_id", S, False), ("date", N, False), ("equity", D, False), ("drawdown_pct", D, False))
METRICS = _table(("id", L, False), ("backtest_id", S, False), ("metric_name", S, False), ("metric_value", D, False))
TABLES = {"backtest_runs": BACKTEST_RUNS, "trades": TRADES, "equity_curve": EQUITY_CURVE, "metrics": METRICS}

#: The ten metric names, in the order in which they are reported.
METRIC_NAMES = (
    "sharpe_ratio", "sortino_ratio", "cagr", "max_drawdown", "max_drawdown_duration",
    "win_rate", "profit_factor", "calmar_ratio", "total_trades", "total_return",
)


def differences(actual: T.StructType, pinned: T.StructType) -> list[str]:
    """What keeps a dataset from being the pinned version: missing, surplus or retyped columns."""
    have = {f.name: f.dataType.simpleString() for f in actual}
    want = {f.name: f.dataType.simpleString() for f in pinned}
    out = [f"missing column {n}" for n in want if n not in have] + [f"unexpected column {n}" for n in have if n not in want]
    return out + [f"column {n} is {have[n]}, not {want[n]}" for n in want if n in have and have[n] != want[n]]
