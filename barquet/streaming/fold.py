"""The backtest fold over a stream of bars: the account and the last bars of each symbol are the state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barquet.operators import backtest

STATE = "account binary, history binary, seq long"
FIELDS = ["timestamp", "open", "high", "low", "close", "adj_close"]
#: Bars that a strategy looks back on; only strategies whose indicators end there can be followed bar by bar.
LOOKBACK = {"ma_crossover": lambda p: int(p.get("slow_period", 50)) + 1, "breakout": lambda p: int(p.get("lookback", 20)) + 1}


def stream_backtest(bars: DataFrame, strategy: str, params: dict | None = None, config: backtest.Config = backtest.Config(), sizer=None) -> DataFrame:
    """Events of one strategy on every symbol of a stream of bars, in the columns of ``backtest.EVENTS``.

    Each bar is folded once, in order of time within its symbol; the events are those of the batch fold. A bar that
    isn't later than all before it fails the query, as it does in the batch fold: sort or hold back late bars first.
    """
    params = dict(params or {})
    if strategy not in LOOKBACK:
        raise ValueError(f"{strategy} looks back on all bars")
    keep, prepare, size = LOOKBACK[strategy](params), backtest.STRATEGIES[strategy], sizer or backtest.fixed_quantity()
    prepare(pd.DataFrame({c: pd.Series(dtype=float) for c in FIELDS}), params)  # refuses bad parameters here

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches))[FIELDS].sort_values("timestamp", kind="stable")
        if state.exists:
            account, history, seq = state.get
            account, history = pickle.loads(account), pickle.loads(history)
        else:
            account, history, seq = backtest.Account(config), new.iloc[:0], 0
        run_id = f"{strategy}|{key[0]}"
        rows: list[dict] = []

        def emit(kind: str, **fields) -> None:
            rows.append({"run_id": run_id, "kind": kind, "seq": seq + len(rows), "timestamp": bar.timestamp, **fields})

        joined = pd.concat([history, new], ignore_index=True)
        if not joined["timestamp"].is_monotonic_increasing or joined["timestamp"].duplicated().any():
            raise ValueError(f"{run_id}: bars must have strictly increasing timestamps")
        decide = prepare(joined, params)
        first = len(history)
        for i, bar in enumerate(joined.itertuples(index=False)):
            if i >= first:
                # Borrowing is charged from the second bar of the run on, wherever the batch begins.
                started = i > 0 or seq > 0
                backtest.step(account, bar, i if started else 0, decide, size, emit)
        state.update((pickle.dumps(account), pickle.dumps(joined.iloc[-keep:]), seq + len(rows)))
        yield backtest._typed(rows)

    return bars.select("symbol", *FIELDS).groupBy("symbol").applyInPandasWithState(run, backtest.EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
