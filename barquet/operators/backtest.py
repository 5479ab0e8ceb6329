"""Backtests as a grouped fold: one group a run, bars in order of time, a small state.

A run is a row of ``specs`` (``run_id, strategy, symbol, params``); runs times bars are spread over the cluster by
run, and each run's bars are folded by one task. A run needs the bars of one symbol in memory and nothing else.

The order within a bar is fixed: (1) borrowing for a short is charged, (2) the pending order meets the bar, (3) the
position is marked at the close and a point of the equity curve is written, (4) a short under its maintenance margin
gets a forced cover for the next bar, (5) the strategy sees the bar and may queue an order, which takes the place of
the one pending. At most one order is pending and one position open.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, SHORT = "LONG", "SHORT"
OPPOSITE = {LONG: SHORT, SHORT: LONG}


@dataclass(frozen=True)
class Config:
    initial_capital: float = 100_000.0
    commission_pct: float = 0.001
    slippage_pct: float = 0.0005
    short_initial_margin: float = 1.5
    short_maintenance_margin: float = 0.3
    annual_short_borrow_rate: float = 0.03
    borrow_day_count: float = 365.0

    def __post_init__(self):
        values = vars(self)
        if not all(math.isfinite(v) for v in values.values()):
            raise ValueError("all settings must be finite")
        if self.initial_capital <= 0 or self.borrow_day_count <= 0 or self.short_initial_margin < 1 or min(values.values()) < 0:
            raise ValueError("a setting is out of range")


@dataclass
class Order:
    side: str
    quantity: int
    kind: str = "MARKET"  #: or LIMIT, STOP
    price: float | None = None
    forced: bool = False


@dataclass
class Signal:
    side: str
    kind: str = "MARKET"
    price: float | None = None


@dataclass
class Account:
    """What a run carries from bar to bar."""

    config: Config
    cash: float = 0.0
    collateral: float = 0.0
    side: str | None = None
    quantity: int = 0
    entry_price: float = 0.0
    entry_date: object = None
    entry_commission: float = 0.0
    mark: float = 0.0
    borrowed_since: object = None
    peak: float = 0.0
    pending: Order | None = None
    results: list[float] = field(default_factory=list)  #: of closed trades, for sizing

    def __post_init__(self):
        self.cash = self.peak = self.config.initial_capital

    @property
    def equity(self) -> float:
        signed = {LONG: 1, SHORT: -1, None: 0}[self.side] * self.quantity
        return self.cash + self.collateral + signed * self.mark

    def accrue(self, now) -> None:
        if self.side == SHORT:
            days = (now - self.borrowed_since).total_seconds() / 86_400
            self.cash -= self.quantity * self.mark * self.config.annual_short_borrow_rate * days / self.config.borrow_day_count
            self.borrowed_since = now

    def fill(self, order: Order, price: float, now) -> tuple[str, dict | None]:
        """Open or close. What became of the order, and the trade if one was closed."""
        fee = price * order.quantity * self.config.commission_pct
        if self.side is not None:
            return "closed", self._close(price, fee, now)
        value = order.quantity * price
        needed = value + fee if order.side == LONG else value * (self.config.short_initial_margin - 1) + fee
        if needed > self.cash:
            return "rejected", None
        self.cash -= needed
        if order.side == SHORT:
            self.collateral, self.borrowed_since = value * self.config.short_initial_margin, now
        self.side, self.quantity, self.entry_price, self.entry_date, self.entry_commission, self.mark = order.side, order.quantity, price, now, fee, price
        return "opened", None

    def _close(self, price: float, fee: float, now) -> dict:
        value, cost = self.quantity * price, self.entry_price * self.quantity
        commission = self.entry_commission + fee
        gain = (value - cost if self.side == LONG else cost - value) - commission
        trade = {
            "direction": self.side, "quantity": self.quantity, "entry_date": self.entry_date, "entry_price": self.entry_price, "exit_date": now,
            "exit_price": price, "pnl": gain, "pnl_pct": gain / cost, "commission": commission,
        }
        self.cash += value - fee if self.side == LONG else self.collateral - value - fee
        self.collateral, self.side, self.quantity = 0.0, None, 0
        self.results.append(gain)
        return trade


def fill_price(order: Order, bar, slippage: float) -> float | None:
    """Where the order fills on the bar, or None."""
    buy = order.side == LONG
    worse = 1 + slippage if buy else 1 - slippage
    if order.kind == "MARKET":
        return bar.open * worse
    if order.kind == "LIMIT":
        good = bar.open <= order.price if buy else bar.open >= order.price
        if good:
            return (min if buy else max)(order.price, bar.open * worse)
        touched = bar.low <= order.price if buy else bar.high >= order.price
        return order.price if touched else None
    beyond = bar.open >= order.price if buy else bar.open <= order.price
    touched = bar.high >= order.price if buy else bar.low <= order.price
    return bar.open * worse if beyond else order.price * worse if touched else None


# Sizers: (account, price) -> quantity.


def fixed_quantity(quantity: int = 1):
    return lambda account, price: quantity


def fixed_fraction(fraction: float):
    return lambda account, price: max(1, math.floor(account.equity * fraction / price))


def kelly(lookback: int = 20, fraction: float = 0.5, most: float = 0.25):
    """Part of Kelly's fraction out of the last trades; a fiftieth of equity while these don't tell. Zero counts as a loss."""
    fallback = fixed_fraction(0.02)

    def size(account: Account, price: float) -> int:
        recent = account.results[-lookback:]
        won, lost = [r for r in recent if r > 0], [r for r in recent if r <= 0]
        mean_loss = abs(sum(lost) / len(lost)) if lost else 0.0
        if len(recent) < lookback or not won or mean_loss == 0:
            return fallback(account, price)
        share = len(won) / len(recent)
        best = share - (1 - share) / (sum(won) / len(won) / mean_loss)
        part = min(max(best * fraction, 0.0), most)
        return max(1, math.floor(account.equity * part / price)) if part > 0 else 1

    return size


SIZERS = {"fixed": fixed_quantity, "fraction": fixed_fraction, "kelly": kelly}


# Strategies: prepare(bars, params) -> decide(i, account) -> Signal | None. ``prepare`` raises ValueError for parameters
# that make no sense. A strategy enters only if flat with nothing pending, and leaves unless a forced cover is pending.


def _free(account: Account) -> bool:
    return account.side is None and account.pending is None


def _may_leave(account: Account) -> bool:
    return account.side == LONG and not (account.pending and account.pending.forced)


def _mean(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(1)
    return out


def ma_crossover(bars: pd.DataFrame, params: dict) -> Callable:
    fast, slow = int(params.get("fast_period", 10)), int(params.get("slow_period", 50))
    if not 0 < fast < slow:
        raise ValueError("fast_period must be below slow_period")
    price = bars["adj_close"].to_numpy(float)
    quick, calm = _mean(price, fast), _mean(price, slow)
    above = quick > calm

    def decide(i: int, account: Account) -> Signal | None:
        if i < slow or np.isnan(calm[i - 1]):
            return None
        if not above[i - 1] and above[i] and _free(account):
            return Signal(LONG)
        if above[i - 1] and not above[i] and _may_leave(account):
            return Signal(SHORT)
        return None

    return decide


def wilder_rsi(price: np.ndarray, period: int) -> np.ndarray:
    out = np.full(len(price), np.nan)
    move = np.diff(price)
    if len(move) < period:
        return out
    gains, losses = np.maximum(move, 0), np.maximum(-move, 0)
    g, l = gains[:period].sum() / period, losses[:period].sum() / period
    for i in range(period, len(price)):
        if i > period:
            g, l = (g * (period - 1) + gains[i - 1]) / period, (l * (period - 1) + losses[i - 1]) / period
        out[i] = 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    return out


def rsi_mean_reversion(bars: pd.DataFrame, params: dict) -> Callable:
    period, low, leave = int(params.get("period", 14)), params.get("oversold", 30.0), params.get("exit_level", 50.0)
    if period < 1:
        raise ValueError("period must be positive")
    level = wilder_rsi(bars["adj_close"].to_numpy(float), period)

    def decide(i: int, account: Account) -> Signal | None:
        if level[i] < low and _free(account):
            return Signal(LONG)
        if level[i] >= leave and _may_leave(account):
            return Signal(SHORT)
        return None

    return decide


def breakout(bars: pd.DataFrame, params: dict) -> Callable:
    n = int(params.get("lookback", 20))
    if n < 1:
        raise ValueError("lookback must be positive")
    high = bars["high"].rolling(n).max().shift(1).to_numpy()
    low = bars["low"].rolling(n).min().shift(1).to_numpy()
    close = bars["close"].to_numpy(float)

    def decide(i: int, account: Account) -> Signal | None:
        if close[i] > high[i] and _free(account):
            return Signal(LONG, "STOP", float(high[i]))
        if close[i] < low[i] and _may_leave(account):
            return Signal(SHORT)
        return None

    return decide


STRATEGIES: dict[str, Callable] = {"ma_crossover": ma_crossover, "rsi_mean_reversion": rsi_mean_reversion, "breakout": breakout}
#: Smallest, largest and step of each parameter.
PARAMETER_SPACE = {
    "ma_crossover": {"fast_period": (5, 50, 5), "slow_period": (20, 200, 10)},
    "rsi_mean_reversion": {"period": (7, 21, 2), "oversold": (20, 40, 5)},
    "breakout": {"lookback": (10, 60, 5)},
}


def step(account: Account, bar, i: int, decide: Callable, sizer: Callable, emit: Callable) -> None:
    """One bar. ``emit(kind, **fields)`` takes what happens."""
    now, c = bar.timestamp, account.config
    if i > 0:
        account.accrue(now)
    if account.pending is not None:
        order, price = account.pending, fill_price(account.pending, bar, c.slippage_pct)
        if price is not None:
            outcome, trade = account.fill(order, price, now)
            emit("order", note=outcome, direction=order.side, quantity=order.quantity, entry_price=price)
            if trade:
                emit("trade", **trade)
            account.pending = None
        elif order.kind == "MARKET":
            account.pending = None
    account.mark = bar.close
    equity = account.equity
    account.peak = max(account.peak, equity)
    emit("equity", equity=equity, drawdown_pct=(equity - account.peak) / account.peak if account.peak > 0 else 0.0)
    forced = account.pending is not None and account.pending.forced
    if account.side == SHORT and not forced:
        value = account.quantity * account.mark
        if value and equity / value < c.short_maintenance_margin:
            account.pending = Order(LONG, account.quantity, forced=True)
            emit("order", note="margin_call", direction=LONG, quantity=account.quantity)
    signal = decide(i, account)
    if signal is None or (account.pending is not None and account.pending.forced):
        return
    if account.side is None:
        quantity = sizer(account, bar.close)
    elif signal.side == OPPOSITE[account.side]:
        quantity = account.quantity
    else:
        return
    account.pending = Order(signal.side, quantity, signal.kind, signal.price)


EVENTS = (
    "run_id string, kind string, seq long, timestamp timestamp_ntz, equity double, drawdown_pct double, direction string, quantity long, entry_date timestamp_ntz, "
    "entry_price double, exit_date timestamp_ntz, exit_price double, pnl double, pnl_pct double, commission double, note string"
)
_KINDS = {"string": object, "long": "Int64", "double": float, "timestamp_ntz": "datetime64[us]"}
_COLUMNS = {name: _KINDS[kind] for name, kind in (c.split() for c in EVENTS.split(", "))}


def _typed(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows).reindex(columns=list(_COLUMNS)).astype(_COLUMNS)
    text = [c for c, kind in _COLUMNS.items() if kind is object]
    frame[text] = frame[text].where(frame[text].notna(), None)
    return frame


def fold(bars: pd.DataFrame, prepare: Callable, params: dict, config: Config, sizer: Callable, run_id: str) -> pd.DataFrame:
    """All events of one run. Times must increase; parameters the strategy refuses give one event of kind ``invalid``."""
    bars = bars.sort_values("timestamp", kind="stable").reset_index(drop=True)
    if bars["timestamp"].duplicated().any():
        raise ValueError(f"{run_id}: bars must have strictly increasing timestamps")
    rows: list[dict] = []

    def emit(kind: str, **fields) -> None:
        rows.append({"run_id": run_id, "kind": kind, "seq": len(rows), "timestamp": now, **fields})

    now = bars["timestamp"].iloc[0]
    try:
        decide = prepare(bars, params)
    except ValueError as e:
        emit("invalid", note=str(e))
        return _typed(rows)
    account = Account(config)
    for i, bar in enumerate(bars.itertuples(index=False)):
        now = bar.timestamp
        step(account, bar, i, decide, sizer, emit)
    if account.pending is not None:
        emit("order", note="cancelled_end_of_data", direction=account.pending.side, quantity=account.pending.quantity)
    return _typed(rows)


def run_backtests(
    bars: DataFrame, specs: DataFrame, config: Config = Config(), sizer: Callable | None = None, strategies: dict[str, Callable] | None = None, window: bool = False
) -> DataFrame:
    """Events of all runs of ``specs`` (``run_id, strategy, symbol, params map<string,double>``) over ``bars``.

    With ``window``, specs also have ``start`` and ``end`` (inclusive), and a run sees only the bars in between.
    Runs whose symbol has no bars give no events.
    """
    known, size = strategies or STRATEGIES, sizer or fixed_quantity()
    fields = ["timestamp", "open", "high", "low", "close", "adj_close"]
    joined = bars.select("symbol", *fields).join(specs, "symbol")
    if window:
        joined = joined.where(F.col("timestamp").between(F.col("start"), F.col("end")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return fold(rows[fields], known[first["strategy"]], dict(first["params"] or {}), config, size, first["run_id"])

    return joined.select("run_id", "strategy", "params", *fields).groupBy("run_id").applyInPandas(run, EVENTS)


def equity_points(events: DataFrame) -> DataFrame:
    """The equity curves, as the table ``equity_curve``."""
    return events.where("kind = 'equity'").select(F.col("seq").alias("id"), F.col("run_id").alias("backtest_id"), F.col("timestamp").alias("date"), "equity", "drawdown_pct")


def closed_trades(events: DataFrame) -> DataFrame:
    """The closed trades, as the table ``trades``. A position that is still open at the end is in the equity alone."""
    return events.where("kind = 'trade'").select(
        F.col("seq").alias("id"), F.col("run_id").alias("backtest_id"), "entry_date", "exit_date", "direction", "entry_price", "exit_price",
        F.col("quantity").cast("int").alias("quantity"), "pnl", "pnl_pct", "commission",
    )
