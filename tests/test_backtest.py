"""The fold against its rules, worked out in plain loops over random walks."""

import datetime as dt
import random

import pandas as pd
import pytest

from barquet.operators import backtest as B
from barquet.plans import engine

FREE = B.Config(initial_capital=1000.0, commission_pct=0.0, slippage_pct=0.0)


def frame(*rows):
    day = dt.datetime(2022, 5, 2)
    made = [(day + dt.timedelta(i), *r, r[3]) for i, r in enumerate(rows)]
    return pd.DataFrame(made, columns=["timestamp", "open", "high", "low", "close", "adj_close"]).astype({c: float for c in ("open", "high", "low", "close", "adj_close")})


def scripted(**signals):
    """A strategy that sends the signal of a bar, by its number."""
    return lambda bars, params: lambda i, account: signals.get(f"on{i}")


def fold(bars, config=B.Config(), sizer=None, **signals):
    out = B.fold(bars, scripted(**signals), {}, config, sizer or B.fixed_quantity(), "r")
    return out[out.kind == "trade"], out[out.kind == "equity"], out


def at(bars, i):
    return bars["timestamp"].iloc[i]


def walk(seed, n=30):
    """Bars of a random walk, as (open, high, low, close)."""
    rng, price, rows = random.Random(seed), 37.0, []
    for _ in range(n):
        begin, end = price * (1 + rng.uniform(-0.03, 0.03)), price * (1 + rng.uniform(-0.05, 0.05))
        rows.append((begin, max(begin, end) * 1.01, min(begin, end) * 0.985, end))
        price = end
    return rows


SLIP = B.Config().slippage_pct


@pytest.mark.parametrize("seed", range(5))
def test_market_orders_fill_at_the_next_open(seed):
    rows = walk(seed)
    bars, i, j = frame(*rows), 2 + seed, 11 + 3 * seed
    trades, _, _ = fold(bars, B.Config(), B.fixed_quantity(7), **{f"on{i}": B.Signal("LONG"), f"on{j}": B.Signal("SHORT")})
    t = trades.iloc[0]
    assert (t.entry_date, t.exit_date) == (at(bars, i + 1), at(bars, j + 1))
    assert t.entry_price == pytest.approx(rows[i + 1][0] * (1 + SLIP)) and t.exit_price == pytest.approx(rows[j + 1][0] * (1 - SLIP))


@pytest.mark.parametrize("share", [0.999, 0.98, 0.95, 0.9])
@pytest.mark.parametrize("kind", ["LIMIT", "STOP"])
@pytest.mark.parametrize("seed", range(4))
def test_orders_with_a_price_wait_for_it(seed, kind, share):
    """A buying limit below, or a buying stop above the market, fills on the first bar that reaches it, or never."""
    rows = walk(10 + seed, 60)
    bars, price = frame(*rows), rows[1][3] * (share if kind == "LIMIT" else 2 - share)
    reach = [k for k in range(2, 60) if (rows[k][2] <= price if kind == "LIMIT" else rows[k][1] >= price)]
    _, _, out = fold(bars, on1=B.Signal("LONG", kind, price), on58=B.Signal("SHORT"))
    trades = out[out.kind == "trade"]
    if not reach or reach[0] > 58:
        assert len(trades) == 0 or trades.iloc[0].entry_date == at(bars, 59)
        return
    first = rows[reach[0]][0]
    want = (min(price, first * (1 + SLIP)) if first <= price else price) if kind == "LIMIT" else max(first, price) * (1 + SLIP)
    assert trades.iloc[0].entry_date == at(bars, reach[0]) and trades.iloc[0].entry_price == pytest.approx(want)


@pytest.mark.parametrize("seed", range(3))
def test_borrowing_costs_the_mark_before(seed):
    rows, q, rate = walk(20 + seed, 12), 3, 0.21
    config = B.Config(initial_capital=7_000.0, commission_pct=0.0, slippage_pct=0.0, annual_short_borrow_rate=rate)
    _, equity, _ = fold(frame(*rows), config, B.fixed_quantity(q), on0=B.Signal("SHORT"))
    paid = sum(q * rows[k - 1][3] * rate / 365 for k in range(2, 12))
    assert equity.equity.iloc[-1] == pytest.approx(7_000 + q * (rows[1][0] - rows[-1][3]) - paid)


def test_a_short_that_loses_its_margin_is_covered_on_the_next_bar():
    config = B.Config(initial_capital=500.0, commission_pct=0.0, slippage_pct=0.0, annual_short_borrow_rate=0.0)
    calm, jump, after = (40, 42, 39, 41), (41, 310, 40, 300), (280, 320, 270, 290)  # two shares: 500 + 2 (40 - 300) is less than nothing
    bars = frame(calm, calm, jump, after, after)
    trades, _, _ = fold(bars, config, B.fixed_quantity(2), on0=B.Signal("SHORT"))
    assert [(t.exit_date, t.exit_price) for t in trades.itertuples()] == [(at(bars, 3), 280)]
    assert len(fold(bars.iloc[:3], config, B.fixed_quantity(2), on0=B.Signal("SHORT"))[0]) == 0
    assert len(fold(frame(calm, calm, (41, 60, 40, 55), after), config, B.fixed_quantity(2), on0=B.Signal("SHORT"))[0]) == 0


@pytest.mark.parametrize("capital, q, price, back, rate, margin", [(6_200.0, 4, 250.0, 231.5, 0.002, 1.5), (900.0, 3, 12.5, 14.0, 0.0, 1.25), (50_000.0, 75, 88.0, 61.25, 0.0007, 2.0)])
def test_short_accounting(capital, q, price, back, rate, margin):
    """The proceeds and the margin beyond them are put aside; what it costs to open and close is lost."""
    a = B.Account(B.Config(initial_capital=capital, commission_pct=rate, short_initial_margin=margin))
    worth, cost = q * price, q * price * rate
    assert a.fill(B.Order("SHORT", q), price, pd.Timestamp("2022-05-03"))[0] == "opened"
    assert (a.cash, a.collateral, a.equity) == pytest.approx((capital - (margin - 1) * worth - cost, margin * worth, capital - cost))
    a.mark = 1.3 * price
    assert a.equity == pytest.approx(capital - cost - 0.3 * worth)
    _, trade = a.fill(B.Order("LONG", q), back, pd.Timestamp("2022-05-09"))
    assert trade["pnl"] == pytest.approx(q * (price - back) - cost - q * back * rate) and a.collateral == 0


def test_order_that_costs_too_much_is_rejected():
    bars = frame((100, 100, 100, 100), (100, 100, 100, 100))
    trades, equity, all_ = fold(bars, FREE, B.fixed_quantity(11), on0=B.Signal("LONG"))
    assert "rejected" in set(all_.note.dropna()) and equity.equity.iloc[-1] == 1000


def test_pending_order_ends_with_the_data():
    bars = frame((100, 100, 100, 100), (100, 100, 100, 100))
    trades, _, all_ = fold(bars, FREE, on1=B.Signal("LONG"))
    assert len(trades) == 0 and all_.note.iloc[-1] == "cancelled_end_of_data"


@pytest.mark.parametrize("period", [2, 5, 14])
def test_rsi_equals_the_recursion(period):
    prices = [r[3] for r in walk(31, 80)]
    ups, downs = ([max(s * (y - x), 0) for x, y in zip(prices, prices[1:], strict=False)] for s in (1, -1))
    gain, loss, want = sum(ups[:period]) / period, sum(downs[:period]) / period, []
    for k in range(period - 1, len(ups)):
        if k >= period:
            gain, loss = (gain * (period - 1) + ups[k]) / period, (loss * (period - 1) + downs[k]) / period
        want.append(100 * gain / (gain + loss))
    assert B.wilder_rsi(pd.Series(prices).to_numpy(), period)[period:] == pytest.approx(want)


def test_kelly_falls_back_and_caps():
    a = B.Account(B.Config(initial_capital=10_000.0))
    size = B.kelly(lookback=4)
    assert size(a, 10.0) == 20
    a.results = [30.0, 30.0, 30.0, -10.0]
    assert size(a, 10.0) == 250
    a.results = [10.0, -10.0, -10.0, 0.0]
    assert size(a, 10.0) == 1
    a.results = [10.0] * 4
    assert size(a, 10.0) == 20


def test_times_must_increase():
    bars = pd.concat([frame((1, 1, 1, 1))] * 2)
    with pytest.raises(ValueError):
        fold(bars)


@pytest.mark.parametrize("bad", [{"initial_capital": 0}, {"short_initial_margin": 0.9}, {"commission_pct": -1}, {"borrow_day_count": float("nan")}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        B.Config(**bad)


def test_refused_parameters_give_no_curve(spark):
    bars = spark.createDataFrame(frame((1, 1, 1, 1), (2, 2, 2, 2)).assign(symbol="A"))
    specs = spark.createDataFrame([("a", "ma_crossover", "A", {"fast_period": 9.0, "slow_period": 3.0})], "run_id string, strategy string, symbol string, params map<string,double>")
    assert [r.kind for r in B.run_backtests(bars, specs).collect()] == ["invalid"]


@pytest.mark.parametrize(("query", "operator", "setting", "number"), [("walk_forward_windows", "walk_forward", "trials", 50), ("permutation_test", "permutation_test", "permutations", 1000)])
def test_registered_with_the_defaults_of_the_reference(monkeypatch, query, operator, setting, number):
    class Called(Exception):
        pass

    def record(*_, **settings):
        raise Called(settings[setting])

    monkeypatch.setattr(engine.research, operator, record)
    monkeypatch.setattr(engine.market, "bars", lambda *_: None)
    with pytest.raises(Called) as got:
        engine.QUERIES[query](None, "")
    assert got.value.args == (number,)
