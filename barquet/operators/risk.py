"""The ten risk metrics of each run, over its equity curve and closed trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.schemas import METRIC_NAMES

PERIODS = 252
RISK_FREE = 0.04
LEAST_DEVIATION = 1e-10


def returns(equity: DataFrame) -> DataFrame:
    """``backtest_id, date, id, ret``: change over the point before; points after a zero equity have none."""
    w = Window.partitionBy("backtest_id").orderBy("date", "id")
    before = F.lag("equity").over(w)
    out = equity.withColumn("__before", before).where(F.col("__before") != 0)
    return out.select("backtest_id", "date", "id", ((F.col("equity") - F.col("__before")) / F.col("__before")).alias("ret"))


def _growth(ratio: Column, points: Column) -> Column:
    """Yearly growth; null where a loss beyond all capital has no real root."""
    return F.when(ratio >= 0, F.pow(ratio, F.lit(float(PERIODS)) / (points - 1)) - 1)


def curve_metrics(equity: DataFrame) -> DataFrame:
    """A row a run out of the equity curve alone, in one pass over each run's points in order.

    The first point is the first peak. Duration counts points since the peak was last reached.
    """
    w = Window.partitionBy("backtest_id").orderBy("date", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("equity").over(w)
    rows = equity.withColumns({"nth": F.row_number().over(w), "peak": F.max("equity").over(upto), "before": before})
    rows = rows.withColumns(
        {
            "ret": F.when(F.col("before") != 0, F.try_divide(F.col("equity") - F.col("before"), F.col("before"))),
            "drop": F.when(F.col("peak") > 0, F.try_divide(F.col("equity") - F.col("peak"), F.col("peak"))).otherwise(0.0),
            "under": F.col("nth") - F.max(F.when(F.col("equity") >= F.col("peak"), F.col("nth"))).over(upto),
        }
    )
    daily = RISK_FREE / PERIODS
    at = F.struct("date", "id")
    sums = rows.groupBy("backtest_id").agg(
        F.count("*").alias("points"),
        F.count("ret").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("deviation"),
        F.sqrt(F.avg(F.pow(F.least(F.col("ret") - daily, F.lit(0.0)), F.lit(2.0)))).alias("downside"),
        F.min("drop").alias("max_drawdown"),
        F.max("under").cast("double").alias("max_drawdown_duration"),
        F.min_by("equity", at).alias("first"),
        F.max_by("equity", at).alias("last"),
    )
    year = PERIODS**0.5
    over = lambda d: F.when((F.col("n") >= 2) & (F.col(d) >= LEAST_DEVIATION), F.try_divide(F.col("mean") - daily, F.col(d)) * year).otherwise(0.0)
    cagr = F.when((F.col("points") < 2) | (F.col("first") <= 0), 0.0).otherwise(_growth(F.try_divide(F.col("last"), F.col("first")), F.col("points")))
    grown = sums.withColumns({"sharpe_ratio": over("deviation"), "sortino_ratio": over("downside"), "cagr": cagr})
    calmar = F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.try_divide(F.col("cagr"), F.abs("max_drawdown")))
    return grown.withColumn("calmar_ratio", calmar).select(
        "backtest_id", "sharpe_ratio", "sortino_ratio", "cagr", "max_drawdown", "max_drawdown_duration", "calmar_ratio", F.col("last").alias("final_equity")
    )


def trade_metrics(trades: DataFrame) -> DataFrame:
    """A row a run out of its closed trades: a loss is a result below zero; without losses the profit factor is infinite."""
    closed = trades.where("exit_date is not null and exit_price is not null and pnl is not null")
    won, lost = F.col("won"), F.abs("lost")
    factor = F.when(F.col("n_lost") > 0, F.try_divide(won, lost)).when(won > 0, float("inf")).otherwise(0.0)
    sums = closed.groupBy("backtest_id").agg(
        F.count("*").cast("double").alias("total_trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("won"),
        F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)).alias("lost"),
        F.count_if(F.col("pnl") < 0).alias("n_lost"),
    )
    return sums.select("backtest_id", "total_trades", "win_rate", factor.alias("profit_factor"))


def risk_metrics(runs: DataFrame, trades: DataFrame, equity: DataFrame) -> DataFrame:
    """Wide form: ``backtest_id`` and the ten metrics. Runs without points or trades get 0 for what they lack."""
    ids = runs.select(F.col("id").alias("backtest_id"), "initial_capital")
    all_ = ids.join(curve_metrics(equity), "backtest_id", "left").join(trade_metrics(trades), "backtest_id", "left")
    final = F.coalesce("final_equity", "initial_capital")
    total = F.try_divide(final - F.col("initial_capital"), F.col("initial_capital"))
    zero = lambda c: F.when(F.col("final_equity").isNull(), F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)).alias(c)
    trade = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    made = {c: trade(c) if c in ("win_rate", "profit_factor", "total_trades") else zero(c) for c in METRIC_NAMES if c != "total_return"}
    return all_.select("backtest_id", *(made.get(c, total.alias(c)) for c in METRIC_NAMES))


def tall(wide: DataFrame) -> DataFrame:
    """Tall form: ``backtest_id, metric_name, metric_value``; metrics without a value give no row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in METRIC_NAMES)))
    return wide.select("backtest_id", pairs.alias("m")).select("backtest_id", "m.*").where("metric_value is not null")


def monthly_returns(equity: DataFrame) -> DataFrame:
    """``backtest_id, year`` and a column for each month: change of the month's last equity over that of the month before.

    A month without points has no value, and neither has the month after it; runs of under five points give no row.
    """
    month = F.make_date(F.year("date"), F.month("date"), F.lit(1))
    last = equity.groupBy("backtest_id", month.alias("month")).agg(F.max_by("equity", F.struct("date", "id")).alias("equity"), F.count("*").alias("n"))
    w = Window.partitionBy("backtest_id").orderBy("month")
    whole = Window.partitionBy("backtest_id")
    before = F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("equity").over(w))
    rows = last.withColumns({"points": F.sum("n").over(whole), "ret": F.try_divide(F.col("equity") - before, before)})
    names = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    cells = (F.max(F.when(F.month("month") == k + 1, F.col("ret"))).alias(n) for k, n in enumerate(names))
    return rows.where("points >= 5").groupBy("backtest_id", F.year("month").cast("long").alias("year")).agg(*cells)


def return_statistics(equity: DataFrame) -> DataFrame:
    """Mean, deviation, bias-corrected skewness and excess kurtosis of each run's returns; the mean compounded over a year, and
    the deviation of a year."""
    r = returns(equity).groupBy("backtest_id").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("deviation"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2")
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return r.select("backtest_id", "n", "mean", "deviation", skew.alias("skewness"), kurt.alias("excess_kurtosis"), (F.pow(1 + F.col("mean"), F.lit(float(PERIODS))) - 1).alias("annual_return"), (F.col("deviation") * PERIODS**0.5).alias("annual_volatility"))
