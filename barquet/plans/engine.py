"""Registered queries of the backtest engine: whole bar tables, every strategy with its defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.operators import backtest, research
from barquet.plans.runs import rounded
from barquet.schemas import METRIC_NAMES
from barquet.sources import market


def specs(bars: DataFrame, *strategies: str, params: dict[str, float] | None = None) -> DataFrame:
    """A run of each strategy, with its default parameters or ``params``, for every symbol."""
    names = F.explode(F.array(*map(F.lit, strategies or backtest.STRATEGIES)))
    rows = bars.select("symbol").distinct().withColumn("strategy", names)
    setting = F.create_map(*(F.lit(x) for kv in (params or {}).items() for x in kv)).cast("map<string,double>")
    return rows.select(F.concat_ws("|", "strategy", "symbol").alias("run_id"), "strategy", "symbol", setting.alias("params"))


def _events(spark: SparkSession, sf_dir: str, *strategies: str, sizer=None, params=None) -> tuple[DataFrame, DataFrame]:
    bars = market.bars(spark, sf_dir)
    runs = specs(bars, *strategies, params=params)
    return backtest.run_backtests(bars, runs, sizer=sizer), runs


def backtest_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten metrics of every strategy on every symbol."""
    events, runs = _events(spark, sf_dir)
    return rounded(research.metrics_of(events, runs, backtest.Config().initial_capital), *METRIC_NAMES)


def _trades(strategy: str, sizer=None, params=None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = backtest.closed_trades(_events(spark, sf_dir, strategy, sizer=sizer, params=params)[0]).withColumnRenamed("backtest_id", "run_id").drop("id")
        return rounded(out, "entry_price", "exit_price", "pnl", "pnl_pct", "commission")

    return query


def backtest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = backtest.equity_points(_events(spark, sf_dir)[0]).withColumnRenamed("backtest_id", "run_id").drop("id")
    return rounded(points, "equity", "drawdown_pct")


def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a year and a quarter, with the reference's 50 trials each."""
    out = research.walk_forward(market.bars(spark, sf_dir), "ma_crossover", in_sample=252, out_of_sample=63, step=63, trials=50, seed=42)
    params = F.concat_ws(",", *(F.col("params")[n].cast("int").cast("string") for n in ("fast_period", "slow_period")))
    return rounded(out.withColumn("params", params), "fitted_metric", "oos_sharpe", "scale")


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's breakout runs against the reference's 1000 permutations."""
    out = research.permutation_test(market.bars(spark, sf_dir), "breakout", {"lookback": 20.0}, permutations=1000, seed=42)
    return rounded(out, "actual", "p_value", "percentile")


QUERIES = {
    "backtest_comparison": backtest_comparison,
    "backtest_ma_crossover": _trades("ma_crossover"),
    "backtest_rsi": _trades("rsi_mean_reversion", params={"period": 7.0, "oversold": 40.0}),
    "backtest_breakout": _trades("breakout"),
    "backtest_kelly_sized": _trades("ma_crossover", backtest.kelly()),
    "backtest_equity": backtest_equity,
    "walk_forward_windows": walk_forward_windows,
    "permutation_test": permutation_test,
}

_SERIES = "PARTITION BY symbol ORDER BY timestamp"
#: One share a trade never runs out of cash, and crosses alternate: a trade is a cross up and the next cross down, each
#: filled at the open after it.
ORACLE_SQL = {
    "backtest_ma_crossover": f"""WITH {market.BARS_SQL},
m AS (
  SELECT *, row_number() OVER w AS nth, avg(adj_close) OVER (w ROWS 9 PRECEDING) > avg(adj_close) OVER (w ROWS 49 PRECEDING) AS above,
         lead(open) OVER w AS fill, lead(timestamp) OVER w AS fill_at FROM bars WINDOW w AS ({_SERIES})),
c AS (SELECT *, above AND NOT was AS up FROM (SELECT *, lag(above) OVER ({_SERIES}) AS was FROM m) WHERE nth > 50 AND above <> was),
k AS (SELECT *, sum(up::INTEGER) OVER ({_SERIES} ROWS UNBOUNDED PRECEDING) AS trade FROM c WHERE fill IS NOT NULL),
t AS (
  SELECT symbol, max(CASE WHEN up THEN fill_at END) AS entry_date, max(CASE WHEN NOT up THEN fill_at END) AS exit_date,
         max(CASE WHEN up THEN fill END) * (1 + 0.0005::DOUBLE) AS a, max(CASE WHEN NOT up THEN fill END) * (1 - 0.0005::DOUBLE) AS b
  FROM k WHERE trade > 0 GROUP BY symbol, trade HAVING count(*) = 2),
f AS (SELECT *, (a + b) * 0.001::DOUBLE AS fee FROM t)
SELECT 'ma_crossover|' || symbol AS run_id, entry_date, exit_date, 'LONG' AS direction, round(a, 6) AS entry_price, round(b, 6) AS exit_price, 1::INTEGER AS quantity,
  round(b - a - fee, 6) + 0 AS pnl, round((b - a - fee) / a, 6) + 0 AS pnl_pct, round(fee, 6) AS commission FROM f""",
}
