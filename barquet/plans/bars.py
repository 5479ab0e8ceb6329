"""Registered queries over bars and over the equity curve, whole, with DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.functions import fills, indicators
from barquet.operators import adjustments, quality, risk
from barquet.plans.runs import rounded
from barquet.schemas import METRIC_NAMES
from barquet.session import table
from barquet.sources import calendars, market

SLIPPAGE = 0.0005


def native_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a careless provider sends them: some wrong, some twice, some twice and different."""
    b, hour = market.bars(spark, sf_dir), F.hour("timestamp")
    wrong = b.withColumns(
        {
            "low": F.when(hour == 3, F.col("high") + 1).otherwise(F.col("low")),
            "volume": F.when(hour == 5, -1.0).otherwise(F.col("volume")),
            "close": F.when(hour == 9, float("nan")).otherwise(F.col("close")),
            "split_coefficient": F.when(hour == 13, 0.0).otherwise(F.col("split_coefficient")),
            "dividend_amount": F.when(hour == 13, -0.1).otherwise(F.col("dividend_amount")),
        }
    )
    twice = wrong.where(hour % 7 == 0)
    return wrong.unionByName(twice).unionByName(wrong.where(hour == 11).withColumn("volume", F.col("volume") + 1))


def cached_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an older fetch: without some days, and with other closes at noon."""
    b = market.bars(spark, sf_dir).where(F.dayofmonth("timestamp") % 5 != F.length("symbol") % 5)
    return b.withColumns({"close": F.when(F.hour("timestamp") == 12, F.col("close") + 0.5).otherwise(F.col("close")), "source": F.when(F.dayofmonth("timestamp") < 15, "first").otherwise("second")})


def sessions(spark: SparkSession) -> DataFrame:
    return calendars.sessions(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 30))


def _bars(f):
    return lambda spark, sf_dir: f(market.bars(spark, sf_dir))


def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counters(native_bars(spark, sf_dir))


def bar_quality_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rejections(native_bars(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


def bar_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(native_bars(spark, sf_dir))


def bars_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted(native_bars(spark, sf_dir))


def missing_session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {c: F.col(c).cast("string") for c in ("first", "last")}
    return quality.missing_groups(cached_bars(spark, sf_dir), sessions(spark)).withColumns(text)


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.verdicts(quality.coverage(cached_bars(spark, sf_dir), sessions(spark))), "coverage")


def merge_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = market.bars(spark, sf_dir).where(F.dayofmonth("timestamp") >= 10)
    return quality.merge_keep_last(cached_bars(spark, sf_dir), fresh)


def cached_vs_refreshed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compare(cached_bars(spark, sf_dir), market.bars(spark, sf_dir))


def lineage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.lineage_segments(cached_bars(spark, sf_dir))


def range_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5)), (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 9, 12))], "start timestamp_ntz, end timestamp_ntz")
    return quality.in_ranges(market.bars(spark, sf_dir), ranges).select("symbol", "timestamp", "close")


def _actions(spark: SparkSession, column: str, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, f"symbol string, ex_date date, {column} double")


def split_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _actions(spark, "factor", [("click", dt.date(2024, 1, 10), 2.0), ("view", dt.date(2024, 1, 12), 4.0), ("view", dt.date(2024, 1, 20), 2.0)])
    return rounded(adjustments.adjust_for_splits(market.bars(spark, sf_dir), splits).select("symbol", "timestamp", "open", "close", "volume"), "open", "close", "volume")


def dividend_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = _actions(spark, "amount", [("click", dt.date(2024, 1, 10), 0.5), ("view", dt.date(2024, 1, 12), 1.25), ("view", dt.date(2024, 1, 20), 2.0)])
    return rounded(adjustments.adjust_for_dividends(market.bars(spark, sf_dir), paid).select("symbol", "timestamp", "open", "close"), "open", "close")


def price_gap_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjustments.price_gaps(market.bars(spark, sf_dir)), "change")


def sma_crossover_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of whole cents, so that the crossings are the same in any engine."""
    cents = market.bars(spark, sf_dir).withColumn("cents", F.floor(F.col("adj_close") * 100 + 0.5))
    w = lambda k: F.sum("cents").over(indicators._order().rowsBetween(1 - k, 0))
    exact = cents.withColumns({"adj_close": F.col("cents").cast("double")})
    out = indicators.ma_cross(exact, 10, 50).withColumns({"fast_sma": w(10) / 10.0, "slow_sma": w(50) / 50.0})
    return out.where("cross <> 0").select("symbol", "timestamp", "cross", F.round("fast_sma", 4).alias("fast_sma"), F.round("slow_sma", 4).alias("slow_sma"))


def donchian_breakout_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.channel_break(market.bars(spark, sf_dir))
    return out.where(F.col("break") != 0).select("symbol", "timestamp", "close", "prior_high", "prior_low", "break")


def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.rsi(market.bars(spark, sf_dir)).select("symbol", "timestamp", "rsi"), "rsi")


def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.bars(spark, sf_dir).select("symbol", "timestamp", indicators.log_return().alias("log_return")), "log_return")


def fill_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as the one on which a buy and a sell order of each kind meet it; limits and stops stand at whole prices."""
    both = market.bars(spark, sf_dir).withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    at, side = F.floor((F.col("low") + F.col("high")) / 2).cast("double"), F.col("side")
    made = {"market_fill": fills.market(side, SLIPPAGE), "limit_fill": fills.limit(side, at, SLIPPAGE), "stop_fill": fills.stop(side, at, SLIPPAGE)}
    out = both.select("symbol", "timestamp", "side", at.alias("order_price"), *(v.alias(k) for k, v in made.items()))
    return rounded(out.withColumn("commission", fills.commission(F.col("market_fill"), F.lit(10), 0.001)), *made, "commission", digits=9)


def equity_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.returns(market.equity_curve(spark, sf_dir)), "ret")


def risk_metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market.run_tables(spark, sf_dir)
    return rounded(risk.risk_metrics(t["backtest_runs"], t["trades"], t["equity_curve"]), *METRIC_NAMES)


def risk_metrics_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.tall(risk_metrics_wide(spark, sf_dir))


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs have points in one month only, so events are laid over the year, twelve days for each of theirs."""
    e = market.equity_curve(spark, sf_dir)
    spread = e.withColumn("date", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(12 * datediff(date, date'2024-01-01'))"))
    out = risk.monthly_returns(spread)
    return rounded(out, *(c for c in out.columns if c not in ("backtest_id", "year")))


def return_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.return_statistics(market.equity_curve(spark, sf_dir))
    return rounded(out, *out.columns[2:], digits=5)


def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and nearest-rank 95th percentile, as timings are reported."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95")
    )


QUERIES = {
    "bars_ohlcv": _bars(lambda b: b),
    **{
        f.__name__: f
        for f in (
            bar_quality_rejections, bar_duplicates, quality_counters, bars_accepted, missing_session_groups, coverage_summary, merge_keep_last,
            cached_vs_refreshed_diff, lineage_segments, range_selection, split_adjust, dividend_adjust, price_gap_warnings, sma_crossover_signals,
            donchian_breakout_signals, rsi_wilder, log_returns, fill_prices, equity_returns, risk_metrics_wide, risk_metrics_tall, monthly_returns,
            return_statistics, value_quantiles,
        )
    },
}

_BARS = "WITH " + market.BARS_SQL
_NATIVE = f"""{_BARS},
wrong AS (
  SELECT * REPLACE (CASE WHEN hour(timestamp) = 3 THEN high + 1 ELSE low END AS low, CASE WHEN hour(timestamp) = 5 THEN -1 ELSE volume END AS volume,
                    CASE WHEN hour(timestamp) = 9 THEN 'nan'::DOUBLE ELSE close END AS close, CASE WHEN hour(timestamp) = 13 THEN 0 ELSE split_coefficient END AS split_coefficient,
                    CASE WHEN hour(timestamp) = 13 THEN -0.1::DOUBLE ELSE dividend_amount END AS dividend_amount) FROM bars),
native AS (
  SELECT * FROM wrong UNION ALL SELECT * FROM wrong WHERE hour(timestamp) % 7 = 0
  UNION ALL SELECT * REPLACE (volume + 1 AS volume) FROM wrong WHERE hour(timestamp) = 11),
judged AS (
  SELECT *, list_filter([
      CASE WHEN NOT isfinite(close) THEN 'close_not_finite_numeric' END,
      CASE WHEN open <= 0 THEN 'open_not_positive' END, CASE WHEN high <= 0 THEN 'high_not_positive' END, CASE WHEN low <= 0 THEN 'low_not_positive' END,
      CASE WHEN isfinite(close) AND close <= 0 THEN 'close_not_positive' END, CASE WHEN adj_close <= 0 THEN 'adj_close_not_positive' END,
      CASE WHEN volume < 0 THEN 'volume_negative' END, CASE WHEN dividend_amount < 0 THEN 'dividend_amount_negative' END,
      CASE WHEN split_coefficient <= 0 THEN 'split_coefficient_not_positive' END,
      CASE WHEN isfinite(close) AND high < greatest(open, close) THEN 'high_below_open_or_close' END,
      CASE WHEN isfinite(close) AND low > least(open, close) THEN 'low_above_open_or_close' END], lambda x: x IS NOT NULL) AS reasons
  FROM native)"""
_VALUES = "row(open, high, low, close, volume, adj_close, dividend_amount, split_coefficient)"
_CACHED = f"""{_BARS},
cached AS (
  SELECT * REPLACE (CASE WHEN hour(timestamp) = 12 THEN close + 0.5 ELSE close END AS close, CASE WHEN day(timestamp) < 15 THEN 'first' ELSE 'second' END AS source)
  FROM bars WHERE day(timestamp) % 5 <> length(symbol) % 5)"""
_SESSIONS = f"""{_CACHED},
sessions AS (
  SELECT d::DATE AS session, row_number() OVER (ORDER BY d) AS nth FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d)
  WHERE isodow(d) < 6 AND d NOT IN (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-15')),
grid AS (SELECT symbol, session, nth FROM (SELECT DISTINCT symbol FROM cached), sessions),
days AS (SELECT DISTINCT symbol, timestamp::DATE AS session FROM cached),
lost AS (SELECT *, nth - row_number() OVER (PARTITION BY symbol ORDER BY nth) AS island FROM grid WHERE (symbol, session) NOT IN (SELECT (symbol, session) FROM days)),
gaps AS (SELECT symbol, min(session) AS first, max(session) AS last, count(*) AS sessions FROM lost GROUP BY symbol, island)"""
_EQUITY = "WITH " + market.RUNS_SQL
_SERIES = "PARTITION BY symbol ORDER BY timestamp"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_RISK = f"""{_EQUITY},
p AS (
  SELECT *, row_number() OVER w AS nth, max(equity) OVER (w ROWS UNBOUNDED PRECEDING) AS peak, lag(equity) OVER w AS before
  FROM equity_curve WINDOW w AS (PARTITION BY backtest_id ORDER BY date, id)),
q AS (SELECT *, (equity - before) / before AS ret, nth - max(CASE WHEN equity >= peak THEN nth END) OVER (PARTITION BY backtest_id ORDER BY date, id ROWS UNBOUNDED PRECEDING) AS under FROM p),
c AS (
  SELECT backtest_id, count(*) AS points, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, sqrt(avg(pow(least(ret - 0.04::DOUBLE / 252, 0), 2))) AS down,
         min((equity - peak) / peak) AS mdd, max(under)::DOUBLE AS mdur, arg_min(equity, nth) AS first, arg_max(equity, nth) AS last
  FROM q GROUP BY backtest_id),
t AS (
  SELECT backtest_id, count(*)::DOUBLE AS total_trades, avg((pnl > 0)::INTEGER) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won,
         -sum(pnl) FILTER (pnl < 0) AS lost
  FROM trades WHERE exit_date IS NOT NULL GROUP BY backtest_id),
x AS (
  SELECT c.*, r.initial_capital, t.* EXCLUDE backtest_id, CASE WHEN points < 2 THEN 0 ELSE pow(last / first, 252.0::DOUBLE / (points - 1)) - 1 END AS g
  FROM backtest_runs r JOIN c ON c.backtest_id = r.id LEFT JOIN t ON t.backtest_id = r.id),
wide AS (
  SELECT backtest_id,
    round(CASE WHEN n >= 2 AND sd >= 1e-10::DOUBLE THEN (m - 0.04::DOUBLE / 252) / sd * sqrt(252) ELSE 0 END, 6) + 0 AS sharpe_ratio,
    round(CASE WHEN n >= 2 AND down >= 1e-10::DOUBLE THEN (m - 0.04::DOUBLE / 252) / down * sqrt(252) ELSE 0 END, 6) + 0 AS sortino_ratio,
    round(g, 6) + 0 AS cagr, round(mdd, 6) + 0 AS max_drawdown, mdur AS max_drawdown_duration, round(coalesce(win_rate, 0), 6) AS win_rate,
    round(CASE WHEN lost IS NOT NULL THEN won / lost WHEN won > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor,
    round(CASE WHEN mdd = 0 THEN 0 ELSE g / abs(mdd) END, 6) + 0 AS calmar_ratio, coalesce(total_trades, 0) AS total_trades,
    round((last - initial_capital) / initial_capital, 6) + 0 AS total_return
  FROM x)"""

ORACLE_SQL = {
    "bars_ohlcv": f"{_BARS} SELECT * FROM bars",
    "bar_quality_rejections": f"{_NATIVE} SELECT symbol, timestamp, array_to_string(reasons, ',') AS reasons FROM judged WHERE len(reasons) > 0",
    "bar_duplicates": f"{_NATIVE} SELECT symbol, timestamp, count(*) AS row_count, count(DISTINCT {_VALUES}) > 1 AS is_conflict FROM native GROUP BY ALL HAVING count(*) > 1",
    "quality_counters": f"""{_NATIVE},
g AS (SELECT symbol, timestamp, count(*) AS n, count(DISTINCT {_VALUES}) AS k FROM judged WHERE len(reasons) = 0 GROUP BY ALL),
k AS (SELECT symbol, count(*) FILTER (k = 1) AS accepted, coalesce(sum(n - 1) FILTER (k = 1), 0)::BIGINT AS duplicate, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS conflicting FROM g GROUP BY symbol)
SELECT symbol, count(*) AS received, count(*) FILTER (len(reasons) > 0) AS rejected, any_value(accepted) AS accepted, any_value(duplicate) AS duplicate, any_value(conflicting) AS conflicting
FROM judged JOIN k USING (symbol) GROUP BY symbol""",
    "bars_accepted": f"""{_NATIVE},
g AS (SELECT DISTINCT * EXCLUDE reasons FROM judged WHERE len(reasons) = 0)
SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY symbol, timestamp) = 1""",
    "missing_session_groups": f"{_SESSIONS} SELECT symbol, first::VARCHAR AS first, last::VARCHAR AS last, sessions FROM gaps",
    "coverage_summary": f"""{_SESSIONS},
s AS (SELECT g.symbol, count(*) AS expected, count(d.session) AS observed FROM grid g LEFT JOIN days d ON d.symbol = g.symbol AND d.session = g.session GROUP BY g.symbol),
l AS (SELECT symbol, max(sessions) AS longest_gap FROM gaps GROUP BY symbol),
v AS (SELECT s.*, round(observed::DOUBLE / expected, 6) AS coverage, observed::DOUBLE / expected AS c, coalesce(longest_gap, 0) AS longest_gap FROM s LEFT JOIN l USING (symbol))
SELECT * EXCLUDE c, CASE WHEN c < 0.98 OR longest_gap > 2 THEN 'FATAL' WHEN longest_gap > 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM v""",
    "merge_keep_last": f"""{_CACHED}
SELECT * FROM bars WHERE day(timestamp) >= 10 UNION ALL SELECT * FROM cached WHERE day(timestamp) < 10""",
    "cached_vs_refreshed_diff": f"""{_CACHED},
names AS (SELECT unnest(['open', 'high', 'low', 'close', 'volume', 'adj_close', 'dividend_amount', 'split_coefficient']) AS field),
pick AS (
  SELECT b.symbol, b.timestamp, n.field, c.symbol IS NULL AS fresh,
         CASE n.field WHEN 'open' THEN c.open WHEN 'high' THEN c.high WHEN 'low' THEN c.low WHEN 'close' THEN c.close WHEN 'volume' THEN c.volume
              WHEN 'adj_close' THEN c.adj_close WHEN 'dividend_amount' THEN c.dividend_amount ELSE c.split_coefficient END AS cached,
         CASE n.field WHEN 'open' THEN b.open WHEN 'high' THEN b.high WHEN 'low' THEN b.low WHEN 'close' THEN b.close WHEN 'volume' THEN b.volume
              WHEN 'adj_close' THEN b.adj_close WHEN 'dividend_amount' THEN b.dividend_amount ELSE b.split_coefficient END AS refreshed
  FROM bars b CROSS JOIN names n LEFT JOIN cached c ON c.symbol = b.symbol AND c.timestamp = b.timestamp)
SELECT symbol, timestamp, field, cached, refreshed FROM pick WHERE fresh OR abs(cached - refreshed) > greatest(1e-9 * greatest(abs(cached), abs(refreshed)), 1e-12)""",
    "lineage_segments": f"""{_CACHED},
f AS (SELECT *, CASE WHEN source IS DISTINCT FROM lag(source) OVER w THEN 1 ELSE 0 END AS fresh FROM cached WINDOW w AS ({_SERIES})),
n AS (SELECT *, sum(fresh) OVER ({_SERIES} ROWS UNBOUNDED PRECEDING) AS nth FROM f)
SELECT symbol, source, min(timestamp) AS "start", max(timestamp) AS "end", count(*) AS bars FROM n GROUP BY symbol, source, nth""",
    "range_selection": f"""{_BARS} SELECT symbol, timestamp, close FROM bars
WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' OR timestamp BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-09 12:00:00'""",
    "split_adjust": f"""{_BARS},
f AS (SELECT *, CASE WHEN symbol = 'click' AND timestamp < TIMESTAMP '2024-01-10' THEN 2 WHEN symbol = 'view' AND timestamp < TIMESTAMP '2024-01-12' THEN 8
                     WHEN symbol = 'view' AND timestamp < TIMESTAMP '2024-01-20' THEN 2 ELSE 1 END AS f FROM bars)
SELECT symbol, timestamp, round(open / f, 6) AS open, round(close / f, 6) AS close, round(volume * f, 6) AS volume FROM f""",
    "dividend_adjust": f"""{_BARS},
paid AS (SELECT * FROM (VALUES ('click', TIMESTAMP '2024-01-10', 0.5::DOUBLE), ('view', TIMESTAMP '2024-01-12', 1.25::DOUBLE), ('view', TIMESTAMP '2024-01-20', 2.0::DOUBLE)) v(symbol, ex, amount)),
r AS (SELECT p.symbol, p.ex, (arg_min(close, timestamp) FILTER (timestamp >= ex) - any_value(amount)) / arg_min(close, timestamp) FILTER (timestamp >= ex) AS f FROM paid p JOIN bars b ON b.symbol = p.symbol GROUP BY p.symbol, p.ex),
k AS (SELECT b.*, coalesce((SELECT product(f) FROM r WHERE r.symbol = b.symbol AND r.ex > b.timestamp), 1) AS f FROM bars b)
SELECT symbol, timestamp, round(open * f, 6) AS open, round(close * f, 6) AS close FROM k""",
    "price_gap_warnings": f"""{_BARS},
c AS (SELECT symbol, timestamp, close / lag(close) OVER ({_SERIES}) - 1 AS change FROM bars) SELECT symbol, timestamp, round(change, 6) + 0 AS change FROM c WHERE abs(change) > 0.2""",
    "sma_crossover_signals": f"""{_BARS},
c AS (SELECT symbol, timestamp, floor(adj_close * 100 + 0.5)::BIGINT AS cents, row_number() OVER ({_SERIES}) AS nth FROM bars),
m AS (
  SELECT *, sum(cents) OVER ({_SERIES} ROWS 9 PRECEDING) AS f, sum(cents) OVER ({_SERIES} ROWS 49 PRECEDING) AS s FROM c),
a AS (SELECT *, f * 5 > s AS above, lag(f * 5 > s) OVER ({_SERIES}) AS was FROM m)
SELECT symbol, timestamp, CASE WHEN above THEN 1 ELSE -1 END::INTEGER AS "cross", round(f::DOUBLE / 10, 4) AS fast_sma, round(s::DOUBLE / 50, 4) AS slow_sma
FROM a WHERE nth > 50 AND above <> was""",
    "donchian_breakout_signals": f"""{_BARS},
c AS (
  SELECT symbol, timestamp, close, row_number() OVER ({_SERIES}) AS nth, max(high) OVER ({_SERIES} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high,
         min(low) OVER ({_SERIES} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_low FROM bars)
SELECT symbol, timestamp, close, prior_high, prior_low, CASE WHEN close > prior_high THEN 1 ELSE -1 END::INTEGER AS "break"
FROM c WHERE nth > 20 AND (close > prior_high OR close < prior_low)""",
    "rsi_wilder": f"""WITH RECURSIVE {market.BARS_SQL},
d AS (SELECT symbol, timestamp, row_number() OVER ({_SERIES}) AS nth, adj_close - lag(adj_close) OVER ({_SERIES}) AS move FROM bars),
seed AS (SELECT symbol, avg(greatest(move, 0)) AS g, avg(greatest(-move, 0)) AS l FROM d WHERE nth BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
r AS (
  SELECT symbol, 15::BIGINT AS nth, g, l FROM seed
  UNION ALL SELECT d.symbol, d.nth, (r.g * 13 + greatest(d.move, 0)) / 14, (r.l * 13 + greatest(-d.move, 0)) / 14 FROM r JOIN d ON d.symbol = r.symbol AND d.nth = r.nth + 1)
SELECT d.symbol, d.timestamp, round(CASE WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END, 6) AS rsi FROM d LEFT JOIN r ON r.symbol = d.symbol AND r.nth = d.nth""",
    "log_returns": f"{_BARS}, b AS (SELECT *, lag(adj_close) OVER ({_SERIES}) AS was FROM bars) SELECT symbol, timestamp, round(CASE WHEN adj_close > 0 AND was > 0 THEN ln(adj_close / was) END, 6) + 0 AS log_return FROM b",
    "fill_prices": f"""{_BARS},
o AS (SELECT *, floor((low + high) / 2)::DOUBLE AS p, CASE WHEN side = 'LONG' THEN 1 + 0.0005::DOUBLE ELSE 1 - 0.0005::DOUBLE END AS s FROM bars, (VALUES ('LONG'), ('SHORT')) v(side))
SELECT symbol, timestamp, side, p AS order_price, round(open * s, 9) AS market_fill,
  round(CASE WHEN side = 'LONG' THEN CASE WHEN open <= p THEN least(p, open * s) WHEN low <= p THEN p END ELSE CASE WHEN open >= p THEN greatest(p, open * s) WHEN high >= p THEN p END END, 9) AS limit_fill,
  round(CASE WHEN side = 'LONG' THEN CASE WHEN open >= p THEN open WHEN high >= p THEN p END ELSE CASE WHEN open <= p THEN open WHEN low <= p THEN p END END * s, 9) AS stop_fill,
  round(open * s * 10 * 0.001::DOUBLE, 9) AS commission
FROM o""",
    "equity_returns": f"""{_EQUITY},
b AS (SELECT *, lag(equity) OVER (PARTITION BY backtest_id ORDER BY date, id) AS was FROM equity_curve) SELECT backtest_id, date, id, round((equity - was) / was, 6) + 0 AS ret FROM b WHERE was <> 0""",
    "risk_metrics_wide": f"{_RISK} SELECT * FROM wide",
    "risk_metrics_tall": f"{_RISK} SELECT backtest_id, metric_name, metric_value FROM (" + " UNION ALL ".join(f"SELECT backtest_id, '{n}' AS metric_name, {n}::DOUBLE AS metric_value FROM wide" for n in METRIC_NAMES) + ") WHERE metric_value IS NOT NULL",
    "monthly_returns": f"""{_EQUITY},
s AS (SELECT backtest_id, id, equity, TIMESTAMP '2024-01-01' + to_days((12 * (date::DATE - DATE '2024-01-01'))::INTEGER) AS date FROM equity_curve),
l AS (SELECT backtest_id, date_trunc('month', date)::DATE AS m, arg_max(equity, row(date, id)) AS equity, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY backtest_id) AS points, lag(equity) OVER w AS was, lag(m) OVER w AS m0 FROM l WINDOW w AS (PARTITION BY backtest_id ORDER BY m)),
r AS (SELECT *, CASE WHEN m0 = (m - INTERVAL 1 MONTH)::DATE THEN (equity - was) / was END AS ret FROM b)
SELECT backtest_id, year(m)::BIGINT AS year, {', '.join(f'round(max(CASE WHEN month(m) = {k + 1} THEN ret END), 6) + 0 AS {n}' for k, n in enumerate(_MONTHS))} FROM r WHERE points >= 5 GROUP BY backtest_id, year(m)""",
    "return_statistics": f"""{_EQUITY},
b AS (SELECT *, lag(equity) OVER (PARTITION BY backtest_id ORDER BY date, id) AS was FROM equity_curve),
r AS (SELECT backtest_id, (equity - was) / was AS ret FROM b WHERE was <> 0)
SELECT backtest_id, count(*) AS n, round(avg(ret), 5) + 0 AS mean, round(stddev_samp(ret), 5) AS deviation, round(skewness(ret), 5) + 0 AS skewness, round(kurtosis(ret), 5) + 0 AS excess_kurtosis,
  round(pow(1 + avg(ret), 252) - 1, 5) + 0 AS annual_return, round(stddev_samp(ret) * sqrt(252), 5) AS annual_volatility FROM r GROUP BY backtest_id""",
    "value_quantiles": "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
}
