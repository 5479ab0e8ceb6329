"""Market and run tables out of the table ``events``, with the same tables in DuckDB SQL.

Money is kept in whole cents while it is added up, so that sums are the same in any order and engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquet.session import scratch, table

CAPITAL_STEP = 10_000
#: What the synthetic runs are called.
STRATEGIES = ("moving_average", "rsi_reversion", "breakout")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"))
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select(
            "timestamp", "symbol", "open", "high", "low", "close", "volume", F.col("close").alias("adj_close"),
            F.lit(0.0).alias("dividend_amount"), F.lit(1.0).alias("split_coefficient"), F.lit("events").alias("source"),
        )
    )


def _cents(column: str):
    return F.floor(F.col(column) * 100 + 0.5)


def _run_id():
    return F.concat(F.lit("run-"), F.col("user_id").cast("string"))


def backtest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), (F.col("user_id") % 3 + 1).cast("int"))
    ntz = lambda text: F.lit(text).cast("timestamp_ntz")
    return users.select(
        _run_id().alias("id"),
        strategy.alias("strategy_name"),
        F.concat(F.lit("SYM"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
        ntz("2024-01-01 00:00:00").alias("start_date"),
        ntz("2024-01-31 00:00:00").alias("end_date"),
        F.lit("{}").alias("params_json"),
        (F.lit(CAPITAL_STEP) * (F.col("user_id") % 2 + 1)).cast("double").alias("initial_capital"),
        F.lit(0.001).alias("commission_pct"),
        F.lit(0.0005).alias("slippage_pct"),
        (ntz("2024-02-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("user_id").cast("int"))).alias("created_at"),
    )


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(CAPITAL_STEP * 100) * (F.col("user_id") % 2 + 1)
    walk = table(spark, sf_dir, "events").withColumn("cents", start + F.sum(_cents("value") - 5000).over(order))
    peaked = walk.withColumn("peak", F.max("cents").over(order))
    return peaked.select(
        (F.col("event_id") + 1).alias("id"),
        _run_id().alias("backtest_id"),
        F.col("ts").alias("date"),
        (F.col("cents") / 100.0).alias("equity"),
        ((F.col("cents") - F.col("peak")).cast("double") / F.col("peak")).alias("drawdown_pct"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    legs = bought.select(
        "*", _cents("value").alias("entry"), F.lead("ts").over(order).alias("exit_date"), F.lead(_cents("value")).over(order).alias("exit"),
        (F.col("event_id") % 10 + 1).cast("int").alias("quantity"),
    )
    pnl = (F.col("exit") - F.col("entry")) * F.col("quantity") - F.col("quantity")
    return legs.select(
        (F.col("event_id") + 1).alias("id"),
        _run_id().alias("backtest_id"),
        F.col("ts").alias("entry_date"),
        "exit_date",
        F.lit("LONG").alias("direction"),
        (F.col("entry") / 100.0).alias("entry_price"),
        (F.col("exit") / 100.0).alias("exit_price"),
        "quantity",
        (pnl / 100.0).alias("pnl"),
        F.try_divide(pnl.cast("double"), F.col("entry") * F.col("quantity")).alias("pnl_pct"),
        (F.col("quantity") / 100.0).alias("commission"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten made-up metrics of each run; every seventh run lacks two of them. ``total_return`` fits the equity curve."""
    ev = table(spark, sf_dir, "events")
    last = ev.groupBy("user_id").agg(F.sum(_cents("value") - 5000).alias("gain"), F.count("*").alias("n"))
    u, share = F.col("user_id"), F.col("gain").cast("double") / (F.lit(CAPITAL_STEP * 100) * (F.col("user_id") % 2 + 1))
    tenth = lambda k: (u * k % 40).cast("double") / 10
    value = {
        "sharpe_ratio": tenth(7), "sortino_ratio": tenth(11), "cagr": share, "max_drawdown": -tenth(3) / 10, "max_drawdown_duration": (u % 20).cast("double"),
        "win_rate": (u % 11).cast("double") / 10, "profit_factor": tenth(13), "calmar_ratio": tenth(17), "total_trades": F.col("n").cast("double"), "total_return": share,
    }
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(name).alias("metric_name"), v.alias("metric_value")) for i, (name, v) in enumerate(value.items()))))
    tall = last.select("user_id", rows.alias("m")).where(~((u % 7 == 0) & F.col("m.metric_name").isin("cagr", "sharpe_ratio")))
    return tall.select((u * 100 + F.col("m.k")).alias("id"), _run_id().alias("backtest_id"), "m.metric_name", "m.metric_value")


#: Where the run tables of an application's inputs have been written.
_WRITTEN: dict[tuple[str, str], str] = {}


def run_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four run tables, made out of the events once in an application and then read, as those of a store are."""
    made, key = (backtest_runs, trades, equity_curve, metrics), (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        place = scratch(spark)
        for f in made:
            f(spark, sf_dir).write.parquet(f"{place}/{f.__name__}")
        _WRITTEN[key] = place
    return {f.__name__: spark.read.parquet(f"{_WRITTEN[key]}/{f.__name__}") for f in made}


def with_defects(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The run tables as a legacy dataset: some rows break each rule of the integrity report."""
    number = F.substring_index("id", "-", -1).cast("long")
    r = tables["backtest_runs"].where(number % 13 != 0)
    r = r.withColumns(
        {
            "start_date": F.when(number % 17 == 1, F.col("end_date") + F.expr("interval 1 day")).otherwise(F.col("start_date")),
            "initial_capital": F.when(number % 17 == 2, 0.0).otherwise(F.col("initial_capital")),
            "commission_pct": F.when(number % 17 == 3, -0.001).otherwise(F.col("commission_pct")),
            "slippage_pct": F.when(number % 17 == 4, -0.001).otherwise(F.col("slippage_pct")),
        }
    )
    t, i = tables["trades"], F.col("id")
    t = t.withColumns({"quantity": F.when(i % 23 == 0, 0).otherwise(F.col("quantity")), "exit_price": F.when(i % 29 != 0, F.col("exit_price"))})
    e = tables["equity_curve"]
    e = e.unionByName(e.where(i % 31 == 0).withColumn("id", -i))
    e = e.withColumn("drawdown_pct", F.when(i % 97 == 0, F.col("drawdown_pct") - 0.5).otherwise(F.col("drawdown_pct")))
    m = tables["metrics"]
    m = m.unionByName(m.where(i % 37 == 0).withColumn("id", -i))
    m = m.withColumn("metric_value", F.when((F.col("metric_name") == "total_return") & (i % 41 == 0), F.col("metric_value") + 1).otherwise(F.col("metric_value")))
    return {"backtest_runs": r, "trades": t, "equity_curve": e, "metrics": m}


#: The same tables for DuckDB, to stand before a query.
BARS_SQL = """
bars AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS symbol, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume, arg_max(value, row(ts, event_id)) AS adj_close,
         0.0::DOUBLE AS dividend_amount, 1.0::DOUBLE AS split_coefficient, 'events' AS source
  FROM events GROUP BY ALL)"""
RUNS_SQL = """
walk AS (
  SELECT *, 1000000 * (user_id % 2 + 1) + sum(floor(value * 100 + 0.5)::BIGINT - 5000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cents
  FROM events),
legs AS (
  SELECT *, floor(value * 100 + 0.5)::BIGINT AS entry, lead(ts) OVER w AS exit_date, lead(floor(value * 100 + 0.5)::BIGINT) OVER w AS exit, event_id % 10 + 1 AS quantity
  FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
gains AS (SELECT user_id, sum(floor(value * 100 + 0.5)::BIGINT - 5000)::BIGINT AS gain, count(*) AS n FROM events GROUP BY user_id),
shares AS (SELECT *, gain::DOUBLE / (1000000 * (user_id % 2 + 1)) AS share FROM gains),
backtest_runs AS (
  SELECT DISTINCT 'run-' || user_id AS id, ['moving_average', 'rsi_reversion', 'breakout'][user_id % 3 + 1] AS strategy_name, 'SYM' || (user_id % 5) AS symbol,
         TIMESTAMP '2024-01-01 00:00:00' AS start_date, TIMESTAMP '2024-01-31 00:00:00' AS end_date, '{}' AS params_json,
         (10000 * (user_id % 2 + 1))::DOUBLE AS initial_capital, 0.001::DOUBLE AS commission_pct, 0.0005::DOUBLE AS slippage_pct,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(user_id) AS created_at
  FROM events),
equity_curve AS (
  SELECT event_id + 1 AS id, 'run-' || user_id AS backtest_id, ts AS date, cents::DOUBLE / 100 AS equity, (cents - peak)::DOUBLE / peak AS drawdown_pct
  FROM (SELECT *, max(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM walk)),
trades AS (
  SELECT event_id + 1 AS id, 'run-' || user_id AS backtest_id, ts AS entry_date, exit_date, 'LONG' AS direction, entry::DOUBLE / 100 AS entry_price,
         exit::DOUBLE / 100 AS exit_price, quantity::INTEGER AS quantity, ((exit - entry) * quantity - quantity)::DOUBLE / 100 AS pnl,
         ((exit - entry) * quantity - quantity)::DOUBLE / nullif(entry * quantity, 0) AS pnl_pct, quantity::DOUBLE / 100 AS commission
  FROM legs),
metrics AS (
  SELECT user_id * 100 + k AS id, 'run-' || user_id AS backtest_id, metric_name, metric_value FROM (
    SELECT user_id, 0 AS k, 'sharpe_ratio' AS metric_name, (user_id * 7 % 40)::DOUBLE / 10 AS metric_value FROM shares
    UNION ALL SELECT user_id, 1, 'sortino_ratio', (user_id * 11 % 40)::DOUBLE / 10 FROM shares
    UNION ALL SELECT user_id, 2, 'cagr', share FROM shares
    UNION ALL SELECT user_id, 3, 'max_drawdown', -((user_id * 3 % 40)::DOUBLE / 10) / 10 FROM shares
    UNION ALL SELECT user_id, 4, 'max_drawdown_duration', (user_id % 20)::DOUBLE FROM shares
    UNION ALL SELECT user_id, 5, 'win_rate', (user_id % 11)::DOUBLE / 10 FROM shares
    UNION ALL SELECT user_id, 6, 'profit_factor', (user_id * 13 % 40)::DOUBLE / 10 FROM shares
    UNION ALL SELECT user_id, 7, 'calmar_ratio', (user_id * 17 % 40)::DOUBLE / 10 FROM shares
    UNION ALL SELECT user_id, 8, 'total_trades', n::DOUBLE FROM shares
    UNION ALL SELECT user_id, 9, 'total_return', share FROM shares)
  WHERE NOT (user_id % 7 = 0 AND metric_name IN ('cagr', 'sharpe_ratio')))"""
DEFECTS_SQL = """
bad_runs AS (
  SELECT * REPLACE (CASE WHEN k % 17 = 1 THEN end_date + INTERVAL 1 DAY ELSE start_date END AS start_date, CASE WHEN k % 17 = 2 THEN 0.0::DOUBLE ELSE initial_capital END AS initial_capital,
                    CASE WHEN k % 17 = 3 THEN -0.001::DOUBLE ELSE commission_pct END AS commission_pct, CASE WHEN k % 17 = 4 THEN -0.001::DOUBLE ELSE slippage_pct END AS slippage_pct)
  FROM (SELECT *, split_part(id, '-', 2)::BIGINT AS k FROM backtest_runs) WHERE k % 13 <> 0),
bad_trades AS (
  SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN 0 ELSE quantity END AS quantity, CASE WHEN id % 29 <> 0 THEN exit_price END AS exit_price) FROM trades),
bad_equity AS (
  SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN drawdown_pct - 0.5::DOUBLE ELSE drawdown_pct END AS drawdown_pct)
  FROM (SELECT * FROM equity_curve UNION ALL SELECT * REPLACE (-id AS id) FROM equity_curve WHERE id % 31 = 0)),
bad_metrics AS (
  SELECT * REPLACE (CASE WHEN metric_name = 'total_return' AND id % 41 = 0 THEN metric_value + 1 ELSE metric_value END AS metric_value)
  FROM (SELECT * FROM metrics UNION ALL SELECT * REPLACE (-id AS id) FROM metrics WHERE id % 37 = 0))"""
