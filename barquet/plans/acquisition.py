"""Registered queries of freshness, lineage and parameterised statements, with DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.operators import analytics, freshness, quality
from barquet.plans import bars, runs
from barquet.sources import market

NOW = dt.datetime(2024, 1, 26, 10)


def _lineage(cached: DataFrame) -> DataFrame:
    """Segments of the cached bars; the second source was read the evening before."""
    at = F.when(F.col("source") == "first", "2024-01-12 00:00:00").otherwise("2024-01-25 23:30:00").cast("timestamp_ntz")
    return quality.lineage_segments(cached).select("symbol", "source", F.to_date("start").alias("start"), F.to_date("end").alias("end"), at.alias("acquired_at"))


def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.latest_completed(bars.sessions(spark), NOW).withColumn("latest", F.col("latest").cast("string"))


def requested_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.of_sessions(market.bars(spark, sf_dir), bars.sessions(spark)).select("symbol", "timestamp", "close")


def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = bars.cached_bars(spark, sf_dir)
    out = freshness.stale_sessions(cached, _lineage(cached), bars.sessions(spark), NOW)
    return out.withColumn("session", F.col("session").cast("string"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cached symbol in four ways (plain, refreshed, without the cache, with an invalid generation), and one that isn't cached."""
    every = market.bars(spark, sf_dir).select("symbol").distinct()
    ways = every.crossJoin(F.broadcast(spark.createDataFrame([("", True, False, False), ("+", True, False, True), ("-", False, True, False), ("!", True, True, True)], "mark string, use_cache boolean, invalid boolean, refresh boolean")))
    named = ways.select(F.concat("symbol", "mark").alias("symbol"), "use_cache", "invalid", "refresh")
    return named.union(spark.createDataFrame([("new", True, None, False)], named.schema))


def _marked(frame: DataFrame) -> DataFrame:
    """The same rows for each way to ask for a symbol; the symbol of the last way is cached without gaps."""
    return frame.withColumn("symbol", F.explode(F.array(*(F.concat("symbol", F.lit(m)) for m in ("", "+", "-", "!")))))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of every session, fetched just now, of symbols that are called for as ``<symbol>=``."""
    every = market.bars(spark, sf_dir).withColumn("symbol", F.concat("symbol", F.lit("=")))
    return every.where(F.to_date("timestamp") < F.lit("2024-01-31").cast("date"))


def _status_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cached, whole = bars.cached_bars(spark, sf_dir), _whole(spark, sf_dir)
    fresh = whole.groupBy("symbol").agg(F.lit("events").alias("source"), F.to_date(F.min("timestamp")).alias("start"), F.to_date(F.max("timestamp")).alias("end"), F.lit("2024-01-26 09:30:00").cast("timestamp_ntz").alias("acquired_at"))
    requests = _requests(spark, sf_dir).unionByName(whole.select("symbol").distinct(), allowMissingColumns=True)
    return requests, _marked(cached).unionByName(whole), _marked(_lineage(cached)).unionByName(fresh)


def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = freshness.refresh_plan(*_status_inputs(spark, sf_dir), bars.sessions(spark), NOW)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


def cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.cache_status(*_status_inputs(spark, sf_dir), bars.sessions(spark), NOW)


def _overlapping(lineage: DataFrame) -> DataFrame:
    """Each segment less its last two days, and again three days later and longer, read a day after."""
    short = lineage.withColumn("end", F.date_sub("end", 2))
    return short.unionByName(lineage.withColumns({"start": F.date_add("start", 3), "end": F.date_add("end", 1), "acquired_at": F.col("acquired_at") + F.expr("interval 1 day")}))


def lineage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that overlap, and days that none covers."""
    cached = bars.cached_bars(spark, sf_dir)
    return freshness.lineage_lookup(cached, _overlapping(_lineage(cached)))


def lineage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _lineage(bars.cached_bars(spark, sf_dir))
    newer = known.where("source = 'second'").withColumn("acquired_at", F.lit("2024-01-26 09:00:00").cast("timestamp_ntz"))
    out = freshness.merge_lineage(known, known.where("source = 'first'").unionByName(newer))
    return out.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


def _with_actions(frame: DataFrame) -> DataFrame:
    paid = (F.hour("timestamp") == 9) & (F.dayofmonth("timestamp") == 10)
    cut = (F.hour("timestamp") == 15) & (F.dayofmonth("timestamp") == 20)
    return frame.withColumns({"dividend_amount": F.when(paid, 0.5).otherwise(F.col("dividend_amount")), "split_coefficient": F.when(cut, 2.0).otherwise(F.col("split_coefficient"))})


def actions_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dividends are known on both sides, within a rounding error; of the splits, only those of long names are."""
    cached = _with_actions(bars.cached_bars(spark, sf_dir))
    old = cached.withColumns({"dividend_amount": F.col("dividend_amount") * (1 + 1e-11), "split_coefficient": F.when(F.length("symbol") > 5, F.col("split_coefficient")).otherwise(1.0)})
    return freshness.actions_changed(old, _with_actions(market.bars(spark, sf_dir)))


def action_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.action_signature(_with_actions(market.bars(spark, sf_dir)))


def _careless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native bars, of which those at eight close above the high, and those at ten are free."""
    native, hour = bars.native_bars(spark, sf_dir), F.hour("timestamp")
    return native.withColumns({"close": F.when(hour == 8, F.col("high") * 2).otherwise(F.col("close")), "adj_close": F.when(hour == 10, 0.0).otherwise(F.col("adj_close"))})


def candle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.candle_gate(_careless(spark, sf_dir))


def candle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar that keeps its symbol from a run, and the rule it breaks."""
    return _careless(spark, sf_dir).select("symbol", "timestamp", "volume", freshness.candle_violation().alias("violation")).where("violation is not null")


def _scoped(query, *round_these: str, **parameters):
    return lambda spark, sf_dir: runs.rounded(query(market.run_tables(spark, sf_dir), **parameters), *round_these)


def _defects(query, **parameters):
    return lambda spark, sf_dir: query(market.with_defects(market.run_tables(spark, sf_dir)), **parameters)


FIRST, LAST = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
RUN_IDS = ["run-3", "run-13", "run-18", "run-36", "run-37"]

QUERIES = {
    **{f.__name__: f for f in (latest_session, requested_sessions, stale_sessions, refresh_plan, cache_status, lineage_lookup, lineage_merge, actions_changed, action_signature, candle_gate, candle_violations)},
    "strategy_run_comparison_scoped": _scoped(
        analytics.strategy_run_comparison, "cumulative_trade_pnl", "closed_trade_commission", "derived_total_return", "total_return_delta",
        symbol="SYM1", start_date=FIRST, end_date=LAST, strategy_name="breakout",
    ),
    "strategy_cohort_summary_scoped": _scoped(
        analytics.strategy_cohort_summary, "average_derived_return", "average_sharpe_ratio", symbol="SYM2", start_date=FIRST, end_date=LAST, minimum_run_count=1
    ),
    "trade_sequence_run": _scoped(analytics.trade_sequence, "cumulative_pnl", "cumulative_win_rate", "rolling_5_trade_avg_pnl", run_id="run-7"),
    "equity_drawdown_audit_run": _scoped(
        analytics.equity_drawdown_audit, "point_return", "derived_drawdown_pct", "drawdown_delta_abs", "stored_drawdown_pct", run_id="run-7"
    ),
    "integrity_orphan_children_scoped": _defects(analytics.integrity_orphan_children, run_ids=RUN_IDS),
    "integrity_invalid_records_scoped": _defects(analytics.integrity_invalid_records, run_ids=RUN_IDS),
}

_SESSIONS = bars._SESSIONS
_NOW = "TIMESTAMP '2024-01-26 10:00:00'"
_LINEAGE = f"""{_SESSIONS},
lf AS (SELECT *, CASE WHEN source IS DISTINCT FROM lag(source) OVER w THEN 1 ELSE 0 END AS fresh FROM cached WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
ln AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS nth FROM lf),
seg AS (
  SELECT symbol, source, min(timestamp)::DATE AS "start", max(timestamp)::DATE AS "end",
         CASE WHEN source = 'first' THEN TIMESTAMP '2024-01-12 00:00:00' ELSE TIMESTAMP '2024-01-25 23:30:00' END AS acquired_at
  FROM ln GROUP BY symbol, source, nth)"""
_STALE = f"""{_LINEAGE},
latest AS (SELECT max(nth) AS p, max(session) AS latest FROM sessions WHERE session + INTERVAL 1290 MINUTE <= {_NOW}),
cover AS (SELECT g.*, acquired_at FROM grid g JOIN seg ON seg.symbol = g.symbol AND session BETWEEN "start" AND "end"),
stale AS (
  SELECT DISTINCT symbol, session FROM cover, latest
  WHERE {_NOW} - acquired_at > CASE WHEN nth <= p AND nth > p - 5 THEN INTERVAL 1 HOUR ELSE INTERVAL 7 DAY END
  UNION SELECT symbol, session FROM days WHERE session IN (SELECT session FROM sessions) AND (symbol, session) NOT IN (SELECT (symbol, session) FROM cover))"""
#: A symbol's mark says how it is asked for: + refreshed, - without the cache, ! invalid; = has all its sessions, read half an hour ago.
_TOLD = """
every AS (
  SELECT symbol || mark AS symbol, symbol AS base, mark, session, nth
  FROM (SELECT DISTINCT symbol FROM bars), (VALUES (''), ('+'), ('-'), ('!'), ('=')) m(mark), sessions
  UNION ALL SELECT 'new', 'new', '', session, nth FROM sessions),
own AS (SELECT DISTINCT symbol, timestamp::DATE AS session FROM bars WHERE timestamp < TIMESTAMP '2024-01-31'),
seen AS (
  SELECT e.*, CASE WHEN mark = '=' THEN o.session IS NOT NULL ELSE d.session IS NOT NULL END AS cached, s.session IS NOT NULL AND mark <> '=' AS stale
  FROM every e LEFT JOIN days d ON d.symbol = e.base AND d.session = e.session LEFT JOIN own o ON o.symbol = e.base AND o.session = e.session
  LEFT JOIN stale s ON s.symbol = e.base AND s.session = e.session),
told AS (
  SELECT *, stale OR NOT cached OR mark IN ('+', '-', '!') AS needed,
         CASE WHEN mark IN ('-', '+') THEN 'FORCED_REFRESH' WHEN mark = '!' THEN 'INVALIDATED' WHEN bool_or(stale) OVER w THEN 'STALE_REFRESH'
              WHEN NOT bool_or(cached) OVER w THEN 'MISS' WHEN NOT bool_and(cached) OVER w THEN 'PARTIAL_HIT' ELSE 'FULL_HIT' END AS status
  FROM seen WINDOW w AS (PARTITION BY symbol))"""
_PAID = "CASE WHEN hour(timestamp) = 9 AND day(timestamp) = 10 THEN 0.5::DOUBLE ELSE dividend_amount END"
_CUT = "CASE WHEN hour(timestamp) = 15 AND day(timestamp) = 20 THEN 2.0::DOUBLE ELSE split_coefficient END"
_CANDLES = f"""{bars._NATIVE},
n AS (
  SELECT * REPLACE (CASE WHEN hour(timestamp) = 8 THEN high * 2 ELSE close END AS close, CASE WHEN hour(timestamp) = 10 THEN 0 ELSE adj_close END AS adj_close) FROM native),
v AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, open, high, low, close, adj_close, volume) - 1 AS position,
         CASE WHEN NOT isfinite(close) THEN 'values must be finite' WHEN least(open, high, low, close, adj_close) <= 0 THEN 'prices must be positive'
              WHEN volume < 0 THEN 'volume must not be negative' WHEN open < low OR open > high THEN 'open must be between low and high'
              WHEN close < low OR close > high THEN 'close must be between low and high' END AS violation
  FROM n)"""


def _only(sql: str, table: str, rule: str) -> str:
    """The statement with one of its tables narrowed."""
    return sql.replace(f"FROM {table}", f"FROM (SELECT * FROM {table} WHERE {rule})")


_IDS = "(" + ", ".join(f"'{r}'" for r in RUN_IDS) + ")"
ORACLE_SQL = {
    "latest_session": f"{_STALE} SELECT latest::VARCHAR AS latest FROM latest",
    "requested_sessions": f"{_SESSIONS} SELECT symbol, timestamp, close FROM bars WHERE timestamp::DATE IN (SELECT session FROM sessions)",
    "stale_sessions": f"{_STALE} SELECT symbol, session::VARCHAR AS session FROM stale",
    "cache_status": f"""{_STALE}, {_TOLD}
SELECT symbol, status, count(*) AS requested, count(*) FILTER (needed) AS needed FROM told GROUP BY symbol, status""",
    "refresh_plan": f"""{_STALE}, {_TOLD},
need AS (SELECT *, nth - row_number() OVER (PARTITION BY symbol ORDER BY nth) AS island FROM told WHERE needed)
SELECT symbol, status, min(session)::VARCHAR AS first, max(session)::VARCHAR AS last, count(*) AS sessions FROM need GROUP BY symbol, status, island""",
    "lineage_lookup": f"""{_LINEAGE},
two AS (
  SELECT symbol, source, "start", "end" - 2 AS "end", acquired_at FROM seg
  UNION ALL SELECT symbol, source, "start" + 3, "end" + 1, acquired_at + INTERVAL 1 DAY FROM seg)
SELECT c.symbol, c.timestamp, c.source, (SELECT arg_min(acquired_at, row("start", "end", acquired_at)) FROM two s WHERE s.symbol = c.symbol AND s.source = c.source
  AND c.timestamp::DATE BETWEEN s."start" AND s."end") AS acquired_at FROM cached c""",
    "lineage_merge": f"""{_LINEAGE}
SELECT symbol, source, "start"::VARCHAR AS "start", "end"::VARCHAR AS "end", acquired_at FROM seg
UNION SELECT symbol, source, "start"::VARCHAR, "end"::VARCHAR, TIMESTAMP '2024-01-26 09:00:00' FROM seg WHERE source = 'second'""",
    "actions_changed": f"""{bars._CACHED}
, n AS (SELECT *, {_PAID} AS d, {_CUT} AS s FROM bars), o AS (SELECT *, {_PAID} * (1 + 1e-11::DOUBLE) AS d, CASE WHEN length(symbol) > 5 THEN {_CUT} ELSE 1 END AS s FROM cached)
SELECT o.symbol, coalesce(bool_or(abs(o.d - n.d) > greatest(1e-9::DOUBLE * greatest(abs(o.d), abs(n.d)), 1e-12::DOUBLE) OR abs(o.s - n.s) > 1e-9::DOUBLE * greatest(o.s, n.s)), false) AS changed
FROM o LEFT JOIN n ON n.symbol = o.symbol AND n.timestamp = o.timestamp GROUP BY o.symbol""",
    "action_signature": f"""{bars._BARS},
a AS (SELECT *, {_PAID} AS d, {_CUT} AS s FROM bars)
SELECT symbol, sha256('[' || string_agg('["' || strftime(timestamp, '%Y-%m-%d') || '",' || d || ',' || s || ']', ',' ORDER BY timestamp) || ']') AS signature
FROM a GROUP BY symbol""",
    "candle_gate": f"""{_CANDLES}
SELECT symbol, min(position) AS position, arg_min(timestamp, position) AS timestamp, arg_min(violation, position) AS violation FROM v WHERE violation IS NOT NULL GROUP BY symbol""",
    "candle_violations": f"{_CANDLES} SELECT symbol, timestamp, volume, violation FROM v WHERE violation IS NOT NULL",
    "strategy_run_comparison_scoped": _only(runs.ORACLE_SQL["strategy_run_comparison"], "backtest_runs", "symbol = 'SYM1' AND strategy_name = 'breakout'"),
    "strategy_cohort_summary_scoped": _only(runs.ORACLE_SQL["strategy_cohort_summary"].replace("HAVING count(*) >= 2", ""), "backtest_runs", "symbol = 'SYM2'"),
    "trade_sequence_run": runs.ORACLE_SQL["trade_sequence"].replace("FROM trades WHERE ", "FROM trades WHERE backtest_id = 'run-7' AND "),
    "equity_drawdown_audit_run": runs.ORACLE_SQL["equity_drawdown_audit"] + " WHERE run_id = 'run-7'",
    **{f"{n}_scoped": f"SELECT * FROM ({runs.ORACLE_SQL[n]}) WHERE run_id IN {_IDS}" for n in ("integrity_orphan_children", "integrity_invalid_records")},
}
