"""Registered queries of scans, lineage after a fetch, distributions and local times, with DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquet.functions import indicators
from barquet.operators import clock, digest, distribution, lineage, quality, risk, scans
from barquet.plans import acquisition, bars
from barquet.plans.runs import rounded
from barquet.session import table
from barquet.sources import market

SIZE = 1000  #: rows of a chunk: small, so that the tables given have series of several
LARGE = 2000  #: values of a group that is narrowed before it is sorted
ZONE = "America/New_York"


def series_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events: running peak, sum (in cents) and count, the last purchase so far, and the mean of ten values."""
    events = table(spark, sf_dir, "events").withColumn("cents", F.floor(F.col("value") * 100 + 0.5))
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    made = {"peak": ("max", "cents"), "total": ("sum", "cents"), "nth": ("count", F.lit(1)), "last_purchase": ("last", bought)}
    order = lambda by: Window.partitionBy(*by).orderBy("ts", "event_id")
    ten = lambda by: {"sum_of_ten": F.sum("cents").over(order(by).rowsBetween(-9, 0)), "change": F.col("cents") - F.lag("cents", 3).over(order(by))}
    return scans.scan(events, ["event_type"], ["ts", "event_id"], 9, ten, made, size=SIZE).select("event_id", *made, "sum_of_ten", "change")


def price_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices put together again out of the first one and the sums of log returns."""
    b = market.bars(spark, sf_dir)
    move = lambda by: {"move": indicators.log_return(by=by)}
    started = scans.scan(b, ["symbol"], ["timestamp"], 1, move, {"path": ("sum", "move"), "nth": ("count", F.lit(1))}, size=SIZE)
    first = b.groupBy("symbol").agg(F.min_by("adj_close", "timestamp").alias("first"))
    price = F.col("first") * F.exp(F.coalesce("path", F.lit(0.0)))
    return rounded(started.join(first, "symbol").select("symbol", "timestamp", "nth", price.alias("price")), "price")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges of days that were fetched again; the second one twice."""
    b = market.bars(spark, sf_dir).select("symbol", "timestamp")
    day, at = F.dayofmonth("timestamp"), lambda text: F.lit(text).cast("timestamp_ntz")

    def part(first: int, last: int, source: str, hour: str, position: int) -> DataFrame:
        facts = {"source": F.lit(source), "acquired_at": at(f"2024-01-26 {hour}:00:00"), "action_coverage": F.lit("full"), "start": F.make_date(F.lit(2024), F.lit(1), F.lit(first)), "end": F.make_date(F.lit(2024), F.lit(1), F.lit(last)), "content_hash": F.lit(f"{source}-{position}"), "position": F.lit(position)}
        return b.where(day.between(first, last)).withColumns(facts)

    return part(5, 9, "third", "08", 0).unionByName(part(18, 21, "fourth", "08", 1)).unionByName(part(20, 22, "third", "09", 2))


def lineage_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = bars.cached_bars(spark, sf_dir)
    known = acquisition._overlapping(acquisition._lineage(cached)).withColumns({"action_coverage": F.lit("partial"), "content_hash": F.concat_ws(":", "symbol", "source", "start")})
    new = market.bars(spark, sf_dir).join(_fetched(spark, sf_dir).select("symbol", "timestamp").distinct(), ["symbol", "timestamp"], "left_semi").select(*cached.columns)
    out = lineage.rebuild(quality.merge_keep_last(cached, new), known, _fetched(spark, sf_dir), dt.datetime(2024, 1, 1), size=SIZE)
    return out.drop("content_hash").withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


def bar_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digests(market.bars(spark, sf_dir), ["symbol"], ["timestamp"])


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.returns(market.equity_curve(spark, sf_dir))


def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.histogram(_returns(spark, sf_dir), ["backtest_id"], "ret"), "low", "high", digits=9)


def return_qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.normal_plot(_returns(spark, sf_dir), ["backtest_id"], "ret"), "theoretical", "observed", digits=9)


def return_qq_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = distribution.normal_plot(_returns(spark, sf_dir), ["backtest_id"], "ret")
    return rounded(distribution.normal_line(points, ["backtest_id"]), "slope", "intercept", "r", digits=6)


def value_quantiles_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"median": ("linear", 0.5), "p95": ("nearest", 0.95), "least": ("nearest", 0.0), "p99": ("linear", 0.99)}
    out = distribution.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", wanted, limit=LARGE)
    return rounded(out, *wanted)


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a provider's local times on the days when New York's clocks change, a third of them with an offset."""
    events = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 2 == 0, "2024-03-10").otherwise("2024-11-03")
    text = F.concat(day, F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "-05:00").otherwise(""))
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 13 == 0, "then").when(F.col("event_id") % 17 != 0, text)
    out = clock.local_day(events.select("event_id", text.alias("local")), "local", ZONE)
    return out.select("event_id", F.col("day").cast("string").alias("day"), "reason")


QUERIES = {
    f.__name__: f
    for f in (series_scan, price_path, lineage_rebuild, bar_digests, return_histogram, return_qq, return_qq_line, value_quantiles_narrowed, local_days)
}


def _polynomial(coefficients: tuple, x: str) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {c!r}::DOUBLE)"
    return out


def _ratio(pair: tuple, x: str) -> str:
    return f"({_polynomial(pair[0], x)} / {_polynomial(pair[1], x)})"


_RETURNS = f"""{bars._EQUITY},
b AS (SELECT *, lag(equity) OVER (PARTITION BY backtest_id ORDER BY date, id) AS was FROM equity_curve),
r AS (SELECT backtest_id, (equity - was) / was AS ret FROM b WHERE was <> 0)"""
_PLOT = f"""{_RETURNS},
o AS (SELECT *, row_number() OVER (PARTITION BY backtest_id ORDER BY ret) AS nth, count(*) OVER (PARTITION BY backtest_id) AS n FROM r),
m AS (SELECT *, CASE WHEN nth = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN nth = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (nth - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o),
q AS (SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS s FROM m),
plot AS (
  SELECT backtest_id, nth, ret AS observed,
         CASE WHEN abs(q) <= 0.425::DOUBLE THEN q * {_ratio(distribution.CENTRAL, "0.180625::DOUBLE - q * q")}
              ELSE sign(q) * CASE WHEN s <= 5 THEN {_ratio(distribution.MIDDLE, "s - 1.6::DOUBLE")} ELSE {_ratio(distribution.TAIL, "s - 5")} END END AS theoretical
  FROM q)"""

ORACLE_SQL = {
    "series_scan": """
WITH e AS (SELECT *, floor(value * 100 + 0.5)::BIGINT AS cents FROM events)
SELECT event_id, max(cents) OVER w AS peak, (sum(cents) OVER w)::BIGINT AS total, count(*) OVER w AS nth, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase,
       (sum(cents) OVER (o ROWS 9 PRECEDING))::BIGINT AS sum_of_ten, cents - lag(cents, 3) OVER o AS change
FROM e WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id), w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "price_path": f"{bars._BARS} SELECT symbol, timestamp, row_number() OVER ({bars._SERIES}) AS nth, round(adj_close, 6) AS price FROM bars",
    "lineage_rebuild": f"""{acquisition._LINEAGE},
two AS (
  SELECT symbol, source, "start", "end" - 2 AS "end", acquired_at, symbol || ':' || source || ':' || "start" AS hash FROM seg
  UNION ALL SELECT symbol, source, "start" + 3, "end" + 1, acquired_at + INTERVAL 1 DAY, symbol || ':' || source || ':' || ("start" + 3) FROM seg),
every AS (
  SELECT symbol, timestamp, source, day(timestamp) AS d, dividend_amount, split_coefficient FROM bars WHERE day(timestamp) BETWEEN 5 AND 9 OR day(timestamp) BETWEEN 18 AND 22
  UNION ALL SELECT symbol, timestamp, source, day(timestamp), dividend_amount, split_coefficient FROM cached WHERE NOT (day(timestamp) BETWEEN 5 AND 9 OR day(timestamp) BETWEEN 18 AND 22)),
told AS (
  SELECT e.*, CASE WHEN d BETWEEN 20 AND 22 THEN row('third', TIMESTAMP '2024-01-26 09:00:00', 'full', DATE '2024-01-20', DATE '2024-01-22', 'third-2')
                   WHEN d BETWEEN 18 AND 21 THEN row('fourth', TIMESTAMP '2024-01-26 08:00:00', 'full', DATE '2024-01-18', DATE '2024-01-21', 'fourth-1')
                   WHEN d BETWEEN 5 AND 9 THEN row('third', TIMESTAMP '2024-01-26 08:00:00', 'full', DATE '2024-01-05', DATE '2024-01-09', 'third-0')
                   ELSE coalesce((SELECT arg_min(row(t.source, t.acquired_at, 'partial', t."start", t."end", t.hash), row(t."start", t."end", t.acquired_at)) FROM two t
                                  WHERE t.symbol = e.symbol AND t.source = e.source AND e.timestamp::DATE BETWEEN t."start" AND t."end"),
                                 row(e.source, TIMESTAMP '2024-01-01 00:00:00', 'unknown', e.timestamp::DATE, e.timestamp::DATE, 'unsegmented')) END AS o
  FROM every e),
f AS (SELECT *, CASE WHEN o IS DISTINCT FROM lag(o) OVER ({bars._SERIES}) THEN 1 ELSE 0 END AS fresh FROM told),
n AS (SELECT *, sum(fresh) OVER ({bars._SERIES} ROWS UNBOUNDED PRECEDING) AS nth FROM f)
SELECT symbol, min(timestamp)::DATE::VARCHAR AS "start", max(timestamp)::DATE::VARCHAR AS "end", any_value(o[1]) AS source, any_value(o[2]) AS acquired_at, any_value(o[3]) AS action_coverage,
  sha256('[' || string_agg('["' || strftime(timestamp, '%Y-%m-%d') || '",' || dividend_amount || ',' || split_coefficient || ']', ',' ORDER BY timestamp) || ']') AS action_signature, count(*) AS bars
FROM n GROUP BY symbol, nth""",
    "return_histogram": f"""{_RETURNS},
m AS (SELECT backtest_id, min(ret) AS lo, max(ret) AS hi, (max(ret) - min(ret)) / {distribution.BINS} AS width FROM r GROUP BY backtest_id),
c AS (
  SELECT r.backtest_id, CASE WHEN hi > lo THEN least(floor((ret - lo) / width)::INTEGER, {distribution.BINS - 1}) ELSE 0 END AS bin, count(*) AS n FROM r JOIN m ON m.backtest_id = r.backtest_id GROUP BY ALL),
e AS (SELECT m.*, unnest(range({distribution.BINS}))::INTEGER AS bin FROM m)
SELECT e.backtest_id, e.bin, round(lo + width * e.bin, 9) + 0 AS low, round(lo + width * (e.bin + 1), 9) + 0 AS high, coalesce(c.n, 0)::BIGINT AS n
FROM e LEFT JOIN c ON c.backtest_id = e.backtest_id AND c.bin = e.bin""",
    "return_qq": f"{_PLOT} SELECT backtest_id, nth, round(theoretical, 9) + 0 AS theoretical, round(observed, 9) + 0 AS observed FROM plot",
    "return_qq_line": f"""{_PLOT}
SELECT backtest_id, count(*) AS n, round(regr_slope(observed, theoretical), 6) + 0 AS slope, round(regr_intercept(observed, theoretical), 6) + 0 AS intercept, round(corr(observed, theoretical), 6) + 0 AS r
FROM plot GROUP BY backtest_id""",
    "value_quantiles_narrowed": """
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(min(value), 6) AS least, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type""",
    "local_days": """
WITH t AS (
  SELECT event_id, event_id % 2 = 0 AS spring, event_id % 3 = 0 AS zoned, hour(ts) AS h,
         CASE WHEN event_id % 11 = 0 THEN 'not_a_time' WHEN event_id % 13 = 0 THEN 'unreadable' WHEN event_id % 17 = 0 THEN 'missing' END AS odd FROM events),
r AS (SELECT *, CASE WHEN odd IS NOT NULL THEN odd WHEN NOT zoned AND spring AND h = 2 THEN 'nonexistent' WHEN NOT zoned AND NOT spring AND h = 1 THEN 'ambiguous' END AS reason FROM t)
SELECT event_id, CASE WHEN reason IS NULL THEN CASE WHEN spring THEN '2024-03-10' ELSE '2024-11-03' END END AS day, reason FROM r""",
}
