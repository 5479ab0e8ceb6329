"""Indicator columns over bars: window expressions, by symbol in order of time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("symbol",)


def _order(by: tuple[str, ...] = SERIES):
    return Window.partitionBy(*by).orderBy("timestamp")


def sma(column: str, period: int, by: tuple[str, ...] = SERIES) -> Column:
    """Mean of the last ``period`` values; null before there are as many."""
    w = _order(by)
    return F.when(F.row_number().over(w) >= period, F.avg(column).over(w.rowsBetween(1 - period, 0)))


def prior_high(column: str, lookback: int, by: tuple[str, ...] = SERIES) -> Column:
    """Largest of the ``lookback`` values before this bar; null before there are as many."""
    w = _order(by)
    return F.when(F.row_number().over(w) > lookback, F.max(column).over(w.rowsBetween(-lookback, -1)))


def prior_low(column: str, lookback: int, by: tuple[str, ...] = SERIES) -> Column:
    w = _order(by)
    return F.when(F.row_number().over(w) > lookback, F.min(column).over(w.rowsBetween(-lookback, -1)))


def log_return(column: str = "adj_close", by: tuple[str, ...] = SERIES) -> Column:
    """Logarithm of a value over the one before; null for the first, and where either isn't positive."""
    before = F.lag(column).over(_order(by))
    return F.when((F.col(column) > 0) & (before > 0), F.ln(F.col(column) / before))


def ma_cross(bars: DataFrame, fast: int = 10, slow: int = 50, column: str = "adj_close", by: tuple[str, ...] = SERIES) -> DataFrame:
    """Add ``fast_sma, slow_sma`` and ``cross``: 1 where fast passes above slow, -1 where it falls back, else 0.

    There is no cross before both means exist on two bars in a row.
    """
    if not 0 < fast < slow:
        raise ValueError("fast must be below slow")
    means = bars.withColumns({"fast_sma": sma(column, fast, by), "slow_sma": sma(column, slow, by)})
    above = F.col("fast_sma") > F.col("slow_sma")
    was = F.lag(above).over(_order(by))
    cross = F.when(was.isNull() | F.col("slow_sma").isNull(), 0).when(~was & above, 1).when(was & ~above, -1).otherwise(0)
    return means.withColumn("cross", cross)


def channel_break(bars: DataFrame, lookback: int = 20, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Add ``prior_high, prior_low`` and ``break``: 1 where the close passes the high, -1 where it falls below the low, else 0."""
    channel = bars.withColumns({"prior_high": prior_high("high", lookback, by), "prior_low": prior_low("low", lookback, by)})
    broke = F.when(F.col("close") > F.col("prior_high"), 1).when(F.col("close") < F.col("prior_low"), -1).otherwise(0)
    return channel.withColumn("break", broke)


SEGMENT = 1000  #: bars at most of a stretch that is smoothed by one window


def rsi(bars: DataFrame, period: int = 14, column: str = "adj_close", by: tuple[str, ...] = SERIES) -> DataFrame:
    """Add ``rsi`` with Wilder's smoothing; null for the first ``period`` bars of a series.

    The smoothing ``s = (s (period - 1) + x) / period`` is a recursion. Within a segment it is a running sum of values
    weighted by powers of ``a = 1 - 1 / period``; only what a segment starts with is carried from one to the next, as a
    fold over the segments' sums. So the time grows with the length of a series.
    """
    if period < 1:
        raise ValueError("period must be positive")
    w, a = _order(by), (period - 1) / period
    change = F.col(column) - F.lag(column).over(w)
    later = F.greatest(F.row_number().over(w) - period - 1, F.lit(0))
    value = lambda g, l: F.when(l == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(g, l)))
    if not a:  # nothing is carried from bar to bar
        return bars.withColumn("rsi", F.when(change.isNotNull(), value(F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0)))))
    size = max(1, min(SEGMENT, int(200 / -math.log(a))))
    moves = bars.withColumns({"__gain": F.greatest(change, F.lit(0.0)), "__loss": F.greatest(-change, F.lit(0.0)), "__nth": F.row_number().over(w), "__k": later})
    segment = F.floor(F.greatest(F.col("__k") - 1, F.lit(0)) / size).cast("int")
    moves = moves.withColumn("__seg", segment).withColumn("__pos", (F.col("__k") - F.col("__seg") * size).cast("int"))
    power = lambda n: F.pow(F.lit(a), n)
    part = lambda x: F.when(F.col("__k") > 0, F.col(x) / period).otherwise(0.0)
    two = lambda f: [f("__gain").alias("g"), f("__loss").alias("l")]

    head = F.col("__nth").between(2, period + 1)
    seeds = moves.where(head).groupBy(*by).agg(*two(lambda x: F.sum(x) / period), F.count("*").alias("n")).where(F.col("n") == period)
    sums = moves.groupBy(*by, "__seg").agg(*two(lambda x: F.sum(part(x) * power(size - F.col("__pos")))))
    series = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__seg", "g", "l"))).alias("s")).join(seeds, list(by))
    state = lambda g, l: F.struct(g.alias("g"), l.alias("l"))
    carry = lambda c, x: state(c["g"] * a**size + x["g"], c["l"] * a**size + x["l"])
    fold = F.aggregate("s", F.array(state(F.col("g"), F.col("l"))), lambda c, x: F.array_append(c, carry(F.element_at(c, -1), x)))
    starts = series.select(*by, F.posexplode(fold).alias("__seg", "c")).select(*by, "__seg", F.col("c.g").alias("__g"), F.col("c.l").alias("__l"))

    inside = Window.partitionBy(*by, "__seg").orderBy("__nth").rowsBetween(Window.unboundedPreceding, 0)
    summed = lambda x: F.sum(part(x) / power(F.col("__pos"))).over(inside) * power(F.col("__pos"))
    own = moves.withColumns({"__gs": summed("__gain"), "__ls": summed("__loss")}).join(starts, [*by, "__seg"], "left")
    g, l = (power(F.col("__pos")) * F.col(c) + F.col(s) for c, s in (("__g", "__gs"), ("__l", "__ls")))
    return own.withColumn("rsi", F.when((F.col("__nth") > period) & F.col("__g").isNotNull(), value(g, l))).select(*bars.columns, "rsi")
