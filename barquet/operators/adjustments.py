"""Corporate actions: prices before a split or dividend made comparable with those after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "adj_close")


def _factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with ``__f``, the product of the factors of all later actions (``symbol, ex_date, factor``).

    Both meet as one sorted union, so there is no range join: a running product from the last row back.
    """
    rows = bars.select("symbol", "timestamp", F.lit(1.0).alias("factor"), F.lit(0).alias("is_action"))
    acts = actions.select("symbol", F.col("ex_date").cast("timestamp_ntz").alias("timestamp"), "factor", F.lit(1).alias("is_action"))
    # From the latest back; at the same time a bar comes before the action, which is for bars strictly before it.
    w = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc(), F.col("is_action")).rowsBetween(Window.unboundedPreceding, 0)
    product = F.exp(F.sum(F.ln("factor")).over(w))
    lines = rows.unionByName(acts).withColumn("__f", product).where("is_action = 0").select("symbol", "timestamp", "__f")
    return bars.join(lines.dropDuplicates(["symbol", "timestamp"]), ["symbol", "timestamp"], "left")


def adjust_for_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices before each split (``symbol, ex_date, factor``) divided by its factor, volumes times it."""
    if not splits.where("factor is null or factor <= 0").isEmpty():
        raise ValueError("split factors must be positive")
    out = _factors(bars, splits)
    return out.withColumns({**{p: F.col(p) / F.col("__f") for p in PRICES}, "volume": F.col("volume") * F.col("__f")}).select(*bars.columns)


def adjust_for_dividends(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Prices before each dividend (``symbol, ex_date, amount``) times (ref - amount) / ref.

    ref is the first close on or after the day, or else the symbol's first close; a ref of 0 changes nothing.
    """
    closes = bars.select("symbol", "timestamp", "close")
    joined = dividends.join(closes, "symbol").groupBy("symbol", "ex_date", "amount").agg(
        F.min_by("close", F.when(F.col("timestamp") >= F.col("ex_date").cast("timestamp_ntz"), F.col("timestamp"))).alias("after"), F.min_by("close", "timestamp").alias("first")
    )
    ref = F.coalesce("after", "first")
    factor = F.when(ref == 0, 1.0).otherwise(F.try_divide(ref - F.col("amount"), ref))
    out = _factors(bars, joined.select("symbol", "ex_date", factor.alias("factor")))
    return out.withColumns({p: F.col(p) * F.col("__f") for p in PRICES}).select(*bars.columns)


def price_gaps(bars: DataFrame, threshold: float = 0.2, column: str = "close") -> DataFrame:
    """Bars whose close moved by more than ``threshold`` from the one before."""
    change = F.try_divide(F.col(column), F.lag(column).over(Window.partitionBy("symbol").orderBy("timestamp"))) - 1
    return bars.withColumn("change", change).where(F.abs("change") > threshold).select("symbol", "timestamp", "change")
