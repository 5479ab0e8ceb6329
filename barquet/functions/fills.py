"""Fill prices of market, limit and stop orders on a bar, as column expressions. ``side`` is LONG (buy) or SHORT (sell)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adverse(price: Column, side: Column, slippage: float) -> Column:
    """The price moved against the order by the slippage."""
    return price * F.when(side == "LONG", 1 + slippage).otherwise(1 - slippage)


def market(side: Column, slippage: float) -> Column:
    return adverse(F.col("open"), side, slippage)


def limit(side: Column, at: Column, slippage: float) -> Column:
    """At the open if that is good enough, with slippage but never beyond the limit; at the limit if touched; else null."""
    open_ = market(side, slippage)
    buy = F.when(F.col("open") <= at, F.least(at, open_)).when(F.col("low") <= at, at)
    sell = F.when(F.col("open") >= at, F.greatest(at, open_)).when(F.col("high") >= at, at)
    return F.when(side == "LONG", buy).otherwise(sell)


def stop(side: Column, at: Column, slippage: float) -> Column:
    """At the open if already beyond the stop, at the stop if touched, both with slippage; else null."""
    buy = F.when(F.col("open") >= at, F.col("open")).when(F.col("high") >= at, at)
    sell = F.when(F.col("open") <= at, F.col("open")).when(F.col("low") <= at, at)
    return adverse(F.when(side == "LONG", buy).otherwise(sell), side, slippage)


def commission(price: Column, quantity: Column, rate: float) -> Column:
    return price * quantity * rate
