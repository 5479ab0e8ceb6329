"""What to fetch again, and where rows came from: set operations over sessions, cached bars and their lineage.

``sessions`` (``session, close_utc``) is a calendar: a row a trading day, so it is small and may be broadcast.
``lineage`` (``symbol, source, start, end, acquired_at``, bounds as dates) has a row for each segment of cached bars.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators.quality import KEY, finite, is_close
from barquet.operators.scans import first_covering

LINEAGE = ("start", "end", "source", "acquired_at", "content_hash", "action_signature")
PRICES = ("open", "high", "low", "close", "adj_close")


@dataclass(frozen=True)
class Freshness:
    """When cached sessions are fetched again."""

    recent_ttl: dt.timedelta = dt.timedelta(hours=1)
    historical_ttl: dt.timedelta = dt.timedelta(days=7)
    recent_sessions: int = 5
    lag: dt.timedelta = dt.timedelta(minutes=30)

    def __post_init__(self) -> None:
        if min(self.recent_ttl, self.historical_ttl, self.lag) < dt.timedelta(0) or self.recent_sessions < 1:
            raise ValueError("times must not be negative, and at least one session is recent")


def _at(now: dt.datetime) -> Column:
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def latest_completed(sessions: DataFrame, now: dt.datetime, rules: Freshness = Freshness()) -> DataFrame:
    """One row: the ``latest`` session that had closed, with the time its bars take to appear, by ``now``; null if none."""
    done = F.col("close_utc") + F.lit(rules.lag) <= _at(now)
    return sessions.agg(F.max(F.when(done, F.col("session"))).alias("latest"))


def of_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """The bars of the requested sessions, and no others."""
    days = F.broadcast(sessions.select(F.col("session").alias("__day")).distinct())
    return bars.join(days, F.to_date("timestamp") == F.col("__day"), "left_semi")


def _grid(symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session for every symbol, numbered."""
    numbered = sessions.select("session").distinct().withColumn("nth", F.row_number().over(Window.orderBy("session")))
    every = F.broadcast(numbered.agg(F.collect_list(F.struct("session", "nth")).alias("all")))
    return symbols.join(every).select("symbol", F.explode("all").alias("s")).select("symbol", "s.session", "s.nth")


def stale_sessions(cached: DataFrame, lineage: DataFrame, sessions: DataFrame, now: dt.datetime, rules: Freshness = Freshness()) -> DataFrame:
    """``symbol, session`` for what is cached but too old: of the sessions that a segment covers, the last ones before now
    age sooner than the others; cached sessions that no segment covers, and all of a symbol without lineage, are stale."""
    days = cached.select("symbol", F.to_date("timestamp").alias("session")).distinct()
    grid = _grid(cached.select("symbol").distinct(), sessions)
    known = lineage.select("symbol").distinct()
    at = F.broadcast(latest_completed(sessions, now, rules))
    last = F.broadcast(sessions.join(at, F.col("session") <= F.col("latest")).agg(F.count_distinct("session").alias("last")))
    segments = lineage.select("symbol", F.col("start").alias("__start"), F.col("end").alias("__end"), "acquired_at")
    covered = grid.join(segments, "symbol").where("session between __start and __end").join(last)
    recent = (F.col("nth") <= F.col("last")) & (F.col("nth") > F.col("last") - rules.recent_sessions)
    old = _at(now) - F.col("acquired_at") > F.when(recent, F.lit(rules.recent_ttl)).otherwise(F.lit(rules.historical_ttl))
    aged = covered.where(old).select("symbol", "session")
    expected = days.join(F.broadcast(sessions.select("session").distinct()), "session", "left_semi").select("symbol", "session")
    bare = expected.join(covered.select("symbol", "session"), ["symbol", "session"], "left_anti")
    unknown = grid.join(known, "symbol", "left_anti").select("symbol", "session")
    return aged.unionByName(bare).unionByName(unknown).distinct()


def _needed(requests: DataFrame, cached: DataFrame, lineage: DataFrame, sessions: DataFrame, now: dt.datetime, rules: Freshness) -> DataFrame:
    """Every session of every requested symbol: ``symbol, session, nth, needed, status``, the status being the symbol's."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in requests.columns else F.lit(False)
    forced = ~F.coalesce(F.col("use_cache"), F.lit(True)) if "use_cache" in requests.columns else F.lit(False)
    asked = requests.groupBy("symbol").agg(F.max(forced).alias("unused"), F.max(flag("invalid")).alias("invalid"), F.max(flag("refresh")).alias("refresh"))
    days = cached.select("symbol", F.to_date("timestamp").alias("session")).distinct()
    have = days.withColumn("cached", F.lit(1))
    old = stale_sessions(cached, lineage, sessions, now, rules).withColumn("stale", F.lit(1))
    grid = _grid(asked.select("symbol"), sessions).join(asked, "symbol")
    seen = grid.join(have, ["symbol", "session"], "left").join(old, ["symbol", "session"], "left")
    most = lambda x: F.max(x).over(Window.partitionBy("symbol"))
    everything = F.col("unused") | F.col("invalid") | F.col("refresh")
    status = F.when(F.col("unused"), "FORCED_REFRESH").when(F.col("invalid"), "INVALIDATED").when(F.col("refresh"), "FORCED_REFRESH").when(most("stale") == 1, "STALE_REFRESH")
    status = status.when(most(F.col("cached").isNull()) & most("cached").isNull(), "MISS").when(most(F.col("cached").isNull()), "PARTIAL_HIT").otherwise("FULL_HIT")
    return seen.select("symbol", "session", "nth", (everything | F.col("cached").isNull() | (F.col("stale") == 1)).alias("needed"), status.alias("status"))


def cache_status(requests: DataFrame, cached: DataFrame, lineage: DataFrame, sessions: DataFrame, now: dt.datetime, rules: Freshness = Freshness()) -> DataFrame:
    """``symbol, status, requested, needed``: what the cache holds of the requested sessions, and how many have to be fetched.

    ``requests`` has ``symbol`` and may have ``use_cache`` (false: FORCED_REFRESH), ``invalid`` (the cached generation failed
    its checks: INVALIDATED) and ``refresh`` (FORCED_REFRESH), which count in this order and need all sessions. Otherwise the
    status is STALE_REFRESH if any session is stale, MISS if none is cached, PARTIAL_HIT if some are missing, or FULL_HIT.
    """
    seen = _needed(requests, cached, lineage, sessions, now, rules)
    return seen.groupBy("symbol", "status").agg(F.count("*").alias("requested"), F.count_if("needed").alias("needed"))


def refresh_plan(requests: DataFrame, cached: DataFrame, lineage: DataFrame, sessions: DataFrame, now: dt.datetime, rules: Freshness = Freshness()) -> DataFrame:
    """Ranges of consecutive sessions to fetch: ``symbol, first, last, sessions, status`` (see ``cache_status``).

    A full hit needs no range.
    """
    needed = _needed(requests, cached, lineage, sessions, now, rules).where(F.coalesce("needed", F.lit(False)))
    island = F.col("nth") - F.row_number().over(Window.partitionBy("symbol").orderBy("nth"))
    ranges = needed.withColumn("island", island).groupBy("symbol", "status", "island")
    return ranges.agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count("*").alias("sessions")).drop("island")


def lineage_lookup(bars: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each bar (``symbol, timestamp, source``) with ``acquired_at`` of the first segment of its source that covers its day;
    null if none does. Segments count in the order of their start, end and time."""
    return first_covering(bars.select(*KEY, "source"), lineage, ["symbol", "source"], F.to_date("timestamp"), "start", "end", {"acquired_at": "acquired_at"}, ["acquired_at"])


def merge_lineage(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The segments of both, equal ones once; they are read in the order of ``LINEAGE``."""
    return existing.unionByName(incoming).distinct()


def actions_changed(cached: DataFrame, refreshed: DataFrame, relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """``symbol, changed``: whether a dividend or split of a bar that both have differs."""
    names = ("dividend_amount", "split_coefficient")
    new = refreshed.select(*KEY, *(F.col(n).alias(f"__{n}") for n in names))
    off = ~(is_close(F.col(names[0]), F.col(f"__{names[0]}"), relative, absolute) & is_close(F.col(names[1]), F.col(f"__{names[1]}"), relative, absolute))
    met = cached.select(*KEY, *names).join(new, [*KEY]).where(off).select("symbol").distinct().withColumn("changed", F.lit(True))
    return cached.select("symbol").distinct().join(met, "symbol", "left").select("symbol", F.coalesce("changed", F.lit(False)).alias("changed"))


def candle_violation() -> Column:
    """The first rule for candles that a bar breaks; null if none. Open and close lie within low and high."""
    every = F.lit(True)
    for name in (*PRICES, "volume"):
        every = every & finite(name)
    positive = F.least(*(F.col(p) for p in PRICES)) > 0
    rules = F.when(F.col("timestamp").isNull(), "timestamp is missing").when(~every, "values must be finite").when(~positive, "prices must be positive")
    rules = rules.when(F.col("volume") < 0, "volume must not be negative")
    for name in ("open", "close"):
        rules = rules.when(~F.col(name).between(F.col("low"), F.col("high")), f"{name} must be between low and high")
    return rules


def candle_gate(bars: DataFrame) -> DataFrame:
    """For each symbol that isn't fit for a run, its first bad bar in order of time: ``symbol, position, timestamp, violation``."""
    nth = (F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("timestamp").asc_nulls_first(), *PRICES, "volume")) - 1).cast("long")
    bad = bars.select("symbol", "timestamp", nth.alias("position"), candle_violation().alias("violation")).where("violation is not null")
    first = F.min(F.struct("position", "timestamp", "violation")).alias("f")
    return bad.groupBy("symbol").agg(first).select("symbol", "f.position", "f.timestamp", "f.violation")
