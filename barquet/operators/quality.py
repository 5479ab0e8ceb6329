"""Rules for canonical bars: reasons to reject a row, duplicates, calendars and coverage, merges and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators import scans
from barquet.operators.digest import number_text

PRICES = ("open", "high", "low", "close", "adj_close")
VALUES = ("open", "high", "low", "close", "volume", "adj_close", "dividend_amount", "split_coefficient")
KEY = ("symbol", "timestamp")


def number(column: Column) -> Column:
    """A tolerant cast: what isn't a number, null and booleans included, is NaN."""
    return F.coalesce(F.when(~F.typeof(column).isin("boolean"), column.cast("string")).try_cast("double"), F.lit(float("nan")))


def finite(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def row_reasons() -> Column:
    """Why a row is rejected, in a fixed order; empty if it isn't. A rule on a value holds only if the value is finite."""
    c = F.col
    rules = [(~finite(n), f"{n}_not_finite_numeric") for n in VALUES]
    rules += [(finite(n) & (c(n) <= 0), f"{n}_not_positive") for n in PRICES]
    rules += [(finite(n) & (c(n) < 0), f"{n}_negative") for n in ("volume", "dividend_amount")]
    rules += [(finite("split_coefficient") & (c("split_coefficient") <= 0), "split_coefficient_not_positive")]
    both = finite("open") & finite("close")
    rules += [(finite("high") & both & (c("high") < F.greatest("open", "close")), "high_below_open_or_close")]
    rules += [(finite("low") & both & (c("low") > F.least("open", "close")), "low_above_open_or_close")]
    return F.array_compact(F.array(*(F.when(rule, F.lit(reason)) for rule, reason in rules)))


def rejections(bars: DataFrame) -> DataFrame:
    return bars.select(*KEY, row_reasons().alias("reasons")).where(F.size("reasons") > 0)


def duplicates(bars: DataFrame) -> DataFrame:
    """Keys that come more than once, and whether their rows conflict. NaN equals NaN here."""
    groups = bars.groupBy(*KEY).agg(F.count("*").alias("row_count"), F.count_distinct(F.struct(*VALUES)).alias("distinct_rows"))
    return groups.where("row_count > 1").select(*KEY, "row_count", (F.col("distinct_rows") > 1).alias("is_conflict"))


def accepted(bars: DataFrame) -> DataFrame:
    """Rows without a reason, identical duplicates once, keys in conflict not at all."""
    good = bars.where(F.size(row_reasons()) == 0).dropDuplicates([*KEY, *VALUES])
    n = F.count("*").over(Window.partitionBy(*KEY))
    return good.withColumn("__n", n).where("__n = 1").drop("__n")


def counters(bars: DataFrame) -> DataFrame:
    """Counts that add up: ``received = accepted + rejected + duplicate + conflicting``, a row a symbol."""
    bad = F.size(row_reasons()) > 0
    flagged = bars.withColumn("__bad", bad)
    groups = flagged.where("not __bad").groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*VALUES)).alias("k"))
    kept = groups.groupBy("symbol").agg(F.count_if(F.col("k") == 1).alias("accepted"), F.sum(F.when(F.col("k") == 1, F.col("n") - 1).otherwise(0)).alias("duplicate"), F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("conflicting"))
    seen = flagged.groupBy("symbol").agg(F.count("*").alias("received"), F.count_if("__bad").alias("rejected"))
    return seen.join(kept, "symbol", "left").na.fill(0)


def in_ranges(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows within any of the ranges (``start, end``, inclusive), however many there are."""
    return scans.within(bars, ranges, F.col("timestamp"))


def coverage(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row a symbol: expected and observed sessions, their ratio, and the longest run of missing ones.

    ``sessions`` (``session``) is a calendar: a row a trading day.
    """
    days = bars.select("symbol", F.to_date("timestamp").alias("session")).distinct()
    expected = sessions.select(F.col("session")).distinct()
    symbols = bars.select("symbol").distinct()
    grid = symbols.join(F.broadcast(expected.agg(F.sort_array(F.collect_set("session")).alias("all")))).select("symbol", F.explode("all").alias("session"))
    seen = grid.join(days.withColumn("seen", F.lit(1)), ["symbol", "session"], "left")
    gaps = missing_groups(bars, sessions).groupBy("symbol").agg(F.max("sessions").alias("longest_gap"))
    sums = seen.groupBy("symbol").agg(F.count("*").alias("expected"), F.count("seen").alias("observed"))
    ratio = F.try_divide(F.col("observed").cast("double"), F.col("expected"))
    return sums.join(gaps, "symbol", "left").select("symbol", "expected", "observed", ratio.alias("coverage"), F.coalesce("longest_gap", F.lit(0)).alias("longest_gap"))


def verdicts(cover: DataFrame, least: float = 0.98, most_gap: int = 2) -> DataFrame:
    """Severity of a symbol's coverage: FATAL below the bounds, WARNING for a tolerated gap, else INFO."""
    bad = (F.col("coverage") < least) | (F.col("longest_gap") > most_gap)
    return cover.withColumn("severity", F.when(bad, "FATAL").when(F.col("longest_gap") > 0, "WARNING").otherwise("INFO"))


def missing_groups(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Runs of consecutive sessions that a symbol lacks: ``symbol, first, last, sessions``.

    Gaps and islands: among missing sessions, the session's number less its rank is the same throughout a run.
    """
    ordered = sessions.select("session").distinct().withColumn("nth", F.row_number().over(Window.orderBy("session")))
    days = bars.select("symbol", F.to_date("timestamp").alias("session")).distinct()
    grid = bars.select("symbol").distinct().join(F.broadcast(ordered.agg(F.collect_list(F.struct("session", "nth")).alias("all")))).select("symbol", F.explode("all").alias("s")).select("symbol", "s.*")
    lost = grid.join(days, ["symbol", "session"], "left_anti")
    island = F.col("nth") - F.row_number().over(Window.partitionBy("symbol").orderBy("nth"))
    return lost.withColumn("island", island).groupBy("symbol", "island").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count("*").alias("sessions")).drop("island")


def merge_keep_last(cached: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row a key; incoming rows win."""
    both = cached.withColumn("__p", F.lit(0)).unionByName(incoming.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(*KEY).orderBy(F.col("__p").desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__p")


def is_close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Equal within bounds; null and NaN equal themselves."""
    near = F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), a.eqNullSafe(b)).otherwise(near | (a == b))


def compare(cached: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Revisions: ``symbol, timestamp, field, cached, refreshed`` for each value that changed, appeared or went."""
    side = lambda f, s: f.select(*KEY, *(F.col(v).alias(f"{v}_{s}") for v in VALUES), F.lit(True).alias(f"has_{s}"))
    both = side(cached, "c").join(side(refreshed, "r"), [*KEY], "full_outer")
    cell = lambda v: F.struct(F.lit(v).alias("field"), F.col(f"{v}_c").alias("cached"), F.col(f"{v}_r").alias("refreshed"))
    changed = lambda v: F.when(F.col("has_c").isNull() | F.col("has_r").isNull() | ~is_close(F.col(f"{v}_c"), F.col(f"{v}_r")), cell(v))
    return both.select(*KEY, F.explode(F.array_compact(F.array(*map(changed, VALUES)))).alias("x")).select(*KEY, "x.*")


def lineage_segments(bars: DataFrame) -> DataFrame:
    """Runs of bars of one source: ``symbol, source, start, end, bars``."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    fresh = F.coalesce(~F.col("source").eqNullSafe(F.lag("source").over(w)) | (F.row_number().over(w) == 1), F.lit(True)).cast("int")
    nth = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("fresh", fresh).withColumn("nth", nth).groupBy("symbol", "source", "nth").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("bars")).drop("nth")


def action_signature(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """SHA-256 of each symbol's ``[[date, dividend, split], ...]`` as compact JSON, over all its rows in order of time.

    A dividend that is negative or not finite, or a split that isn't positive and finite, is an error. The digest is one
    of a sequence, so a symbol's rows meet in a task; ``digest`` has one for tables of any size.
    """
    dividend, split = F.col("dividend_amount"), F.col("split_coefficient")
    wrong = F.when(~finite("dividend_amount") | (dividend < 0), F.raise_error(F.lit("dividend_amount must be finite and not negative")))
    wrong = wrong.when(~finite("split_coefficient") | (split <= 0), F.raise_error(F.lit("split_coefficient must be finite and positive")))
    text = F.concat(F.lit('["'), F.to_date("timestamp").cast("string"), F.lit('",'), number_text("dividend_amount"), F.lit(","), number_text("split_coefficient"), F.lit("]"))
    rows = bars.select(*by, F.struct("timestamp", F.coalesce(wrong.cast("string"), text).alias("text")).alias("row"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["text"]), ",")
    return rows.groupBy(*by).agg(F.sha2(F.concat(F.lit("["), lines, F.lit("]")), 256).alias("signature"))
