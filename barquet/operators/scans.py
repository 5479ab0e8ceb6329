"""Running and rolling aggregates of series that are too long for one task, and look-ups of intervals by sorted streams.

A plain window puts a whole series into one task. Here a series of more than ``CHUNK`` rows is cut into chunks by
quantiles of its order column, so that rows of one value stay together. Each chunk is a window of its own; what
goes from chunk to chunk is small: for a running aggregate one state a chunk, whose own running aggregate is the carry
of the next ones, and for a rolling one the last rows before the chunk. Short series are one chunk and cost a count more.
A row finds its chunk by a binary search of the cuts. Where rows need both kinds, ``scan`` cuts, deals and sorts them once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.session import scratch

CHUNK = 1_000_000  #: rows of a chunk, at about
GRAIN = 1024  #: quantiles that chunks are cut at, at most
RANGES = 256  #: ranges at most that rows are compared with one by one


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    """Equal keys, nulls included, of two aliased frames."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by), F.lit(True))


def _below(cuts: str, value: Column) -> Column:
    """How many of the cuts (sorted, at most ``GRAIN``) are less than the value, bit by bit from the highest; none for null."""
    bits = F.array(*(F.lit(1 << k) for k in reversed(range(GRAIN.bit_length()))))
    return F.aggregate(bits, F.lit(0), lambda n, bit: F.when(F.get(F.col(cuts), n + bit - 1) < value, n + bit).otherwise(n))


def chunked(rows: DataFrame, by: Sequence[str], at: str, size: int | None = None) -> tuple[DataFrame, bool]:
    """``rows`` with ``__chunk`` (int): rising with ``at`` within a series; and whether any series has more than one.

    Only series of more than ``size`` rows are cut, so the cuts are fewer than rows / size, whatever the number of series.
    The rows are then written to the shared folder, as the steps that follow read them more than once.
    """
    size = CHUNK if size is None else size
    long = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > size)
    if long.isEmpty():
        return rows.withColumn("__chunk", F.lit(0)), False
    grades = [k / GRAIN for k in range(1, GRAIN)]
    met = rows.alias("r").join(F.broadcast(long.alias("l")), _same("r", "l", by)).select("r.*", "__n")
    found = met.groupBy(*by).agg(F.max("__n").alias("__n"), F.percentile_approx(at, grades, 10 * GRAIN).alias("__all"))
    stride = F.greatest(F.floor(F.lit(GRAIN) / F.ceil(F.col("__n") / size)), F.lit(1)).cast("int")
    cuts = found.withColumn("__stride", stride).withColumn("__cuts", F.array_distinct(F.expr("filter(__all, (x, i) -> (i + 1) % __stride = 0)")))
    cuts = F.broadcast(cuts.select(*by, "__cuts").alias("c"))
    chunk = _below("__cuts", F.col(f"r.{at}"))
    own = rows.alias("r").join(cuts, _same("r", "c", by), "left").select("r.*", F.when(F.col("__cuts").isNull(), 0).otherwise(chunk).alias("__chunk"))
    return written(own), True


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which is gone when the application ends."""
    place = scratch(rows.sparkSession)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


_AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], made: dict[str, tuple[str, Column | str]], inclusive: bool = True, size: int | None = None) -> DataFrame:
    """Add running aggregates ``{name: (kind, value)}`` of each series in ``order``, ascending with nulls first.

    Kinds are sum, max, min, count and last (the last value that isn't null); nulls don't count, and before the first value
    sum, max, min and last are null. With ``inclusive`` the row itself counts. The first order column cuts the chunks.
    """
    own, cut = chunked(rows.withColumns(_values(made)), by, order[0], size)
    return _run(own, cut, rows.columns, by, order, made, inclusive).drop("__chunk")


def rolling(rows: DataFrame, by: Sequence[str], order: Sequence[str], before: int, made: Callable[[tuple[str, ...]], dict[str, Column]], size: int | None = None) -> DataFrame:
    """Add columns whose windows look back at most ``before`` rows.

    ``made(partition)`` gives them; their windows have to be partitioned by ``partition`` and sorted by ``order``. A chunk
    sees as many rows before it as there are, up to ``before``.
    """
    own, cut = chunked(rows, by, order[0], size)
    return _roll(own, cut, by, order, before, made).drop("__chunk")


def scan(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], before: int, rolled: Callable[[tuple[str, ...]], dict[str, Column]], run: dict[str, tuple[str, Column | str]], size: int | None = None
) -> DataFrame:
    """``rolling`` with ``rolled``, then ``running`` with ``run``, whose values may use what was rolled: cut, dealt and sorted once."""
    own, cut = chunked(rows, by, order[0], size)
    own = _roll(own, cut, by, order, before, rolled)
    columns = [c for c in own.columns if c != "__chunk"]
    return _run(own.withColumns(_values(run)), cut, columns, by, order, run).drop("__chunk")


def _values(made: dict[str, tuple[str, Column | str]]) -> dict[str, Column]:
    return {f"__v{k}": F.col(v) if isinstance(v, str) else v for k, (_, v) in enumerate(made.values())}


def _run(own: DataFrame, cut: bool, columns: Sequence[str], by: Sequence[str], order: Sequence[str], made: dict[str, tuple[str, Column | str]], inclusive: bool = True) -> DataFrame:
    """Running aggregates of rows that have their chunk and ``_values``: the columns, the chunk and what is made."""
    kinds = {name: (kind, f"__v{k}") for k, (name, (kind, _)) in enumerate(made.items())}
    kept = [c for c in columns if c not in made]
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = own.withColumns({name: _AGGREGATES[kind](F.col(v)).over(inside) for name, (kind, v) in kinds.items()})
    if not cut:
        return local.drop(*(v for _, v in kinds.values()))
    at = F.struct(*order)
    state = lambda kind, v: F.max_by(v, F.when(F.col(v).isNotNull(), at)) if kind == "last" else _AGGREGATES[kind](F.col(v))
    states = own.groupBy(*by, "__chunk").agg(*(state(kind, v).alias(v) for kind, v in kinds.values()))
    past = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda kind, v: (F.sum if kind == "count" else _AGGREGATES[kind])(F.col(v)).over(past).alias(f"__c{v}")
    carry = states.select(*by, "__chunk", *(over(kind, v) for kind, v in kinds.values())).where("__chunk > 0")

    def both(name: str, kind: str, v: str) -> Column:
        mine, past = F.col(f"r.{name}"), F.col(f"__c{v}")
        if kind in ("sum", "count"):
            return F.when(past.isNull(), mine).when(mine.isNull(), past).otherwise(mine + past)
        return F.coalesce(mine, past) if kind == "last" else (F.greatest if kind == "max" else F.least)(mine, past)

    # No more carries than cuts, which were broadcast, so the rows stay where they are.
    met = local.alias("r").join(F.broadcast(carry.alias("s")), _same("r", "s", [*by, "__chunk"]), "left")
    return met.select(*(F.col(f"r.{c}") for c in (*kept, "__chunk")), *(both(name, kind, v).alias(name) for name, (kind, v) in kinds.items()))


def _roll(own: DataFrame, cut: bool, by: Sequence[str], order: Sequence[str], before: int, made: Callable[[tuple[str, ...]], dict[str, Column]]) -> DataFrame:
    """Rolling columns of rows that have their chunk, which they keep."""
    partition = (*by, "__chunk")
    if not cut:
        return own.withColumns(made(partition))
    counts = own.groupBy(*partition).agg(F.count("*").alias("__n"))
    series = Window.partitionBy(*by).orderBy("__chunk")
    parts = counts.withColumn("__end", F.sum("__n").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    # A chunk has a row at least, so no more than ``before`` chunks can see into one.
    later = F.collect_list(F.struct(F.col("__chunk").alias("to"), (F.col("__end") - F.col("__n")).alias("begin"))).over(series.rowsBetween(1, max(before, 1)))
    reach = parts.withColumn("__later", later).select(*partition, "__end", F.explode("__later").alias("q"))
    gap = F.col("q.begin") - F.col("__end")  # rows between the two chunks
    reach = reach.select(*partition, F.col("q.to").alias("__to"), gap.alias("__gap")).where(F.col("__gap") < before)
    back = F.row_number().over(Window.partitionBy(*partition).orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    tails = own.withColumn("__back", back).where(F.col("__back") <= before).alias("t")
    halo = tails.join(reach.alias("h"), _same("t", "h", partition)).where(F.col("__gap") + F.col("__back") <= before)
    halo = halo.select(*(F.col(f"t.{c}") for c in own.columns if c != "__chunk"), F.col("__to").alias("__chunk"), F.lit(False).alias("__own"))
    both = own.withColumn("__own", F.lit(True)).unionByName(halo)
    return both.withColumns(made(partition)).where("__own").drop("__own")


def disjoint(intervals: DataFrame, by: Sequence[str], start: str, end: str, order: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """What each interval (inclusive bounds) covers that none before it, by start, end and ``order``, does.

    An earlier interval that reaches beyond a later one's start covers all from there to its end, so what is left is one piece:
    it begins with the interval (``__after`` false) or after the furthest end so far (``__after`` true), at ``__from``.
    Intervals with a null bound, or an end before the start, cover nothing.
    """
    real = intervals.where(F.col(start) <= F.col(end))
    reached = running(real, by, [start, end, *order], {"__reach": ("max", end)}, inclusive=False, size=size)
    after = F.coalesce(F.col("__reach") >= F.col(start), F.lit(False))
    left = reached.withColumns({"__after": after, "__from": F.when(after, F.col("__reach")).otherwise(F.col(start))})
    return left.where(F.col("__reach").isNull() | (F.col(end) > F.col("__reach"))).drop("__reach")


def first_covering(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], at: Column, start: str, end: str, facts: dict[str, str], order: Sequence[str] = (), found: str | None = None, size: int | None = None
) -> DataFrame:
    """``points`` with ``facts`` (new name: column of ``intervals``) of the first interval of their key that covers ``at``.

    First by start, end and ``order``; null where none does, also where the key or ``at`` is null. ``found`` names a column that says
    whether one does. Points and interval pieces pass as one sorted stream in which the last piece before a point is the
    only one that can cover it, so no point meets more than one interval and no key is too hot for a task.
    """
    real = intervals.where(F.col(start) <= F.col(end))
    for c in by:
        real = real.where(F.col(c).isNotNull())
    pieces = disjoint(real, by, start, end, order, size)
    told = F.struct(F.col(end).alias("end"), *(F.col(c).alias(f"f{k}") for k, c in enumerate(facts.values())))
    # At one place: pieces that begin there, points, pieces that begin after it.
    key = {f"__k{i}": c for i, c in enumerate(by)}
    named = lambda frame: [F.col(c).alias(k) for k, c in key.items()]
    opened = pieces.select(*named(pieces), F.col("__from").alias("__at"), F.when(F.col("__after"), 2).otherwise(0).alias("__kind"), told.alias("__piece"))
    asked = points.select(*(F.col(c) for c in points.columns), *named(points), at.alias("__at"), F.lit(1).alias("__kind"))
    stream = asked.unionByName(opened, allowMissingColumns=True)
    last = running(stream, list(key), ["__at", "__kind"], {"__open": ("last", "__piece")}, size=size).where("__kind = 1")
    covers = F.coalesce(F.col("__open.end") >= F.col("__at"), F.lit(False))
    for k in key:
        covers = covers & F.col(k).isNotNull()
    out = {new: F.when(covers, F.col(f"__open.f{k}")) for k, new in enumerate(facts)}
    if found:
        out[found] = covers
    return last.select(*(F.col(c) for c in points.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def within(points: DataFrame, ranges: DataFrame, at: Column, start: str = "start", end: str = "end", by: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """The points within any of the ranges (inclusive), each once.

    Few ranges, by a count, are compared with the rows where these are; more of them go through the sorted stream.
    """
    if not by and ranges.limit(RANGES + 1).count() <= RANGES:
        few = F.broadcast(disjoint(ranges, by, start, end).select(F.col("__from").alias("__a"), F.col(end).alias("__b"), "__after"))
        return points.join(few, (at <= F.col("__b")) & ((at > F.col("__a")) | ((at == F.col("__a")) & ~F.col("__after"))), "left_semi")
    return first_covering(points, ranges, by, at, start, end, {}, found="__in", size=size).where("__in").select(*points.columns)
