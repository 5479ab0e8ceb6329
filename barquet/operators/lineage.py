"""Where cached bars came from, rebuilt after a fetch or a change of base: segments that cover each row once.

A segment (``symbol, source, start, end, acquired_at, action_coverage, content_hash, action_signature``, bounds as dates)
stands for the bars of its symbol and days. After new ranges have been laid over the cached ones, each bar's origin is looked up
- as one sorted stream, see ``scans`` - and runs of bars of one origin are the new segments, with digests of their own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators import digest, quality
from barquet.operators.quality import KEY, VALUES
from barquet.operators.scans import first_covering, rolling, running, within, written

ORIGIN = ("source", "acquired_at", "action_coverage", "start", "end", "content_hash")
SEGMENT = ("symbol", "start", "end", "source", "acquired_at", "action_coverage", "content_hash", "action_signature", "bars")
UNKNOWN, UNSEGMENTED = "unknown", "unsegmented"
#: What the fields of a stored segment are called, and what they may hold.
FIELDS = ("acquired_at", "action_coverage", "action_signature", "content_hash", "end", "provider", "start")
PROVIDERS = ("yfinance", "alpha_vantage")
COVERAGES = ("full", "partial", "unknown")


def _origin(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ORIGIN))


def _segments(told: DataFrame, size: int | None = None) -> DataFrame:
    """Runs of bars of one ``__told`` origin: ``SEGMENT``. A run has digests of its bars' values and of its actions."""
    order = ["timestamp"]
    before = lambda by: {"__was": F.lag("__told").over(Window.partitionBy(*by).orderBy(*order)), "__first": F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1}
    seen = rolling(told, ["symbol"], order, 1, before, size)
    fresh = (F.col("__first") | ~F.col("__told").eqNullSafe(F.col("__was"))).cast("int")
    numbered = written(running(seen.withColumn("__fresh", fresh).drop("__was", "__first"), ["symbol"], order, {"__run": ("sum", "__fresh")}, size=size))
    group = ["symbol", "__run"]
    runs = numbered.groupBy(*group).agg(F.to_date(F.min("timestamp")).alias("first"), F.to_date(F.max("timestamp")).alias("last"), F.first("__told").alias("o"), F.count("*").alias("bars"))
    hashes = digest.digests(numbered, group, order, ["timestamp", *VALUES, "source"], size=size).select(*group, F.col("digest").alias("content_hash"))
    signs = quality.action_signature(numbered, tuple(group)).withColumnRenamed("signature", "action_signature")
    joined = runs.join(hashes, group).join(signs, group)
    return joined.select("symbol", F.col("first").alias("start"), F.col("last").alias("end"), "o.source", "o.acquired_at", "o.action_coverage", "content_hash", "action_signature", "bars")


def rebuild(bars: DataFrame, cached: DataFrame, refreshed: DataFrame, default_time: dt.datetime, size: int | None = None) -> DataFrame:
    """The segments of ``bars`` after a fetch.

    ``refreshed`` has a row for each fetched bar (``symbol, timestamp``, the fields of ``ORIGIN`` for its range, and
    ``position``, of which the last counts). Other bars keep the origin of the first cached segment of their source that covers
    their day; a bar of none is a segment of its own day and source, of unknown coverage, as of ``default_time``.
    Segments of different origin stay apart even where they look alike. Bars are unique by symbol and time.
    """
    new = refreshed.groupBy(*KEY).agg(F.max_by(_origin(), "position").alias("__new"))
    facts = {f"__{c}": c for c in ORIGIN}
    looked = first_covering(bars, cached, ["symbol", "source"], F.to_date("timestamp"), "start", "end", facts, ["acquired_at"], found="__old", size=size)
    day = F.to_date("timestamp")
    bare = {"source": F.col("source"), "acquired_at": F.lit(default_time.isoformat(sep=" ")).cast("timestamp_ntz"), "action_coverage": F.lit(UNKNOWN), "start": day, "end": day, "content_hash": F.lit(UNSEGMENTED)}
    origin = F.coalesce("__new", F.when(F.col("__old"), _origin("__")), F.struct(*(v.alias(k) for k, v in bare.items())))
    told = looked.join(new, [*KEY], "left").withColumn("__told", origin)
    return _segments(written(told.select(*bars.columns, "__told")), size)


def uncovered(bars: DataFrame, existing: DataFrame, incoming: DataFrame, replaced: DataFrame, size: int | None = None) -> DataFrame:
    """``symbol, timestamp`` of the bars that ``rebase`` has no segment for."""
    return _rebased(bars, existing, incoming, replaced, size).where("__told is null").select(*KEY)


def _rebased(bars: DataFrame, existing: DataFrame, incoming: DataFrame, replaced: DataFrame, size: int | None = None) -> DataFrame:
    day = F.to_date("timestamp")
    inside = within(bars.select(*KEY), replaced, day, by=["symbol"], size=size).withColumn("__inside", F.lit(True))
    both = existing.withColumn("__side", F.lit(False)).unionByName(incoming.withColumn("__side", F.lit(True)), allowMissingColumns=True)
    sided = bars.join(inside, [*KEY], "left").withColumn("__side", F.coalesce("__inside", F.lit(False))).drop("__inside")
    found = first_covering(sided, both, ["symbol", "__side"], day, "start", "end", {f"__{c}": c for c in ORIGIN}, ["acquired_at"], found="__hit", size=size)
    return found.withColumn("__told", F.when(F.col("__hit"), _origin("__"))).select(*bars.columns, "__told")


def rebase(bars: DataFrame, existing: DataFrame, incoming: DataFrame, replaced: DataFrame, size: int | None = None) -> DataFrame:
    """The segments of ``bars`` after ``incoming`` has been merged into a newer base with the segments ``existing``.

    Bars of the ranges ``replaced`` (``symbol, start, end``) have the origin of the first incoming segment that covers their
    day, all others that of the first existing one; ValueError if a bar has none.
    """
    told = written(_rebased(bars, existing, incoming, replaced, size))
    bare = told.where("__told is null").select(*KEY).limit(3).collect()
    if bare:
        raise ValueError("the rebased lineage doesn't cover every bar: " + ", ".join(f"{r.symbol} {r.timestamp}" for r in bare))
    return _segments(told, size)


def _wrong(kind: Column, value) -> Column:
    """Why a stored segment (its fields as text by ``value(name)``, its shape by ``kind``) isn't one; null if it is."""
    shape = "OBJECT<" + ", ".join(f"{f}: STRING" for f in FIELDS) + ">"
    start, end = value("start").try_cast("date"), value("end").try_cast("date")
    a_date = lambda name: value(name).rlike(r"^\d{4}-\d\d-\d\d$") & value(name).try_cast("date").isNotNull()
    an_instant = value("acquired_at").rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|\+00:00)$") & value("acquired_at").try_cast("timestamp").isNotNull()
    rules = [(~kind.startswith("OBJECT<"), F.lit("not an object"))]
    rules += [(~kind.contains(f"{f}: "), F.lit(f"lacks {f}")) for f in FIELDS]
    rules += [(kind != shape, F.lit("has other fields, or fields that aren't text"))]
    rules += [(~a_date(name), F.lit(f"{name} is no date")) for name in ("start", "end")]
    rules += [(end < start, F.lit("ends before it starts")), (~value("provider").isin(*PROVIDERS), F.lit("unknown provider")), (~an_instant, F.lit("acquired_at is no UTC time"))]
    rules += [(~value("action_coverage").isin(*COVERAGES), F.lit("unknown action_coverage")), (~value("content_hash").rlike("^[0-9a-f]{64}$"), F.lit("content_hash is no SHA-256"))]
    rules += [(value("action_signature") == "", F.lit("action_signature is empty"))]
    out = F.when(*rules[0])
    for rule, reason in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(True)), reason)
    return out


def read_documents(documents: DataFrame, name: str = "id", document: str = "document") -> tuple[DataFrame, DataFrame]:
    """Stored lineage (a JSON list of segments for each row) as ``(segments, rejections)``.

    Segments: ``id, position`` and the fields. Rejections: ``id, position, reason``, the first segment that is wrong, by
    position, or null for the whole document. One wrong segment rejects its document, with all its segments: not an object, a
    field too many, too few or not text, a value that its field can't have, or days of an earlier segment of the list.
    """
    parsed = F.try_parse_json(F.col(document))
    rows = documents.select(F.col(name).alias("id"), F.col(document).alias("__text"), parsed.alias("__v")).withColumn("__kind", F.schema_of_variant("__v"))
    whole = F.when(F.col("__text").isNull(), "no document").when(F.col("__v").isNull(), "not JSON").when(~F.col("__kind").startswith("ARRAY<"), "not a list")
    rows = rows.withColumn("__whole", whole)
    items = rows.where("__whole is null").select("id", F.posexplode(F.variant_get("__v", "$", "array<variant>")).alias("position", "__item"))
    kind = F.schema_of_variant("__item")
    text = {f: F.when(kind.contains(f"{f}: STRING"), F.try_variant_get("__item", f"$.{f}", "string")) for f in FIELDS}
    each = items.select("id", "position", kind.alias("__kind"), *(v.alias(f) for f, v in text.items()))
    each = each.withColumn("__wrong", _wrong(F.col("__kind"), F.col))
    dates = {c: F.col(c).try_cast("date") for c in ("start", "end")}
    # Sorted by start, a segment that shares days with another begins before the furthest end so far.
    clear = each.where("__wrong is null").withColumns({f"__{c}": v for c, v in dates.items()})
    met = running(clear, ["id"], ["__start", "__end", "position"], {"__reach": ("max", "__end")}, inclusive=False)
    overlaps = met.where("__start <= __reach").select("id", "position", F.lit("shares days with another segment").alias("reason"))
    bad = rows.where("__whole is not null").select("id", F.lit(None).cast("int").alias("position"), F.col("__whole").alias("reason"))
    bad = bad.unionByName(each.where("__wrong is not null").select("id", "position", F.col("__wrong").alias("reason"))).unionByName(overlaps)
    rejected = bad.groupBy("id").agg(F.min_by(F.struct("position", "reason"), F.coalesce("position", F.lit(-1))).alias("r")).select("id", "r.*")
    fields = ["id", "position", "start", "end", "provider", F.col("acquired_at").try_cast("timestamp").alias("acquired_at"), "action_coverage", "content_hash", "action_signature"]
    good = each.withColumns(dates).select(*fields).alias("e").join(rejected.select(F.col("id").alias("__id")), F.col("e.id").eqNullSafe(F.col("__id")), "left_anti")
    return good, rejected
