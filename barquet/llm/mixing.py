"""Mixing of sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words; all its documents then have the same number of expected copies,
``rate = target / source words``. Laid end to end in a fixed order, the documents of a source cover
``[0, n * rate)``; with one random offset a document is taken once for each integer that its stretch crosses, so
it is taken ``floor(rate)`` or ``ceil(rate)`` times. The order is by size class, so every class keeps its share.

Texts are read once, for their words and a hash: what is ranked are narrow rows, equal ones as one. They are dealt out by
ranges of the whole order, id included, so a source, size class or group of copies that holds a third of all rows is
spread like any other. Rows are ranked within (source, range), the ranges' counts are summed up within the source, and
both add up to the prefix sum. Documents meet their copies in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.graph import written

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 50_000  #: rows of a range at about, and of the groups of hashes that a size class is laid out in
RANGES = 10_000  #: at most; beyond CELL_ROWS * RANGES rows, ranges get longer


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words; no target
    passes ``most`` times its source's words. Sources are filled up in the order of ``cap / weight``: one is full
    if, with all before it full, an even spread of the rest by weight would still pass its cap. The table has a row
    per source after the aggregation; its windows never see documents.
    """
    weigh = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weigh)
    by_fill = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    full = F.col("level") * F.col("w") >= F.col("source_size") * most
    # The level of the first source that isn't full holds for all after it.
    first = F.min(F.when(~full, F.struct("nth", "level"))).over(everything)["level"]
    return (
        totals.withColumns({"level": level, "nth": F.row_number().over(by_fill)})
        .withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(first * F.col("w")))
        .select("source", "source_size", "target")
    )


def _hash(text: Column) -> Column:
    """The hash that orders texts of one size class."""
    return F.substr(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(1), F.lit(16))


def _known(column: Column) -> Column:
    """A column as text without nulls, so that equal values meet in plain joins and windows."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


ROW = ("__source", "__id", "__hash")
ORDER = ("__class", "__group", "size", "__hash", "id")  #: of a source's documents
MADE = ("size", "source_size", "target", "copies", "taken")


def _ordered(rows: DataFrame) -> DataFrame:
    """One row for all equal rows of ``id, source, size, __hash``: how many they are (``m``), the columns of the order, and
    the range of it that they are in."""
    equal = written(rows.groupBy("id", "source", "size", "__hash").agg(F.count("*").alias("m")))
    groups = max(1, -(-equal.count() // CELL_ROWS))
    dealt = equal.withColumns(
        {
            "__source": _known(F.col("source")),
            "__id": _known(F.col("id")),
            "__class": F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"),
            "__group": F.pmod(F.conv(F.substr("__hash", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(groups)),
        }
    )
    ranges = dealt.repartitionByRange(min(groups, RANGES), "__source", *ORDER)
    return written(ranges.withColumn("__range", F.spark_partition_id()))


def _ranked(rows: DataFrame, seed: int, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """The rows of ``_ordered`` with the number of documents before them in their source, and what ``_copies`` needs."""
    ordered = _ordered(rows)
    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.withColumn("__in_range", before(Window.partitionBy("__source", "__range").orderBy(*ORDER)))
    counts = ordered.groupBy("__source", "__range").agg(F.sum("m").alias("m"))
    starts = counts.withColumn("__start", before(Window.partitionBy("__source").orderBy("__range"))).drop("m")
    targets = source_targets(ordered.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most)
    targets = targets.withColumns({"__source": _known(F.col("source")), "__draw": F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")))}).drop("source")
    plan = starts.join(targets, "__source")
    offset = F.conv(F.substr(F.md5("__draw"), F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.join(plan, ["__source", "__range"]).select(
        *ROW, "id", "source", "size", "m", "source_size", "target", (F.col("__start") + F.col("__in_range")).alias("__before"), offset.alias("__offset"), rate.alias("__rate")
    )


def _copies(j: Column | str) -> Column:
    """Integers that the stretch of the j-th of equal rows crosses."""
    upto = lambda n: F.floor(F.col("__offset") + n * F.col("__rate"))
    nth = F.col("__before") + j
    return (upto(nth) - upto(nth - 1)).cast("long")


def shares(
    docs: DataFrame,
    seed: int,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """A row for every document, without its text: id, source and ``size, source_size, target, copies, taken``, as ``mix``."""
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(col(doc_id).alias("id"), col(source).cast("string").alias("source"), word_count(col(text)).alias("size"), _hash(col(text)).alias("__hash"))
    each = _ranked(rows, seed, weights, share, most).withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    out = each.withColumn("copies", _copies(F.col("__j"))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(doc_id), F.col("source").alias(source), *MADE)


def mix(
    docs: DataFrame,
    seed: int,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Add ``size, source_size, target, copies, taken`` to every document.

    ``copies`` says how often the mix takes the document (at most ``most`` times), ``taken`` is ``copies * size``.
    The offset of a source is a hash of ``seed`` and its name, so reruns agree whatever the partitioning.

    Defined cases: null or empty texts have size 0 and add no words; null sources form a source of their own;
    repeated rows are documents of their own, and which of them a copy falls to makes no difference; with no
    rows, or no words at all, nothing is taken. Input columns named like the five results are replaced.
    """
    rows = docs.drop(*(c for c in MADE if c in docs.columns))
    col = lambda c: F.col(f"`{c}`")
    narrow = docs.select(col(doc_id).alias("id"), col(source).cast("string").alias("source"), word_count(col(text)).alias("size"), _hash(col(text)).alias("__hash"))
    ranked = written(_ranked(narrow, seed, weights, share, most).drop("id", "source"))
    keyed = rows.withColumns({"__source": _known(col(source)), "__id": _known(col(doc_id)), "__hash": _hash(col(text))})
    met = keyed.join(ranked, list(ROW))
    j = F.lit(1)
    if not ranked.where("m > 1").isEmpty():  # which of equal rows is which: the join has brought them together
        met, j = met.withColumn("__j", F.row_number().over(Window.partitionBy(*ROW).orderBy("__hash"))), F.col("__j")
    out = met.withColumn("copies", _copies(j)).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(col(c) for c in rows.columns), *MADE)


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, without the columns that ``mix`` adds but ``copies``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
