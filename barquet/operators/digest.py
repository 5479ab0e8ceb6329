"""Digests of tables: SHA-256 over canonical rows in order, in ranges that name what has changed.

A table's digest is that of its ranges' digests, level by level, ``FAN`` at a time: no task has more than that many rows
or digests of a group, and how the rows are partitioned makes no difference. A changed value changes the digest of its range,
so two tables are compared by their ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.operators.scans import running

FAN = 1024  #: rows of a range, and digests that are put together


def number_text(name: str) -> Column:
    """A double as JSON writes it in Python: the shortest digits, with an exponent from 1e16 on and below 1e-4.

    Sixteen digits if they are the same number again, else seventeen (before version 19 of the JVM the last of them can be
    another one that reads as the same number). Spark's own text has exponents from 1e7 on and below 1e-3, and a digit
    too many more often. NaN and infinities are theirs in JSON.
    """
    x = F.col(name).cast("double")
    short, long = (F.format_string(f"%.{k}e", F.abs(x)) for k in (15, 16))
    written = F.when(short.try_cast("double") == F.abs(x), short).otherwise(long)
    mantissa, power = F.substring_index(written, "e", 1), F.substring_index(written, "e", -1).try_cast("int")
    digits = F.rtrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    n = F.length(digits)
    positional = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(
        F.when(n <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    compact = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), n)))
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(compact, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    text = F.when(power.between(-4, 15), positional).otherwise(scientific)
    minus = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(minus, F.lit("Infinity"))).when(x.isNotNull(), F.concat(minus, text))


def _canonical(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A row as text: values as lengths and characters, so that no two rows are the same text; null is told from empty.

    Doubles are written in hex, which is exact and the same on any JVM.
    """
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        value = F.col(c).cast("string")
        if kinds[c] in ("double", "float"):
            value = F.when(F.col(c).isNotNull(), F.format_string("%a", F.col(c).cast("double")))
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat_ws(",", *(text(c) for c in columns))


def ranges(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, fan: int | None = None, size: int | None = None) -> DataFrame:
    """``by, range, rows, first, last, digest``: SHA-256 of each ``fan`` rows of a group in ``order``, numbered from 0.

    Rows that are equal in ``order`` come in the order of their canonical text, so the digest depends on the rows alone.
    """
    fan = fan or FAN
    columns = [c for c in (columns or rows.columns) if c not in by]
    named = rows.select(*by, *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), _canonical(rows, columns).alias("__row"))
    at = [f"__o{i}" for i in range(len(order))]
    numbered = running(named, by, [*at, "__row"], {"__place": ("count", F.lit(1))}, size=size)
    leaf = numbered.groupBy(*by, F.floor((F.col("__place") - 1) / fan).alias("range"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", "__row"))), lambda x: x["__row"]), "\n")
    return leaf.agg(F.count("*").alias("rows"), F.min_by(at[0], "__place").alias("first"), F.max_by(at[0], "__place").alias("last"), F.sha2(lines, 256).alias("digest"))


def digests(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, fan: int | None = None, size: int | None = None) -> DataFrame:
    """``by, rows, digest``: one digest for each group, put together from those of its ranges, ``fan`` at a time.

    There are as many levels as the largest group needs; a group of one range has its digest put together once, too.
    """
    fan = fan or FAN
    level = ranges(rows, by, order, columns, fan, size).select(*by, F.col("range").alias("at"), "rows", "digest")
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = -(-largest // fan)
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        level = level.groupBy(*by, F.floor(F.col("at") / fan).alias("at")).agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest"))
        n = -(-n // fan)
        if n <= 1:
            return level.drop("at")


def changed_ranges(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of two results of ``ranges``: ``by, range`` and both digests, where they differ or one side has none."""
    side = lambda frame, name: frame.select(*by, "range", F.col("digest").alias(name))
    both = side(left, "left").join(side(right, "right"), [*by, "range"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def file_digests(spark, path: str) -> DataFrame:
    """``path, length, digest``: SHA-256 of the bytes of each Parquet file below ``path``, as Spark reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))
