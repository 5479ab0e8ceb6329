"""Local times of daily rows: the day they stand for, and why some stand for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONED = r"(?i)(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$"
NUMBERS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def _there(zone: str, utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_day(rows: DataFrame, column: str, zone: str | None = None, day: str = "day", reason: str = "reason") -> DataFrame:
    """Add ``day`` (date; midnight is left to the reader) and ``reason``, null if there is a day.

    Texts with an offset, and all where ``zone`` is None, stand for their own local day. Others are times of ``zone`` and must have been
    shown by its clocks exactly once: skipped times are ``nonexistent``, repeated ones ``ambiguous``. Nulls are ``missing``, booleans
    and numbers ``not_a_time``, what can't be read ``unreadable``. Dates and timestamps without zone are read as they are.

    A local time is checked by going to UTC with the offsets that hold a day before and a day after, and back.
    """
    kind = dict(rows.dtypes)[column]
    c = F.col(column)
    if kind in NUMBERS or kind.startswith("decimal"):
        return rows.withColumns({day: F.lit(None).cast("date"), reason: F.when(c.isNull(), "missing").otherwise("not_a_time")})
    text = F.trim(c.cast("string"))
    local = text.try_cast("timestamp_ntz") if kind == "string" else c.cast("timestamp_ntz")
    number = text.try_cast("double").isNotNull() & ~text.rlike(r"^\d{4}$|^\d{8}$") if kind == "string" else F.lit(False)
    told = F.when(c.isNull(), "missing").when(number, "not_a_time").when(local.isNull(), "unreadable")
    if zone is not None:
        offsets = [_there(zone, local + F.expr(f"interval '{d}' day")) - (local + F.expr(f"interval '{d}' day")) for d in (-1, 1)]
        fits = [F.coalesce(_there(zone, local - o) == local, F.lit(False)) for o in offsets]
        plain = ~text.rlike(r":.*" + ZONED) if kind == "string" else F.lit(True)
        told = told.when(plain & ~fits[0] & ~fits[1], "nonexistent").when(plain & fits[0] & fits[1] & (offsets[0] != offsets[1]), "ambiguous")
    return rows.withColumn(reason, told).withColumn(day, F.when(F.col(reason).isNull(), F.to_date(local))).select(*(x for x in rows.columns if x not in (day, reason)), day, reason)
