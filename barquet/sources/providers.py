"""Provider files as canonical bars.

Each provider's native columns have a closed map to the canonical ones; whatever a cell holds, it becomes a number or
NaN, and the rules of ``operators.quality`` decide afterwards. Both readers take paths that Spark can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.operators.quality import number
from barquet.schemas import BARS


class ProviderSchemaError(ValueError):
    """The provider's answer doesn't have the columns it should."""


#: Native column names, in lower case, of the two providers.
YAHOO = {"open": "open", "high": "high", "low": "low", "close": "close", "adj close": "adj_close", "volume": "volume", "dividends": "dividend_amount", "stock splits": "split_coefficient"}
ALPHA = {
    "1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. adjusted close": "adj_close",
    "6. volume": "volume", "7. dividend amount": "dividend_amount", "8. split coefficient": "split_coefficient",
}
#: Fields of an answer that is none, and what they mean.
ALPHA_ERRORS = {"Error Message": "schema", "Note": "quota", "Information": "entitlement"}


def canonical(native: DataFrame, symbol: str, source: str, names: dict[str, str], date: str, actions: bool = True) -> DataFrame:
    """Native rows with the canonical columns. Missing dividends and splits are 0 and 1 where the provider covers actions.

    Names are compared in lower case; a name that is missing or ambiguous raises ProviderSchemaError. Rows whose
    date can't be read have a null timestamp.
    """
    have: dict[str, list[str]] = {}
    for c in native.columns:
        have.setdefault(c.strip().lower(), []).append(c)
    clash = [k for k in (*names, date.lower()) if len(have.get(k, [])) > 1]
    optional = ("dividend_amount", "split_coefficient")
    lost = [k for k, v in names.items() if k not in have and v not in optional] + ([] if date.lower() in have else [date])
    if clash or lost:
        raise ProviderSchemaError(f"ambiguous: {clash}, missing: {lost}")
    default = {"dividend_amount": 0.0, "split_coefficient": 1.0}
    value = lambda k, v: number(F.col(f"`{have[k][0]}`")) if k in have else F.lit(default[v] if actions else float("nan"))
    day = F.date_trunc("day", F.try_to_timestamp(F.col(f"`{have[date.lower()][0]}`").cast("string"))).cast("timestamp_ntz")
    made = native.select(day.alias("timestamp"), F.lit(symbol.strip().upper()).alias("symbol"), *(value(k, v).alias(v) for k, v in names.items()), F.lit(source).alias("source"))
    return made.select(*BARS.names)


def read_yahoo_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A daily download with Date, prices, volume and actions."""
    return canonical(spark.read.csv(path, header=True), symbol, "yfinance", YAHOO, "Date")


def read_alpha_json(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A daily adjusted answer: a map of dates to numbered fields. Answers that are errors raise ProviderSchemaError."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    kinds = text.select(*(F.get_json_object("t", f"$['{k}']").isNotNull().alias(v) for k, v in ALPHA_ERRORS.items())).first()
    said = [k for k in ALPHA_ERRORS.values() if kinds and kinds[k]]
    if said:
        raise ProviderSchemaError(f"the provider answered with an error: {said[0]}")
    days = F.from_json(F.get_json_object("t", "$['Time Series (Daily)']"), "map<string,map<string,string>>")
    rows = text.select(F.explode(days).alias("date", "f"))
    native = rows.select(F.col("date"), *(F.col("f")[k].alias(k) for k in ALPHA))
    if rows.isEmpty() or not rows.where(~F.forall(F.array(*map(F.lit, ALPHA)), lambda k: F.array_contains(F.map_keys("f"), k))).isEmpty():
        raise ProviderSchemaError("fields are missing")
    return canonical(native, symbol, "alpha_vantage", ALPHA, "date")


def in_request(bars: DataFrame, start, end) -> DataFrame:
    """Rows of the requested days, both inclusive."""
    return bars.where(F.to_date("timestamp").between(start, end))
