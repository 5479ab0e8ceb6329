"""How values are spread: histograms, normal quantile plots, and exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators.scans import running
from barquet.session import scratch

BINS = 80
GROUP = 1_000_000  #: values of a group that a task may sort
GRID = 1000  #: quantiles of a large group that a bracket is taken from
ACCURACY = 20 * GRID

# Wichura's rational approximations to the inverse normal distribution (AS 241), from the constant term up.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _ratio(pair: tuple, x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def inverse_normal(p: Column) -> Column:
    """The value that a standard normal variable is below with probability ``p``; null unless 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    tail = F.when(r <= 5.0, _ratio(MIDDLE, r - 1.6)).otherwise(_ratio(TAIL, r - 5.0))
    central = q * _ratio(CENTRAL, 0.180625 - q * q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, central).otherwise(F.when(q < 0, -tail).otherwise(tail)))


def histogram(rows: DataFrame, by: Sequence[str], value: str, bins: int = BINS) -> DataFrame:
    """``by, bin, low, high, n`` for each of ``bins`` bins of equal width between a group's least and largest value.

    Two passes: bounds, then counts by bin, which are added up before the shuffle. Values that are null or not finite don't
    count. A bin has its lower edge, the last one also the upper; all values of a group of one value are in the first. Bins without
    values have n = 0, groups without values no bins.
    """
    if bins < 1:
        raise ValueError("at least one bin")
    c = F.col(value)
    finite = rows.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).select(*by, c.cast("double").alias("__x"))
    bounds = finite.groupBy(*by).agg(F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    named = bounds.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), "__min", "__max")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
    width = (F.col("__max") - F.col("__min")) / bins
    bin_ = F.when(F.col("__max") > F.col("__min"), F.least(F.floor((F.col("__x") - F.col("__min")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    join = lambda left, right, how: left.join(right, same, how) if by else left.crossJoin(right)
    counts = join(finite, named, "inner").groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), (F.col("__min") + width * F.col("bin")).alias("low"), (F.col("__min") + width * (F.col("bin") + 1)).alias("high"))
    met = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col("bin").alias("__bin"), "n")
    found = every.join(met, [*same, F.col("bin") == F.col("__bin")], "left")
    return found.select(*by, "bin", "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def normal_plot(rows: DataFrame, by: Sequence[str], value: str, size: int | None = None) -> DataFrame:
    """``by, nth, theoretical, observed``: values in order against the normal medians of their order statistics.

    The medians are Filliben's: 1 - 0.5^(1/n) for the first, 0.5^(1/n) for the last, (i - 0.3175) / (n + 0.365) between.
    Nulls and NaN don't count. Values are numbered by a scan in chunks, so a group may be of any size.
    """
    c = F.col(value)
    usable = rows.where(c.isNotNull() & ~F.isnan(c)).select(*by, c.cast("double").alias("observed"), F.monotonically_increasing_id().alias("__id"))
    numbered = running(usable, by, ["observed", "__id"], {"nth": ("count", F.lit(1))}, size=size)
    counts = usable.groupBy(*by).agg(F.count("*").alias("__n")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), "__n")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
    met = numbered.join(counts, same) if by else numbered.crossJoin(counts)
    n, i = F.col("__n").cast("double"), F.col("nth").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    median = F.when(i == n, last).when(i == 1, 1.0 - last).otherwise((i - 0.3175) / (n + 0.365))
    return met.select(*by, "nth", inverse_normal(median).alias("theoretical"), "observed")


def normal_line(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, n, slope, intercept, r`` of the least-squares line through a normal plot; null where there is none."""
    return points.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("observed", "theoretical").alias("slope"), F.regr_intercept("observed", "theoretical").alias("intercept"), F.try_divide(F.covar_samp("observed", "theoretical"), F.stddev_samp("observed") * F.stddev_samp("theoretical")).alias("r")
    )


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """``wanted`` (``by, __rank`` from 1) with ``__value``, the value of that rank in its group, in bounded rounds.

    A group of up to ``limit`` values is counted by value in a task. Larger ones are narrowed first: a sketch of the values
    that a rank may still have gives a bracket about it, counts below and inside, which are exact, take the rank along, and so
    on until few values are left. A round leaves about 3 / GRID of the values, or a single one; a bracket that isn't
    right (the sketch being off by more than it says) is dropped, and the whole group sorted in chunks.
    """
    limit = GROUP if limit is None else limit
    spark = rows.sparkSession
    keys = [f"__k{i}" for i in range(len(by))]
    values = rows.where(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(by, keys, strict=True)), F.col(value).cast("double").alias("__x"))
    asked = wanted.select(*(F.col(k).alias(n) for k, n in zip(by, keys, strict=True)), F.col("__rank").alias("__asked")).distinct()
    counts = values.groupBy(*keys).agg(F.count("*").alias("__n"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    join = lambda left, right: left.join(right, same("v", "t")) if keys else left.crossJoin(right)
    sized = (asked.alias("v").join(counts.alias("t"), same("v", "t")) if keys else asked.crossJoin(counts)).select(*(F.col(f"v.{k}") for k in keys), "__asked", "__n")
    low, high = F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")
    state = sized.select(*keys, "__asked", F.col("__asked").alias("rank"), F.col("__n").alias("left"), low, high)
    inside = (F.col("low").isNull() | (F.col("__x") >= F.col("low"))) & (F.col("high").isNull() | (F.col("__x") <= F.col("high")))
    wide = (F.col("left") > limit) & (F.col("low").isNull() | (F.col("low") < F.col("high")))
    for _ in range(4):
        place = scratch(spark)
        state.write.parquet(place)
        state = spark.read.parquet(place)
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        target = F.broadcast(open_.alias("t"))  # fewer than values / limit
        grades = F.percentile_approx("__x", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("grid")
        sketch = join(values.alias("v"), target).where(inside).groupBy(*(F.col(f"t.{k}") for k in keys), "__asked", "rank", "left", "low", "high").agg(grades)
        at = F.floor(F.col("rank") / F.col("left") * GRID).cast("int")
        bracket = sketch.withColumns({"a": F.get("grid", F.greatest(at - 1, F.lit(0))), "b": F.get("grid", F.least(at + 2, F.lit(GRID)))}).drop("grid")
        named = F.broadcast(bracket.alias("t"))
        told = join(values.alias("v"), named).where(inside).groupBy(*(F.col(f"t.{k}") for k in keys), "__asked", "rank", "left", "low", "high", "a", "b")
        told = told.agg(F.count_if(F.col("__x") < F.col("a")).alias("below"), F.count_if(F.col("__x").between(F.col("a"), F.col("b"))).alias("within"))
        right = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("within")) & (F.col("within") < F.col("left"))
        pick = lambda new, old: F.when(right, new).otherwise(F.col(old)).alias(old)
        closer = told.select(*keys, "__asked", pick(F.col("rank") - F.col("below"), "rank"), pick(F.col("within"), "left"), pick(F.col("a"), "low"), pick(F.col("b"), "high"))
        state = state.where(~F.coalesce(wide, F.lit(False))).unionByName(closer)
    named = state.alias("t")
    kept = join(values.alias("v"), named).where(inside).groupBy(*(F.col(f"t.{k}") for k in keys), "__asked", "rank", "__x").agg(F.count("*").alias("__c"))
    summed = running(kept, [*keys, "__asked"], ["__x"], {"__upto": ("sum", "__c")})
    found = summed.where(F.col("__upto") >= F.col("rank")).groupBy(*keys, "__asked").agg(F.min("__x").alias("__value"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, keys, strict=True)]
    return wanted.join(found, [*on, F.col("__rank") == F.col("__asked")], "left").select(*wanted.columns, "__value")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, tuple[str, float]], limit: int | None = None) -> DataFrame:
    """``by, n`` and a column for each of ``shares`` ({name: (kind, share)}): exact quantiles of groups of any size.

    Kind ``nearest`` is the value of rank ceil(share n), ``linear`` lies between those about share (n - 1). Nulls don't count; NaN is
    larger than any number; a group of nulls has none.
    """
    counts = rows.groupBy(*by).agg(F.count(value).alias("n"))
    spots = []
    for name, (kind, share) in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        nearest = F.greatest(F.ceil(F.lit(share) * F.col("n")), F.lit(1).cast("long"))
        spots += [(name, nearest, F.lit(1.0))] if kind == "nearest" else [(name, F.floor(at) + 1, 1.0 - (at - F.floor(at))), (name, F.least(F.floor(at) + 2, F.col("n")), at - F.floor(at))]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), weight.cast("double").alias("weight")) for name, rank, weight in spots)))
    wanted = counts.where("n > 0").select(*by, "n", each.alias("s")).select(*by, "n", F.col("s.name").alias("__name"), F.col("s.rank").alias("__rank"), F.col("s.weight").alias("__weight"))
    found = order_statistics(rows, by, value, wanted, limit)
    share = lambda name: F.sum(F.when((F.col("__name") == name) & (F.col("__weight") > 0), F.col("__weight") * F.col("__value"))).alias(name)
    return found.groupBy(*by, "n").agg(*(share(name) for name in shares))
