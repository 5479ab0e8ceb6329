"""Chunked scans against plain windows, interval look-ups against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barquet.functions import indicators
from barquet.operators import scans


def series(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), i, rng.choice([None, *range(-9, 10)])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(6)


@pytest.mark.parametrize("size", [7, 40, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_a_window(spark, size, inclusive):
    rows = series(spark, size)
    kinds = {"s": "sum", "m": "max", "l": "min", "c": "count", "z": "last"}
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumns({n: scans._AGGREGATES[k](F.col("v")).over(w) for n, k in kinds.items()})
    got = scans.running(rows, ["k"], ["t", "i"], {n: (k, "v") for n, k in kinds.items()}, inclusive, size)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert scans.running(rows.limit(0), ["k"], ["t", "i"], {"s": ("sum", "v")}, size=size).count() == 0


@pytest.mark.parametrize("size", [3, 25, 1000])
def test_rolling_equals_a_window(spark, size):
    rows = series(spark, size)

    def made(by):
        w = Window.partitionBy(*by).orderBy("t", "i")
        return {"before": F.lag("i", 5).over(w), "sum": F.sum("v").over(w.rowsBetween(-5, 0)), "n": F.least(F.row_number().over(w), F.lit(6))}

    want = rows.withColumns(made(("k",)))
    got = scans.rolling(rows, ["k"], ["t", "i"], 5, made, size)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_long_series_is_spread(spark):
    """Two million points of one series: all partitions have a share, results are those of the window."""
    rows = spark.range(2_000_000).select(F.lit("x").alias("symbol"), F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("timestamp"), (F.pmod(F.xxhash64("id"), F.lit(1001)) - 500).alias("v"))
    got = scans.running(rows, ["symbol"], ["timestamp"], {"s": ("sum", "v"), "m": ("max", "v")}, size=200_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # all of it is one small partition otherwise
    shares = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(shares) < 1_200_000 and sum(shares) == 2_000_000
    w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    check = lambda frame: frame.agg(F.sum(F.xxhash64("timestamp", "s", "m").cast("decimal(38,0)"))).first()[0]
    assert check(got) == check(rows.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w)}))
    mean = scans.rolling(rows, ["symbol"], ["timestamp"], 9, lambda by: {"mean": indicators.sma("v", 10, by)}, size=200_000)
    sums = lambda frame: frame.agg(F.count("mean"), F.sum(F.round(F.col("mean") * 10).cast("long") * F.pmod(F.unix_timestamp(F.col("timestamp").cast("timestamp")), F.lit(9973)))).first()
    assert sums(mean) == sums(rows.withColumn("mean", indicators.sma("v", 10)))


@pytest.mark.parametrize("size", [5, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_first_covering_equals_brute_force(spark, seed, size):
    rng = random.Random(seed)
    day = lambda k: None if k is None else dt.date(2024, 1, 1) + dt.timedelta(k)
    spans = []
    for i in range(40):
        a = rng.choice([None, *range(40)])
        spans.append((rng.choice(["a", "b", None]), a, None if a is None else a + rng.randrange(-2, 12), i))
    points = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-2, 60)]), i) for i in range(120)]
    lines = spark.createDataFrame([(k, day(a), day(b), i) for k, a, b, i in spans], "k string, start date, end date, name int").repartition(3)
    asked = spark.createDataFrame([(k, day(t), i) for k, t, i in points], "k string, t date, i int").repartition(3)
    got = scans.first_covering(asked, lines, ["k"], F.col("t"), "start", "end", {"name": "name", "began": "start"}, ["name"], found="hit", size=size)
    assert got.columns == ["k", "t", "i", "name", "began", "hit"]

    def plain(k, t):
        if k is None or t is None:
            return None
        fit = [(a, b, i) for key, a, b, i in spans if key == k and a is not None and a <= t <= b]
        return min(fit)[2] if fit else None

    assert {r.i: r.name for r in got.collect()} == {i: plain(k, t) for k, t, i in points}
    began = {i: a for _, a, _, i in spans}
    assert all(r.hit == (r.name is not None) and r.began == (day(began[r.name]) if r.hit else None) for r in got.collect())


@pytest.mark.parametrize("n", [0, 5, 600])
def test_within(spark, n):
    rng = random.Random(n)
    spans = [(a := rng.randrange(5000), a + rng.randrange(-1, 9)) for _ in range(n)]
    points = [rng.choice([None, *range(5000)]) for _ in range(800)]
    got = scans.within(spark.createDataFrame([(p, i) for i, p in enumerate(points)], "p int, i int"), spark.createDataFrame(spans, "start int, end int"), F.col("p"))
    assert sorted(r.i for r in got.collect()) == [i for i, p in enumerate(points) if p is not None and any(a <= p <= b for a, b in spans)]


def test_look_up_has_no_fan_out(spark):
    """A thousand intervals over every point: the plan makes no more rows than points and intervals."""
    lines = spark.range(1000).select(F.lit("a").alias("k"), F.lit(0).alias("start"), (F.col("id") + 1000).cast("int").alias("end"))
    asked = spark.range(3000).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("t"))
    got = scans.first_covering(asked, lines, ["k"], F.col("t"), "start", "end", {"e": "end"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.e or 0 for r in got.collect()) == sorted([*[1000] * 1001, *range(1001, 2000), *[0] * 1000])


@pytest.mark.parametrize("size", [3, 25, 1000])
def test_scan_equals_windows_and_cuts_once(spark, size, monkeypatch):
    """Rolling and running columns of one cut; the running one sums what was rolled."""
    rows, cut = series(spark, size), []
    chunked = scans.chunked
    monkeypatch.setattr(scans, "chunked", lambda *a: cut.append(a) or chunked(*a))
    w = lambda by: Window.partitionBy(*by).orderBy("t", "i")
    rolled = lambda by: {"before": F.lag("i", 5).over(w(by)), "n": F.least(F.row_number().over(w(by)), F.lit(6))}
    whole = w("k").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns(rolled(("k",))).withColumns({"s": F.sum("before").over(whole), "z": F.last("v", True).over(whole)})
    got = scans.scan(rows, ["k"], ["t", "i"], 5, rolled, {"s": ("sum", "before"), "z": ("last", "v")}, size)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert len(cut) == 1


def test_rows_find_chunks_by_binary_search(spark):
    rng = random.Random(1)
    cuts = [sorted(rng.sample(range(3000), n)) for n in (0, 1, 7, 512, scans.GRAIN - 1)]
    asked = [(c, x) for c in [None, *cuts] for x in [None, -1, *range(0, 3001, 50), *(c or [])[:9], *(c or [])[-9:]]]
    got = spark.createDataFrame(asked, "c array<int>, x int").select("c", "x", scans._below("c", F.col("x")).alias("n")).collect()
    assert all(r.n == (0 if r.c is None or r.x is None else sum(c < r.x for c in r.c)) for r in got)
