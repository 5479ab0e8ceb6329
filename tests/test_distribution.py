"""Histograms, normal plots and quantiles against numpy and the standard library; local times on days when clocks change."""

import datetime as dt
import math
import random
from statistics import NormalDist
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.operators import clock, distribution


def test_inverse_normal(spark):
    rng = random.Random(1)
    p = [1e-300, 1e-30, 1e-9, 0.0749, 0.075, 0.0751, 0.5, 0.925, 1 - 1e-9, 1 - 2**-53, *(rng.random() for _ in range(2000)), *(10 ** -rng.uniform(1, 300) for _ in range(300))]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", distribution.inverse_normal(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) <= 1e-12 * max(1, abs(r.z)) for r in got)
    odd = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,), (float("nan"),)], "p double").select(distribution.inverse_normal(F.col("p")).alias("z"))
    assert [r.z for r in odd.collect()] == [None] * 5


def test_histogram(spark):
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [3.0] * 4, "c": [None, float("nan")], None: [1.0, 2.0, float("inf")]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double").repartition(5)
    got = {}
    for r in distribution.histogram(df, ["k"], "x", 20).collect():
        got.setdefault(r.k, {})[r.bin] = r
    assert set(got) == {"a", "b", None} and all(len(v) == 20 for v in got.values())
    n, edges = np.histogram(groups["a"], 20)
    assert [got["a"][i].n for i in range(20)] == n.tolist() and np.allclose([got["a"][i].low for i in range(20)], edges[:-1])
    assert got["b"][0].n == 4 and sum(r.n for r in got["b"].values()) == 4 and got[None][19].n == 1 and got[None][0].n == 1
    whole = distribution.histogram(df.where("k = 'a'"), [], "x", 5)
    assert [r.n for r in whole.orderBy("bin").collect()] == np.histogram(groups["a"], 5)[0].tolist()


@pytest.mark.parametrize("size", [20, 1000])
def test_normal_plot(spark, size):
    rng = random.Random(3)
    groups = {"a": [round(rng.gauss(2, 3), 1) for _ in range(90)], "b": [1.0], "c": [5.0, 4.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in [*v, None]], "k string, x double").repartition(5)
    points = distribution.normal_plot(df, ["k"], "x", size).collect()
    for k, v in groups.items():
        mine = sorted((r.nth, r.theoretical, r.observed) for r in points if r.k == k)
        n = len(v)
        medians = [1 - 0.5 ** (1 / n), *((i - 0.3175) / (n + 0.365) for i in range(2, n)), 0.5 ** (1 / n)][:n] if n > 1 else [0.5]
        assert [x for _, _, x in mine] == sorted(v) and [i for i, _, _ in mine] == list(range(1, n + 1))
        assert np.allclose([z for _, z, _ in mine], [NormalDist().inv_cdf(m) for m in medians], atol=1e-9)
    line = {r.k: r for r in distribution.normal_line(spark.createDataFrame(points), ["k"]).collect()}
    x, y = zip(*((r.theoretical, r.observed) for r in points if r.k == "a"), strict=True)
    slope, intercept = np.polyfit(x, y, 1)
    assert line["a"].slope == pytest.approx(slope) and line["a"].intercept == pytest.approx(intercept) and line["a"].r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert line["b"].slope is None and line["c"].slope < 10


@pytest.mark.parametrize("limit", [50, 10_000])
def test_quantiles(spark, limit):
    rng = random.Random(limit)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [float(rng.randrange(4)) for _ in range(2000)], "c": [7.0] * 300, "d": [None], None: [10.0**k for k in range(-150, 150)], "e": [1.0, 2.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double").repartition(6)
    shares = {"low": ("nearest", 0.0), "near": ("nearest", 0.95), "mid": ("linear", 0.5), "top": ("linear", 1.0), "odd": ("linear", 0.137)}
    got = {r.k: r for r in distribution.quantiles(df, ["k"], "x", shares, limit).collect()}
    assert set(got) == set(groups) - {"d"}
    for k, r in got.items():
        v = sorted(groups[k])
        for name, (kind, share) in shares.items():
            want = v[max(0, math.ceil(share * len(v)) - 1)] if kind == "nearest" else float(np.quantile(v, share))
            assert r[name] == pytest.approx(want, rel=1e-9, abs=1e-12), (k, name)


def test_quantiles_of_one_large_group(spark):
    """Five million values of no group, narrowed to a few thousand before any are sorted."""
    df = spark.range(5_000_000).select((F.pmod(F.xxhash64("id"), F.lit(10**12)) / 1e6).alias("x"))
    got = distribution.quantiles(df, [], "x", {"m": ("nearest", 0.5), "p": ("nearest", 0.999)}, 100_000).first()
    want = df.agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("m"), F.expr("percentile_disc(0.999) within group (order by x)").alias("p")).first()
    assert (got.n, got.m, got.p) == (5_000_000, want.m, want.p)


def plain_day(text, zone):
    local = dt.datetime.fromisoformat(text)
    if local.tzinfo is not None:
        return local.date(), None
    tz = ZoneInfo(zone)
    real = [x for f in (0, 1) if (x := local.replace(tzinfo=tz, fold=f)).astimezone(dt.timezone.utc).astimezone(tz).replace(tzinfo=None) == local]
    if not real:
        return None, "nonexistent"
    return (None, "ambiguous") if len({x.utcoffset() for x in real}) > 1 else (local.date(), None)


@pytest.mark.parametrize("zone, days", [("America/New_York", ["2024-03-10", "2024-11-03"]), ("Europe/Berlin", ["2024-03-31", "2024-10-27"]), ("Australia/Lord_Howe", ["2024-10-06", "2024-04-07"]), ("UTC", ["2024-03-10"])])
def test_local_days(spark, zone, days):
    texts = [f"{d} {h:02}:{m:02}:00{z}" for d in days for h in range(24) for m in (0, 15, 30, 59) for z in ("", "Z", "+02:00")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.day, r.reason) for r in clock.local_day(df, "t", zone).collect()}
    assert got == {t: plain_day(t, zone) for t in texts}
    free = {r.reason for r in clock.local_day(df, "t").collect()}
    assert free == {None}


def test_local_days_of_other_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("then",), ("17.5",), ("1e9",), ("2024-02-30",), ("2024-02-29",), (" 2024-01-02T03:04:05 ",), ("2024",)], "t string")
    got = [(str(r.day), r.reason) for r in clock.local_day(df, "t", "America/New_York").collect()]
    assert got == [("None", "missing"), ("None", "unreadable"), ("None", "unreadable"), ("None", "not_a_time"), ("None", "not_a_time"), ("None", "unreadable"), ("2024-02-29", None), ("2024-01-02", None), ("2024-01-01", None)]
    for kind, value in (("boolean", True), ("int", 20240102), ("double", 1.5), ("decimal(9,0)", 3)):
        made = spark.createDataFrame([(1,), (None,)], "i int").select(F.when(F.col("i") == 1, F.lit(value).cast(kind)).cast(kind).alias("t"))
        assert [r.reason for r in clock.local_day(made, "t", "UTC").collect()] == ["not_a_time", "missing"]
    real = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30),), (dt.datetime(2024, 3, 10, 3, 30),)], "t timestamp_ntz")
    assert [(r.day, r.reason) for r in clock.local_day(real, "t", "America/New_York").collect()] == [(None, "nonexistent"), (dt.date(2024, 3, 10), None)]
