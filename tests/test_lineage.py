"""Lineage after fetches and changes of base against plain loops; stored lineage that has to be rejected."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from barquet.operators import lineage
from barquet.schemas import BARS

DAY = dt.date(2024, 3, 1)
LINE = "symbol string, source string, start date, end date, acquired_at timestamp_ntz, action_coverage string, content_hash string"


def day(k):
    return DAY + dt.timedelta(k)


def at(k):
    return dt.datetime(2024, 3, 1) + dt.timedelta(k)


def some_bars(spark, rng, n=40):
    rows = [(at(k), s, 5.0, 6.0, 4.0, 5.5, 10.0, 5.5, 0.0, 1.0, rng.choice(["x", "x", "y"])) for s in ("A", "B") for k in range(n) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, BARS).repartition(4)


def some_lines(rng, n=14, sources=("x", "y")):
    made = [(rng.choice("AB"), rng.choice(sources), a := rng.randrange(40), a + rng.randrange(9), rng.randrange(50)) for _ in range(n)]
    return [(s, src, day(a), day(b), at(100 + k), "full", f"h{k}") for s, src, a, b, k in made]


def origin_runs(rows, origin):
    """(symbol, start, end, source, acquired_at, coverage, bars) of runs of one origin."""
    out, last = [], None
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        o = (r[1], origin(r))
        if o != last:
            out.append([r[1], r[0].date(), None, o[1][0], o[1][1], o[1][2], 0])
            last = o
        out[-1][2], out[-1][6] = r[0].date(), out[-1][6] + 1
    return sorted(map(tuple, out), key=str)


def first(lines, symbol, on, source=None):
    fit = [x for x in lines if x[0] == symbol and x[2] <= on <= x[3] and source in (None, x[1])]
    return min(fit, key=lambda x: (x[2], x[3], x[4])) if fit else None


def told(frame):
    return sorted(((r.symbol, r.start, r.end, r.source, r.acquired_at, r.action_coverage, r.bars) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed, size", [(0, 9), (1, 1000), (2, 15)])
def test_rebuild_equals_a_loop(spark, seed, size):
    rng = random.Random(seed)
    rows, bars = some_bars(spark, rng)
    lines = some_lines(rng)
    fetched = {(r[1], r[0]): (("z", at(200 + k), "full", day(30), day(34), f"n{k}"), k) for k in range(2) for r in rows if 12 + 5 * k <= (r[0] - at(0)).days <= 18 + 5 * k}
    news = [(s, t, *o, k) for (s, t), (o, k) in fetched.items()] + [(s, t, "w", at(1), "full", day(0), day(1), "older", -1) for s, t in list(fetched)[:5]]
    new = spark.createDataFrame(news, "symbol string, timestamp timestamp_ntz, source string, acquired_at timestamp_ntz, action_coverage string, start date, end date, content_hash string, position int")

    def origin(r):
        if (r[1], r[0]) in fetched:
            return fetched[r[1], r[0]][0]
        x = first(lines, r[1], r[0].date(), r[10])
        return (x[1], x[4], x[5], x[2], x[3], x[6]) if x else (r[10], at(-9), "unknown", r[0].date(), r[0].date(), "unsegmented")

    got = lineage.rebuild(bars, spark.createDataFrame(lines, LINE), new, at(-9), size)
    assert got.columns == list(lineage.SEGMENT)
    assert told(got) == origin_runs(rows, origin)
    assert got.agg(F.sum("bars")).first()[0] == len(rows)  # each bar is in one segment


@pytest.mark.parametrize("seed", range(2))
def test_rebase_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, bars = some_bars(spark, rng)
    whole = [(s, "x", day(0), day(25), at(3), "full", "a") for s in "AB"] + [(s, "y", day(20), day(60), at(4), "full", "b") for s in "AB"]
    newer = [(s, "z", day(8), day(30), at(9), "full", "c") for s in "AB"]
    replaced = [("A", day(9), day(12)), ("A", day(11), day(15)), ("B", day(28), day(29))]
    frames = [spark.createDataFrame(x, LINE) for x in (whole, newer)]
    ranges = spark.createDataFrame(replaced, "symbol string, start date, end date")

    def origin(r):
        inside = any(s == r[1] and a <= r[0].date() <= b for s, a, b in replaced)
        x = first(newer if inside else whole, r[1], r[0].date())
        return x[1], x[4], x[5], x[2], x[3], x[6]

    assert told(lineage.rebase(bars, *frames, ranges)) == origin_runs(rows, origin)
    short = frames[0].where("source = 'x'")
    bare = {(r.symbol, r.timestamp) for r in lineage.uncovered(bars, short, frames[1], ranges).collect()}
    assert bare == {(r[1], r[0]) for r in rows if r[0].date() > day(25) and not (r[1] == "B" and day(28) <= r[0].date() <= day(29))}
    with pytest.raises(ValueError, match="cover"):
        lineage.rebase(bars, short, frames[1], ranges)


def test_a_changed_bar_changes_its_segment(spark):
    rows, bars = some_bars(spark, random.Random(5))
    lines = spark.createDataFrame([(s, src, day(10 * k), day(10 * k + 9), at(k), "full", f"{s}{k}") for s in "AB" for src in "xy" for k in range(4)], LINE)
    none = spark.createDataFrame([], "symbol string, timestamp timestamp_ntz, source string, acquired_at timestamp_ntz, action_coverage string, start date, end date, content_hash string, position int")
    changed = bars.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("timestamp") == F.lit(rows[3][0])), 5.51).otherwise(F.col("close")))
    key = lambda frame: {(r.symbol, r.start): r.content_hash for r in lineage.rebuild(frame, lines, none, at(0)).collect()}
    old, new = key(bars), key(changed)
    assert old.keys() == new.keys() and sum(old[k] != new[k] for k in old) == 1


GOOD = {"start": "2024-01-02", "end": "2024-01-05", "provider": "yfinance", "acquired_at": "2024-02-01T10:00:00+00:00", "action_coverage": "full", "content_hash": "0" * 64, "action_signature": "s"}
LATER = {**GOOD, "start": "2024-01-06", "end": "2024-01-06", "provider": "alpha_vantage", "acquired_at": "2024-02-01T10:00:00.5Z"}
WRONG = [
    (None, None, "no document"), ("{", None, "not JSON"), ('{"a": 1}', None, "not a list"), ('"x"', None, "not a list"),
    ([GOOD, 3], 1, "not an object"), ([GOOD, None], 1, "not an object"), ([{k: v for k, v in GOOD.items() if k != "provider"}], 0, "lacks provider"),
    ([{**GOOD, "more": "x"}], 0, "has other fields, or fields that aren't text"), ([{**GOOD, "action_signature": 3}], 0, "has other fields, or fields that aren't text"),
    ([{**GOOD, "start": "2024-02-30"}], 0, "start is no date"), ([{**GOOD, "end": "5 May"}], 0, "end is no date"), ([{**GOOD, "start": "2024-01-07"}], 0, "ends before it starts"),
    ([LATER, {**GOOD, "provider": "other"}], 1, "unknown provider"), ([{**GOOD, "acquired_at": "2024-02-01T10:00:00"}], 0, "acquired_at is no UTC time"),
    ([{**GOOD, "acquired_at": "2024-02-01T10:00:00+01:00"}], 0, "acquired_at is no UTC time"), ([{**GOOD, "action_coverage": "some"}], 0, "unknown action_coverage"),
    ([{**GOOD, "content_hash": "0" * 63 + "G"}], 0, "content_hash is no SHA-256"), ([{**GOOD, "action_signature": ""}], 0, "action_signature is empty"),
    ([LATER, GOOD, {**GOOD, "start": "2024-01-05", "end": "2024-01-05"}], 2, "shares days with another segment"), ([GOOD, LATER, {**LATER, "start": 1}], 2, "has other fields, or fields that aren't text"),
]


def test_documents(spark):
    docs = [(d if d is None or isinstance(d, str) else json.dumps(d)) for d, _, _ in WRONG]
    rows = [(i, d) for i, d in enumerate(docs)] + [(100, json.dumps([GOOD, LATER])), (101, "[]")]
    good, bad = lineage.read_documents(spark.createDataFrame(rows, "id int, document string"))
    assert {r.id: (r.position, r.reason) for r in bad.collect()} == {i: (p, why) for i, (_, p, why) in enumerate(WRONG)}
    kept = sorted((r.id, r.position, str(r.start), r.provider, r.acquired_at) for r in good.collect())
    assert kept == [(100, 0, "2024-01-02", "yfinance", dt.datetime(2024, 2, 1, 10)), (100, 1, "2024-01-06", "alpha_vantage", dt.datetime(2024, 2, 1, 10, 0, 0, 500_000))]
