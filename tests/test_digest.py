"""Digests against hashlib, whatever the partitioning."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from barquet.operators import digest


def canonical(row):
    def text(v):
        if not isinstance(v, float):
            return str(v)
        mantissa, power = v.hex().split("p")
        whole, part = mantissa.split(".") if "." in mantissa else (mantissa, "0")
        return f"{whole}.{part.rstrip('0') or '0'}p{int(power)}"

    return ",".join("-" if v is None else f"{len(text(v))}:{text(v)}" for v in row)


def plain(rows, fan):
    lines = [canonical(r) for r in sorted(rows, key=lambda r: (r[0], canonical(r)))]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha("\n".join(lines[a : a + fan])) for a in range(0, len(lines), fan)]
    leaves = level
    while True:
        level = [sha("".join(level[a : a + fan])) for a in range(0, len(level), fan)]
        if len(level) <= 1:
            return leaves, level[0]


def some(seed, n=150):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30), 0.0, 1e16, 1e-4, 12345678.0])
    rows = [(rng.randrange(60), value(), rng.choice([None, "", "a,b", "7:x"])) for _ in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("fan, size", [(4, 20), (4, 1000), (1024, 1000)])
def test_equals_plain(spark, fan, size):
    rows = some(fan)
    made = spark.createDataFrame([("g", *r) for r in rows], "k string, t int, x double, s string")
    leaves, whole = plain(rows, fan)
    for parts in (1, 7):
        frame = made.repartition(parts)
        got = digest.digests(frame, ["k"], ["t"], fan=fan, size=size).collect()
        assert [(r.k, r.rows, r.digest) for r in got] == [("g", len(rows), whole)]
        by_range = {r.range: r.digest for r in digest.ranges(frame, ["k"], ["t"], fan=fan, size=size).collect()}
        assert [by_range[i] for i in range(len(leaves))] == leaves


def test_groups_of_other_sizes(spark):
    rows = some(3, 40)
    made = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in rows[:3]], "k string, t int, x double, s string")
    got = {r.k: r.digest for r in digest.digests(made, ["k"], ["t"], fan=3).collect()}
    assert set(got) == {"a", "b"} and got["a"] != got["b"]
    assert digest.digests(made.limit(0), ["k"], ["t"]).count() == 0


def test_a_changed_value_names_its_range(spark):
    rows = [(i, float(i), "x") for i in range(50)]
    frame = lambda r: spark.createDataFrame([("g", *x) for x in r], "k string, t int, x double, s string")
    old = digest.ranges(frame(rows), ["k"], ["t"], fan=10)
    new = digest.ranges(frame([(t, x + (1e-12 if t == 27 else 0), s) for t, x, s in rows] + [(50, 1.0, None)]), ["k"], ["t"], fan=10)
    assert sorted((r.range, r.left is None) for r in digest.changed_ranges(old, new, ["k"]).collect()) == [(2, False), (5, True)]


def test_numbers_are_written_as_json_does(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 0.001, 0.0001, 0.00012, 1e-5, 123456789.0, 1e15, 1e16, 1.5e16, 1.25e22, -4.475505089910138e16, 1.7976931348623157e308, 0.1 + 0.2]
    values += [rng.gauss(0, 1) * 10.0 ** rng.randrange(-20, 20) for _ in range(2000)]
    values += [float(f"{rng.choice([1, -1]) * rng.randrange(1, 10**6)}e{rng.randrange(-40, 40)}") for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", digest.number_text("v").alias("t")).collect()
    texts = {r.i: r.t for r in got}
    assert all(float(texts[i]) == v for i, v in enumerate(values))
    assert sum(texts[i] != json.dumps(v) for i, v in enumerate(values)) < 0.01 * len(values)
    least = spark.createDataFrame([(5e-324,)], "v double").select(digest.number_text("v").alias("t")).first().t
    assert float(least) == 5e-324  # numbers below the normal range may have another digit
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r.t for r in odd.select(digest.number_text("v").alias("t")).collect()] == ["NaN", "Infinity", "-Infinity", None]


def test_files(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r.path.split("/")[-1]: r.digest for r in digest.file_digests(spark, str(tmp_path)).collect()}
    assert got == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / "t").glob("*.parquet")} and len(got) == 3
    assert spark.range(1).select(F.sha2(F.lit(b"x"), 256)).first()[0] == hashlib.sha256(b"x").hexdigest()
