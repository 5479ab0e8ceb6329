"""Top-k search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.llm import topk

SCHEMA = "id long, vector array<long>"


def brute(queries, rows, k):
    out = []
    for q, v in {(i, tuple(v)) for i, v in queries if i is not None and v}:
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in rows if i is not None and w and len(w) == len(v) and i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, queries, rows, k):
    got = topk.top_k(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("size", [1, 100, 40_000, 3_000_000_000, 10**18])
def test_brute_force(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.randint(-size, size) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    queries = rows[::7]
    assert found(spark, queries, rows, 5) == brute(queries, rows, 5)


def test_defined_cases(spark):
    rows = [(None, [1, 2]), (1, None), (2, []), (3, [1, 2]), (4, [5, 5]), (5, [1, 2, 3]), (6, [0, 0])]
    queries = [(3, [1, 2]), (3, [1, 2]), (3, [-1, 2]), (None, [1, 1]), (5, [1, 2, 3]), (6, [0, 0])]
    assert found(spark, queries, rows, 20) == brute(queries, rows, 20)
    assert found(spark, [], rows, 3) == [] and found(spark, queries, [], 3) == []


def test_stops_before_the_ends_of_the_lists():
    """Given the bar of blocks before, outsiders fall out while most of each list is unread, and nothing is lost."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-30, 31, (3000, 16))
    lists = topk.Lists(np.arange(3000), vectors)
    q = vectors[:20]
    scores = q @ vectors.T
    scores[np.arange(20), np.arange(20)] = -(10**9)
    bars = np.sort(scores, axis=1)[:, -10]
    a, b, s = topk.search(lists, q, np.arange(20), bars, 10)
    assert lists.entries < 0.8 * lists.asked and len(a) < 20 * 3000 / 4
    for i in range(20):
        assert set(np.flatnonzero(scores[i] >= bars[i])) <= set(b[a == i])
    assert (s == (q[a] * vectors[b]).sum(1)).all()


def test_quantized(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.01],), (None,), ([1.0, None],), ([nan],), ([inf],), ([-1e300, 1e300],), ([],)]
    got = spark.createDataFrame(rows, "v array<double>").select(topk.quantized(F.col("v")).alias("q")).collect()
    assert [r.q for r in got] == [[32, -1], None, None, None, None, [-(2**63), 2**63 - 1], []]


def test_share_of_entries_read(spark):
    """Of the lists of the given table, whose two blocks a task reads one after the other, nearly all is read; bounds that exclude more need more blocks."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", topk.quantized(F.col("embedding")).alias("v")).where("v is not null").toArrow()
    ids, vectors = rows["vec_id"].to_numpy(), np.array(rows["v"].to_pylist())
    many = np.concatenate([vectors + np.random.default_rng(k).integers(-2, 3, vectors.shape) for k in range(6)])
    of = np.flatnonzero(ids % 20 == 0)
    shares = []
    best = topk.Best(ids[of], np.zeros(len(of), int), vectors[of], 20)
    for a in range(0, len(many), topk.LISTED):
        lists = topk.Lists(np.arange(a, min(a + topk.LISTED, len(many))) + 10**6, many[a : a + topk.LISTED])
        best.add(lists)
        shares.append(lists.entries / lists.asked)
    assert shares[0] == 1 and 0.85 < shares[1] < 1 and max(shares[8:]) < 0.85
    want = np.sort(vectors[of] @ many.T, axis=1)[:, ::-1][:, :20]
    assert (best.found[2].reshape(-1, 20) == want).all()


def test_vectors_without_components(spark):
    rows = [(20, []), (40, []), (40, []), (41, []), (60, [1]), (61, [2]), (80, None)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    got = [tuple(r) for r in topk.top_k(df.where("id % 20 = 0"), df, 2).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 0), (20, 2, 40, 0), (40, 1, 20, 0), (40, 2, 41, 0), (60, 1, 61, 2)]

