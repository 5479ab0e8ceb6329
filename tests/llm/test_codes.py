"""Codes against plain rounds over all entries, the tree against a full search."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.llm import codes


def plain(rows, parts, entries, rounds):
    """``rows``: (id, list of whole numbers, label), ids not null."""
    step = len(rows[0][1]) // parts
    cut = lambda v, k: v[k * step : (k + 1) * step]
    books = [[cut(v, k) for _, v, _ in sorted(rows, key=lambda r: (r[0], r[1]))[:entries]] for k in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    find = lambda x, k: min((far(x, e), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        own = [[find(cut(v, k), k)[1] for _, v, _ in rows] for k in range(parts)]
        for k in range(parts):
            for i in range(len(books[k])):
                mine = [cut(v, k) for (_, v, _), e in zip(rows, own[k], strict=True) if e == i]
                if mine:
                    books[k][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[find(cut(v, k), k) for k in range(parts)] for _, v, _ in rows]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), e, sums[label], told) for (i, _, label), f, e in zip(rows, found, errors, strict=True)]


def found(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, label, 0) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, id int").repartition(3)
    return sorted((tuple(r) for r in codes.compress(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-6, 7) / 4096 if seed else rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += rows[:5]  # repeated rows
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], label) for i, v, label in rows]
    got = found(spark, rows, parts=4, entries=6, rounds=3)
    assert got == sorted(plain(whole, 4, 6, 3), key=str)


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "LABELS", 2)
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-6, 7) for _ in range(4)], rng.choice([None, 1, 2, 3])) for i in range(80)]
    whole = [(i, [4096 * x for x in v], label) for i, v, label in rows]
    assert found(spark, rows, parts=2, entries=5, rounds=2) == sorted(plain(whole, 2, 5, 2), key=str)


def test_large_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1, 3, 1e5, 2e6, -1e9]) * rng.randrange(1, 9) for _ in range(4)], 1) for i in range(60)]
    whole = [(i, [int(np.floor(x * 4096)) for x in v], 1) for i, v, _ in rows]
    got = found(spark, rows, "double", parts=2, entries=5, rounds=2)
    want = plain(whole, 2, 5, 2)
    limit = lambda x: x if x < 1 << 63 else None
    assert [(r[0], r[1], r[2], r[4]) for r in got] == sorted([(i, c, limit(e), t) for i, c, e, _, t in want], key=str)


def test_defined_cases(spark):
    assert found(spark, []) == []
    nan, inf = float("nan"), float("inf")
    assert found(spark, [(1, None, 1), (2, [1, None], 1), (3, [nan, 1], 1), (4, [1, inf], None)], parts=2) == []
    odd = found(spark, [(1, [1, 2, 3], 7), (2, [1, 2], 7)], parts=2)  # the length of the first doesn't divide
    assert [r[:4] for r in odd] == [(1, None, None, None), (2, None, None, None)]
    mixed = found(spark, [(1, [1, 2], 7), (2, [1, 2, 3, 4], 7), (None, [1, 3], None)], parts=2)
    assert {r[0]: r[1] for r in mixed} == {1: "0000", 2: None, None: "0000"}
    assert {r[0]: r[3] for r in mixed} == {1: 2048**2, 2: 2048**2, None: 2048**2}  # the one entry is their mean
    assert [r[1:4] for r in found(spark, [(1, [], 7), (2, [], None)], parts=2)] == [("0000", 0, 0), ("0000", 0, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_full_search(seed):
    rng = np.random.default_rng(seed)
    spread = [2, 3, 1000, 1 << 20, 1 << 26, 5][seed]
    entries = rng.integers(-spread, spread, (int(rng.integers(1, 40)), 3))
    rows = rng.integers(-spread, spread, (500, 3))
    kind = object if seed == 5 else np.int64
    own, d = codes.nearest(rows.astype(kind), entries.astype(kind))
    far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert own.tolist() == far.argmin(axis=1).tolist() and d.tolist() == far.min(axis=1).tolist()


def test_tree_leaves_entries_out(monkeypatch):
    """Far from all but one cluster, most entries aren't compared."""
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(0, 50, (8, 2)) + c for c in (0, 10_000, 500_000, 9_000_000)])
    rows = entries[rng.integers(0, len(entries), 400)] + rng.integers(-2, 3, (400, 2))
    seen = []
    squared = codes._squared
    monkeypatch.setattr(codes, "_squared", lambda r, e: seen.append(len(r)) or squared(r, e))
    root = codes.tree(entries)
    seen.clear()
    codes.nearest(rows, entries, root)
    assert sum(seen) < 0.6 * len(rows) * len(entries)


def test_seeds_of_equal_ids(spark):
    rows = [(1, [2, 2], 1), (1, [1, 1], 1), (2, [9, 9], 1)]
    whole = [(i, [4096 * x for x in v], label) for i, v, label in rows]
    assert found(spark, rows, parts=2, entries=2, rounds=1) == sorted(plain(whole, 2, 2, 1), key=str)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("code", "error", "vector", "id")})
    assert codes.compress(df, parts=2).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
