"""The mix: targets against repeated resharing, copies against their bounds."""

import math
from collections import defaultdict

import pytest

from barquet.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """By the words of the contract: spread by weight, cut at the cap, spread the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= set(over)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    return mixing.mix(df, seed=1).collect()


def check(rows, got):
    words = lambda t: len((t or "").split(" ")) if t else 0
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += words(t)
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate - 1e-9) <= r.copies <= math.ceil(rate + 1e-9) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return want, taken, largest


def test_targets_and_copies(spark):
    rows = []
    for k, (source, n) in enumerate([("a", 400), ("b", 30), ("é", 60), (None, 50), ("ab", 5), ("", 90)]):
        rows += [(1000 * k + i, source, " ".join(["w"] * (i % 37)), "x") for i in range(n)]
    got = run(spark, rows)
    want, taken, largest = check(rows, got)
    for s in want:
        assert abs(taken[s] - want[s]) <= 40 * math.log2(largest[s] + 2), s
    again = {(r.doc_id, r.taken) for r in run(spark, rows[::-1])}
    assert again == {(r.doc_id, r.taken) for r in got}
    narrow = mixing.shares(spark.createDataFrame(rows, "doc_id long, source string, text string, size string"), seed=1).collect()
    assert {(r.doc_id, r.taken) for r in narrow} == again and len(narrow) == len(rows)


def test_many_cells(spark, monkeypatch):
    """Ranks of small cells add up to those of one: every prefix of a source is taken in its share."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rows = [(64 * (i % 50) if i % 3 else None, "a" if i % 4 else "b", " ".join([*["w"] * (i % 11), str(i % 17)]), "x") for i in range(400)]
    got = run(spark, rows)
    want, taken, largest = check(rows, got)
    for s, n in {"a": 300, "b": 100}.items():
        copies = sum(r.copies for r in got if r.source == s)
        rate = next(r.target / r.source_size for r in got if r.source == s)
        assert abs(copies - n * rate) <= 1


def test_copies_are_spread(spark, monkeypatch):
    """A text that most rows of a source repeat, with ids of their own, isn't ranked in one place."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 100)
    rows = [(i, "a", "same words" if i % 5 else f"other {i}", "x") for i in range(2000)]
    df = spark.createDataFrame([(i, s, 2, t) for i, s, t, _ in rows], "id long, source string, size long, __hash string")
    df = df.withColumn("__hash", mixing._hash(df["__hash"]))
    counts = [r["count"] for r in mixing._ordered(df).groupBy("__source", "__range").count().collect()]
    assert len(counts) == 20 and max(counts) <= 200 and sum(counts) == 2000
    check(rows, run(spark, rows))


def test_one_scan_of_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a", "w " * i) for i in range(20)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "d"))
    plan = mixing.shares(spark.read.parquet(str(tmp_path / "d")), seed=1)._jdf.queryExecution().toString()
    assert "text" not in plan  # what is ranked has been written without them


def test_defined_cases(spark):
    rows = [(None, None, None, None), (1, "a", "", None), (1, "a", "x y", "q"), (1, "a", "x y", "q"), (2, "b", "w " * 100_000 + "w", None)]
    check(rows, run(spark, rows))
    assert run(spark, []) == []
    assert [r.taken for r in run(spark, [(1, "a", None, None), (2, "b", " \n", None)])] == [0, 0]


def test_take(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * i) for i in range(50)], "doc_id long, source string, text string")
    mixed = mixing.mix(df, seed=2)
    want = {r.doc_id: r.copies for r in mixed.collect()}
    got = defaultdict(int)
    for r in mixing.take(mixed).collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_words(spark):
    text = "a\x0bb\x1cc d e\nf"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mixing.word_count(df.t)).first()[0] == 4
