"""The join against all pairs."""

import random
import re

import numpy as np
import pytest

from barquet.llm import jaccard
from barquet.llm.graph import components


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [shingles(t) if i is not None and t is not None else frozenset() for i, t in rows]
    n = len(rows)
    link = [[a != b and bool(sets[a]) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    group = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if link[a][b] and group[b] < group[a]:
                    group[a], changed = group[b], True
    equal = lambda a: min((rows[b][0] for b in range(n) if sets[a] and sets[a] == sets[b]), default=rows[a][0])
    return sorted(((rows[a][0], equal(a), group[a], sum(link[a]), len(shingles(rows[a][1]))) for a in range(n)), key=str)


def joined(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, key int")
    return sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 4, 5, 6, 30, 150]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rows = list(enumerate(texts(seed)))
    assert joined(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "two one"), (7, "a b c d e"), (8, "a b c d e"), (9, "x " * 50_000), (10, "x " * 50_000 + "y")]
    assert joined(spark, rows) == brute(rows)
    assert (None, None, None, 0, 1) in joined(spark, [(None, "a b c d e"), (1, "a b c d e")])
    assert joined(spark, []) == []
    assert joined(spark, [(1, "a b c d e"), (1, "a b c d e")]) == [(1, 1, 1, 1, 1)] * 2


def test_blocks_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "COLUMNS", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(100)] = f"n{rng.random()}"
        rows.append((i, " ".join(copy)))
    assert joined(spark, rows) == brute(rows)


def boilerplate(n):
    """Texts that are each made of ten of a hundred paragraphs."""
    rng = random.Random(8)
    paragraphs = [" ".join(f"p{p}w{k}" for k in range(40)) for p in range(100)]
    return [(i, "\n".join(rng.sample(paragraphs, 10))) for i in range(n)]


def test_shared_paragraphs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = boilerplate(120)
    rows += [(1000 + i, rows[i][1] + " one more word") for i in (3, 50)]
    assert joined(spark, rows) == brute(rows)


def test_sets_of_shared_paragraphs_stay_behind(spark, monkeypatch):
    """Sets go on only where a sketch has a likely partner; sketches are small beside them."""
    sizes = {}

    def kept(frame):
        out = written(frame)
        if set(out.columns) == {"i", "j", "key"}:
            sizes["paired"] = out.count()
        elif set(out.columns) == {"i", "j"}:
            sizes["pairs"] = out.count()
        return out

    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", kept)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = boilerplate(300)
    assert all(n == 0 for _, _, _, n, _ in joined(spark, rows))
    assert sizes["pairs"] > 100 and sizes["paired"] < 30


def test_sketches_keep_what_signatures_keep():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, 200, np.uint64)]
    for k in (2, 10, 20, 60, 200):
        sets.append(np.concatenate([sets[0][k:], rng.integers(0, 1 << 63, k, np.uint64)]))
    sizes = np.array([len(x) for x in sets])
    signed = jaccard.signatures(np.concatenate(sets), np.cumsum(sizes) - sizes, jaccard.SKETCH).astype("<u2")
    left, right = np.zeros(5, int), np.arange(1, 6)
    assert {0, 1, 2} <= {*jaccard.likely(signed, sizes, left, right, 0.8)} <= {0, 1, 2, 3}


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "other words that stand alone here"), (None, "a b c d e f"), (None, None), (7, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, "a b c d e f"), (9, rows[3][1]), (None, "a b c d e f"), (None, None), (7, "")], key=str)


def test_keep_one_of_ids_with_different_texts(spark):
    near = [" ".join(f"w{i}" for i in range(k, 60 + k)) for k in (0, 1)]
    rows = [
        (3, near[0], "a"), (5, near[1], "b"), (5, "text that stands for two other rows", "c"), (9, "text that stands for two other rows", "d"),
        (7, "first of two texts without a near one", "e"), (7, "second of two texts and no near one", "f"), (7, None, "g"), (7, "", "h"),
        (8, near[1] + " end", "i"), (8, "the last text of all is kept", "j"), (11, "the same id with near texts " + near[0].upper(), "k"), (11, "the same id with near texts " + near[0].upper() + " z", "l"),
    ]
    for part in (1, 5):
        kept = {r.tag for r in jaccard.keep_one(spark.createDataFrame(rows * 2, "doc_id long, text string, tag string").repartition(part)).collect()}
        assert kept - {"k", "l"} == set("acefghj") and len(kept & {"k", "l"}) == 1


def test_keep_one_moves_texts_only_packed(spark, monkeypatch, tmp_path):
    """Without broadcasts too, no join or sort carries the texts: they go through one exchange, as packed blocks."""
    rows = [(i, " ".join(f"w{i % 40}x{k}" for k in range(30)), f"s{i}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(jaccard.blocks, "BLOCK_BYTES", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, kept.collect())) == sorted(rows[:40])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if " Join " in line]
    assert joins and not any("text" in line for line in plan[plan.index(joins[0]) :].splitlines())


def test_pruning_bounds():
    assert jaccard.least_matches(16, 0.8, 1e-8) < 16 * 0.4
    assert jaccard.least_matches(128, 0.8, 1e-8) > 128 * 0.5
    # A pair of similarity 0.8 gets through: of a thousand with 128 fair draws each, none is dropped.
    draws = np.random.default_rng(0).random((1000, 128)) < 0.8
    for n in range(16, 129, 16):
        assert (draws[:, :n].sum(1) >= jaccard.least_matches(n, 0.8, 1e-8)).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (root(a) == root(b))
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
