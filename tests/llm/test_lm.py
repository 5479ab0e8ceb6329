"""Scores against a plain automaton of dictionaries."""

import math
import random
import re
from collections import Counter

import pytest

from barquet.llm import blocks, lm

END = ("end",)


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def model(texts):
    """Counts of all grams, N, V and p(w | h) by its definition."""
    grams = Counter(tuple(t[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(w, h):
        if not h:
            return (grams[w,] + 1) / (n + v + 1)
        k = lm.DIRICHLET[len(h) - 1]
        return (grams[*h, w] + k * p(w, h[1:])) / (grams[h] + k)

    return grams, n, v, p


def plain(rows):
    grams, n, v, p = model([toks(text) for _, text, train in rows if train])
    out = {}
    for i, text, _ in rows:
        t = toks(text)
        total = sum(math.log10(p(w, tuple(t[max(0, j - 2) : j]))) for j, w in enumerate(t))
        out[i] = (len(t), sum(grams[w,] > 0 for w in t), n, sum(math.log10(p(w, ())) for w in t), total)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id int, text string, train boolean, score int").repartition(3).checkpoint()
    got = lm.score(df).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("c")))


def test_plain_version(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    check(spark, [(1, "a b c d " * 300 + "a c b", True), (2, "a b c d " * 200 + "x y", False), (3, "b c", True)])
    rng = random.Random(1)
    words = ["Abc", "abc", "x", "É", "é", "the", "of", " ", "<s>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.random() < 0.7) for i in range(80)]
    check(spark, rows)


def test_defined_cases(spark):
    check(spark, [(1, None, True), (2, "", False), (3, "a a  a", None), (4, "b " * 50_000, True), (5, "a\x0bb", True), (5, "a\x0bb", True)])
    check(spark, [(1, "a b", False), (2, None, None)])
    none = spark.createDataFrame([], "doc_id int, text string, train boolean")
    assert lm.score(none).count() == 0


def test_sums_to_one():
    """Over the known words and one unknown, p(w | h) is a distribution, in every state."""
    grams, _, _, p = model([[*"abacbaab", END]])
    known = [g[0] for g in grams if len(g) == 1]
    for h in [(), ("a",), ("b",), ("a", "b"), ("b", "a"), ("?",), ("c", "c"), ("?", "a")]:
        assert sum(p(w, h) for w in [*known, "?"]) == pytest.approx(1)
