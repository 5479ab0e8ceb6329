"""The audit against a plain version, and what sorted streams must not depend on."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barquet.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, most):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    order = lambda item: (-item[1], item[0].encode())
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        for s in sources:
            far = {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in sources if o != s}
            over = {t: p[s][t] - q[t] for t in kept if counts[lang, s][t] and p[s][t] > q[t]}
            for part, items, limit in (("pair", far, None), ("term", over, most)):
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(sorted(items.items(), key=order)[:limit])}
    return out


def found(spark, rows, least=3, most=4):
    df = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id int, text string, lang string, source string").repartition(5)
    got = [tuple(r) for r in divergence.audit(df, least=least, most_terms=most).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some(seed, n=120, sources=6):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "of", "été", "Été", "naïve", "日本", "a", "b", "x1y", "don't", "w" * 30, *(f"t{chr(97 + k)}" for k in range(20))]
    text = lambda: rng.choice([None, "", "1 2", *[" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(8)]])
    return [(rng.choice(["en", "en", "fr", None, ""]), rng.choice([None, *(f"s{k}" for k in range(sources))]), text()) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain(spark, seed):
    rows = some(seed)
    assert found(spark, rows) == plain(rows, 3, 4)


def test_small_blocks_pieces_and_tiles(spark, monkeypatch):
    """The same with blocks of a few documents, texts in pieces, two sources a tile, few terms at a time and many salts."""
    for name, value in {"BLOCK_BYTES": 300, "PIECE_BYTES": 16, "TILE": 2, "TERMS": 3, "RUNS": 20, "SMALL": 2}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = some(7, 150, 7)
    assert found(spark, rows) == plain(rows, 3, 4)


def test_pieces_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 8)
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        texts = ["".join(rng.choices("ab é1 ", k=rng.randrange(60))).encode() for _ in range(3)]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        got = defaultdict(list)
        for row, piece in divergence._pieces(data, at):
            got[row].append(piece.tobytes())
        assert [b"".join(got[k]) for k in range(3)] == texts
        split = lambda x: TERM.findall(x.decode())
        assert [[t for x in got[k] for t in split(x)] for k in range(3)] == [split(x) for x in texts]


def test_defined_cases(spark):
    assert found(spark, []) == set()
    assert found(spark, [("en", "a", None)]) == set()
    rows = [("en", "a", None), ("en", "b", ""), ("en", "B", "word")]  # no kept term
    assert found(spark, rows) == plain(rows, 3, 4) == {("en", *x) for x in [("a", "pair", "B", 0, 1), ("a", "pair", "b", 0, 2), ("b", "pair", "B", 0, 1), ("b", "pair", "a", 0, 2), ("B", "pair", "a", 0, 1), ("B", "pair", "b", 0, 2)]}
    rows = [("en", "a", "x y")] * 3 + [("en", None, "x")] * 2 + [(None, "a", "z " * 50_000)]  # repeated rows, ties
    assert found(spark, rows) == plain(rows, 3, 4)


def test_extra_columns(spark):
    rows = some(4, 40)
    df = spark.createDataFrame([(t, lang, s) for lang, s, t in rows], "text string, lang string, source string")
    df = df.withColumns({c: F.lit(1) for c in ("n", "term", "block", "tile", "p")})
    assert {tuple(r) for r in divergence.audit(df, least=3, most_terms=4).collect()} == plain(rows, 3, 4)
