"""Language identification: held-out accuracy, spans of mixed texts, and the labels against an exhaustive search."""

import itertools
import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from barquet.llm import language, queries

TRAIN = [
    ("the quick brown fox jumps over the lazy dog and then the cat sleeps on the warm windowsill", "en"),
    ("this is what they said about that thing which was there before we came with our friends", "en"),
    ("le renard brun saute par dessus le chien paresseux et puis le chat dort sur le rebord", "fr"),
    ("ceci est ce que nous avons dit de cette chose qui était là avant que nous ne venions", "fr"),
    ("быстрая коричневая лиса прыгает через ленивую собаку и кошка спит", "ru"),
]


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.createDataFrame(TRAIN, "text string, lang string"))


def test_mixed_text(spark, model):
    english, french = TRAIN[1][0], TRAIN[3][0]
    rows = [(1, f"{english}. {french}!"), (2, f"{TRAIN[4][0]} {english}")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert [s.lang for s in got[1].lang_spans] == ["en", "fr"] and [s.lang for s in got[2].lang_spans] == ["ru", "en"]
    s = got[1].lang_spans[0]
    assert (s.start, s.end) == (0, len(english)) and 0.4 < got[1].score < 0.6


def test_defined_cases(spark, model):
    rows = [(None, None, "x", 1), (1, "", "x", 2), (2, " 12 -- 5!", "x", 3), (3, "漢字", "x", 4), (4, "ſ́ ́", "x", 5), (5, "the " * 60_000, "x", 6)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, lang_pred string, score int")
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "in_script", "lang_spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 12
    for i in (None, 1, 2):
        assert (got[i].lang_pred, got[i].score, got[i].lang_spans) == ("und", 0.0, [])
    assert got[3].lang_pred in model.languages and got[5].lang_pred == "en" and got[5].score == 1.0 and (got[3].in_script, got[5].in_script, got[1].in_script) == (0, 1, 0) and len(got[5].lang_spans) == 1
    assert language.identify(df.limit(0), model).count() == 0
    nothing = language.fit(spark.createDataFrame([("a", None), (None, "en")], "text string, lang string"))
    assert {(r.lang_pred, r.score) for r in language.identify(df, nothing).collect()} == {("und", 0.0)}


def test_many_labels(spark):
    """Three hundred invented languages, each with letters' pairs of its own: all are learned, and told from text that isn't learned from."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = [["".join(letters[rng.integers(0, 26, rng.integers(4, 9))]) for _ in range(12)] for _ in range(300)]
    text = lambda k: " ".join(words[k][i] for i in rng.integers(0, 12, 30))
    model = language.fit(spark.createDataFrame([(text(k), f"l{k:03}") for k in range(300) for _ in range(2)], "text string, lang string"))
    assert len(model.languages) == 300 and model.shift > 0 and model.weights.size <= language.KINDS * language.SLOTS * language.FULL * 1.5
    got = language.identify(spark.createDataFrame([(k, text(k)) for k in range(300)], "k int, text string"), model).collect()
    assert sum(r.lang_pred == f"l{r.k:03}" for r in got) > 290


def test_scripts_narrow_candidates(model):
    words = language.read_words(pa.array(["лиса fox"]))
    scores = model.scores(words)
    ru = model.languages.index("ru")
    assert scores[0].argmax() == ru and (scores[0][[i for i in range(3) if i != ru]] == -1e4).all() and scores[1][ru] == -1e4


def test_viterbi_is_best():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 0, 5, 1, 6])
    scores, prior, penalty = rng.normal(size=(15, 3)).astype(np.float32), rng.normal(size=3), 0.7
    labels = language.viterbi(scores, sizes, prior, penalty)
    at = 0
    for n in sizes:
        part = scores[at : at + n].astype(float)
        value = lambda path: sum(part[i, k] for i, k in enumerate(path)) + (prior[path[0]] if path else 0) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert value(tuple(labels[at : at + n])) == pytest.approx(best)
        at += n


def test_held_out_accuracy(spark):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


FULL = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def combine(a, b):
    return mix((a * 0xD6E8FEB86659FD93 + b) & FULL)


def plain_words(text):
    """(start, end, letters, features, script) of each word, letter by letter."""
    kind = lambda c: unicodedata.category(c)[0]
    script = lambda c: next((name for name, a, b in language.SCRIPTS if a <= ord(c) <= b), "other")
    at = 0
    for inside, run in itertools.groupby(text or "", lambda c: kind(c) in "LM"):
        run = list(run)
        if inside and any(kind(c) == "L" for c in run):
            low = [ord(c.lower()) if kind(c) == "L" and len(c.lower()) == 1 else ord(c) for c in run]
            pair = [mix((c * 0x9E3779B97F4A7C15 + (low[i - 1] if i else 0)) & FULL) for i, c in enumerate(low)]
            triple = [combine(p, low[i - 2] if i > 1 else 0) for i, p in enumerate(pair)]
            whole = mix(sum(mix((t + 1) & FULL) for t in triple) & FULL)
            found = [*((0, p) for p in pair), *((1, t) for t in triple), (2, combine(pair[-1], 7)), (3, whole)]
            yield at, at + len(run), sum(kind(c) == "L" for c in run), [(k, h % language.SLOTS) for k, h in found], script(run[0])
        at += len(run)


def plain_identify(train, texts, penalty=6.0):
    counts, letters, rows = defaultdict(Counter), defaultdict(Counter), Counter(lang for _, lang in train)
    for text, lang in train:
        for _, _, n, found, script in plain_words(text):
            counts[lang].update(found)
            letters[lang][script] += n
    names = sorted(rows)
    total = {(lang, k): sum(n for (j, _), n in counts[lang].items() if j == k) + language.SLOTS / 2 for lang in names for k in range(4)}
    used = {lang: {s for s, n in letters[lang].items() if n >= 0.01 * sum(letters[lang].values())} for lang in names}
    out = []
    for text in texts:
        words = list(plain_words(text))
        best, back = [], []
        for i, (_, _, _, found, script) in enumerate(words):
            any_used = any(script in used[x] for x in names)
            score = [sum(math.log((counts[x][f] + 0.5) / total[x, f[0]]) / 4 for f in found) if script in used[x] else (-1e4 if any_used else 0.0) for x in names]
            score = score if any_used else [0.0] * len(names)
            if not i:
                best = [math.log(rows[x] / sum(rows.values())) + v for x, v in zip(names, score)]
                continue
            top = max(range(len(names)), key=lambda k: best[k])
            back.append([k if best[k] >= best[top] - penalty else top for k in range(len(names))])
            best = [max(best[k], best[top] - penalty) + v for k, v in enumerate(score)]
        labels = [max(range(len(names)), key=lambda k: best[k])] if words else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        labels.reverse()
        share = Counter()
        for (_, _, n, _, _), k in zip(words, labels):
            share[k] += n
        if not words:
            out.append(("und", 0.0, []))
            continue
        top = min(share, key=lambda k: (-share[k], k))
        runs = [list(g) for _, g in itertools.groupby(zip(words, labels), lambda x: x[1])]
        out.append((names[top], share[top] / sum(share.values()), [(r[0][0][0], r[-1][0][1], names[r[0][1]]) for r in runs]))
    return out


def test_against_plain_version(spark):
    """The whole query - folds, words, scores, Viterbi, shares - against letters counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    texts = [(r.text or "")[:1500] for r in docs] + [docs[0].text[:300] + " 漢字 " + docs[7].text[:300], "", "12 -", TRAIN[4][0] + " " + TRAIN[3][0]]
    train = [((r.text or "")[:1500], r.lang) for r in docs[::2] if r.lang] + TRAIN
    model = language.fit(spark.createDataFrame(train, "text string, lang string"))
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    for r, (lang, score, spans) in zip(got, plain_identify(train, texts), strict=True):
        assert (r.lang_pred, [tuple(s) for s in r.lang_spans]) == (lang, spans) and r.score == pytest.approx(score)
