"""Preference pairs against a plain version."""

import random

import pytest

from barquet.llm import preference as P

TURN = "struct<turn:long,role:string,text:string>"


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for _, r, t in turns)


def mask(turns):
    return [x for _, r, t in turns for x in ((len(f"<|{r or ''}|>\n"), False), (len(f"{t or ''}<|end|>\n"), r == "assistant"))]


def plain(a, b):
    a, b = a or [], b or []
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    return n, render(a[:n]), render(a[n:]), render(b[n:]), mask(a[n:]), mask(b[n:])


def test_format_pairs(spark):
    rng = random.Random(1)
    make = lambda: [(i, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "", None])) for i in range(rng.randrange(4))]
    pairs = [(make(), make()) for _ in range(150)] + [(None, make()), (make(), None), (None, None), ([(0, "user", "é" * 100_000)], [(0, "user", "é" * 100_000)])]
    df = spark.createDataFrame([(i, a, b, "old") for i, (a, b) in enumerate(pairs)], f"id int, chosen array<{TURN}>, rejected array<{TURN}>, prompt string")
    got = {r.id: r for r in P.format_pairs(df).collect()}
    for i, (a, b) in enumerate(pairs):
        r = got[i]
        have = (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask])
        assert have == plain(a, b)
        assert sum(n for n, _ in r.chosen_mask) == len(r.chosen)


def test_swap_last_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "x"), (0, 2, "user", "r"), (1, 0, "user", "s"), (1, 1, "assistant", "y"), (1, 3, "assistant", "z"), (4, 0, "user", "u"), (4, 1, "assistant", "v"), (None, 0, "user", "lost"), (6, 0, None, None)]
    rows += [rows[0]]  # a repeated turn stays
    whole = P.gather(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    got = {r.conv_id: r for r in P.swap_last_answers(whole, "conv_id").collect()}
    texts = lambda turns: [t.text for t in turns]
    assert texts(got[0].rejected) == ["q", "q", "z"] and texts(got[1].rejected) == ["s", "y", "x"]
    assert texts(got[4].rejected) == ["u"] and texts(got[6].rejected) == [None] and set(got) == {0, 1, 4, 6}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.format_pairs(P.swap_last_answers(P.gather(none, "conv_id"), "conv_id")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_every_pair_of_a_table(spark, sf):
    whole = P.gather(spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet"), "conv_id")
    pairs = P.swap_last_answers(whole, "conv_id")
    want = {r.conv_id: plain([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in pairs.collect()}
    for r in P.format_pairs(pairs).collect():
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == want[r.conv_id][:4]
