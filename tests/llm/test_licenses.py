"""License scans on planted notices, and against a comparison of every template at every place."""

import random
import re
import textwrap
import time
from collections import Counter

from barquet.llm import licenses as L


def test_templates_are_found_in_text(spark):
    rows = [(i, f"Some words before.\n// {text}\nand words after") for i, (_, text) in enumerate(L.TEMPLATES)]
    got = L.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    best = {(r.doc_id, r.license) for r in got if r.confirmed}
    assert {(i, name) for i, (name, _) in enumerate(L.TEMPLATES)} <= best
    for r in got:
        assert 0 <= r.start < r.end <= len(r.text)


def test_wording_differences():
    text = dict(L.TEMPLATES[3:4])["Apache-2.0"]
    (name, sure, _, missing, extra) = L.judge(text.replace("2.0", "1.1"))[0]
    assert name == "Apache-2.0" and not sure and missing == "2.0" and extra in ("", "1.1")
    assert L.differences(["a", "b", "c"], ["x", "a", "q", "b", "c", "y"]) == ([], ["q"])
    wrapped = L.TEMPLATES[2][1].replace(" to deal", "\n * to deal").replace("modify", "modify,\n * really,")
    assert ("MIT", True) in {r[:2] for r in L.judge(wrapped)}


def test_defined_cases(spark):
    far = "x " * 100_000 + "Licensed under CC BY-NC 4.0. " + "y " * 100_000
    rows = [(None, None, 1), (1, "", 2), (2, "the driving licence of my aunt", 3), (3, far, 4), (4, "Released under the MIT License.\n\n\nLicensed under CC BY 4.0.", 5)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, gain int")
    out = L.scan(df, keep=["doc_id", "gain"])
    assert out.columns == ["doc_id", *L.FOUND.names]
    got = Counter((r.doc_id, r.license) for r in out.collect() if r.confirmed)
    assert got == {(3, "CC-BY-NC-4.0"): 2, (4, "MIT"): 2, (4, "CC-BY-4.0"): 2}
    assert L.scan(df.limit(0)).count() == 0


def test_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in planted.items() if v in r.text}
    assert want and {(r.doc_id, r.license) for r in L.scan(docs, keep=["doc_id"]).collect() if r.confirmed} == want


def test_many_notices_in_one_block(spark):
    names = Counter(name for name, _ in L.TEMPLATES)
    lists = ["\n".join(t for _, t in L.TEMPLATES), "\n\n".join(f"* package {i}: {t}" for i, (_, t) in enumerate(reversed(L.TEMPLATES))), " ".join(t for _, t in L.TEMPLATES)]
    got = L.scan(spark.createDataFrame(list(enumerate(lists)), "doc_id int, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got if r.confirmed) == {(i, n): k for i in range(3) for n, k in names.items()}


def test_every_template_has_a_trigger():
    assert all(any(re.search(L.TRIGGER, w) for w in L.words(t)) for _, t in L.TEMPLATES)


def everywhere(text):
    """Every template at every word of the candidate blocks, whatever its gain."""
    around = L.placed(text)
    mine = [w for w, _, _ in around]
    out = []
    for reach, templates in L.classes():
        for a, b in L.blocks(mine, reach):
            for name, template in ((L.TEMPLATES[k][0], L.words(L.TEMPLATES[k][1])) for k in templates):
                most = L.MOST_DIFFERENT * len(template)
                for at in range(a, b):
                    missing, extra, i, j = L.aligned(template, mine[at : min(b, at + len(template) + int(most) + 1)])
                    if len(missing) + len(extra) <= most and not any(L.decides(w, name) for w in (*missing, *extra)):
                        out.append((5 * (len(missing) + len(extra)) - len(template), at + i, at + j, name, 0.0, missing, extra))
    return sorted((around[i][1], around[j - 1][2], name) for _, i, j, name, *_ in L._apart(out))


def test_every_template_at_every_place():
    rng = random.Random(3)
    short = [t for t in L.TEMPLATES if len(L.words(t[1])) < 60]
    told = 0
    for _ in range(12):
        text = []
        for _, t in rng.sample(short, 3):
            text += rng.choices(["the", "of", "work", "under", "license", "a", "version"], k=rng.randrange(0, 6))
            notice = t.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = rng.choice(["other", "words", "license"])
            text += notice
        text = rng.choice([" ", "\n"]).join(text)
        got = sorted((a, b, name) for a, b, name, sure, *_ in L.licenses(text) if sure)
        assert got == everywhere(text), text
        told += len(got)
    assert told > 15


def test_long_texts():
    """A trigger in every line, wording far from any line's end, and time that grows with the length."""
    lines = "this line has the word license in it and some more words to read\n"
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        assert [r for r in L.licenses(lines * n) if r[3]] == []
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1
    mit = L.TEMPLATES[2][1]
    one_line = "x " * 3000 + mit + " y" * 3000 + " " + mit.replace("Software", "Works", 1)
    assert [(r[2], r[3]) for r in L.licenses(one_line)] == [("MIT", True)] * 2


def test_wrapped_notices(spark):
    rows = []
    for width in (20, 33, 50, 66, 72, 79):
        for comment in ("", " * ", "# "):
            for k, (_, text) in enumerate(L.TEMPLATES):
                lines = [comment + x for x in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False)]
                rows.append((k, "\n".join(["first of all the words", "of a file", *lines, "and then the rest of it", "or any more"])))
    got = L.scan(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, k int, text string")).collect()
    times = Counter((r.doc_id, r.license) for r in got if r.confirmed)
    assert [i for i, (k, _) in enumerate(rows) if times[i, L.TEMPLATES[k][0]] != 1] == []
    mpl = [r for r in got if "Source Code Form" in L.TEMPLATES[r.k][1] and r.confirmed]
    assert all("This Source Code Form" in r.text[r.start : r.end].replace("\n", " ").replace(" * ", " ").replace(" # ", " ").replace("  ", " ") for r in mpl)
    assert {r.doc_id for r in got if not r.confirmed} == set()


NEIGHBOURS = {
    "Licensed under the Apache License, Version 1.1.": None,
    L.TEMPLATES[4][1].replace("2.0", "1.1"): None,
    "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-\n# ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 International License.": None,
    "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.": None,
    "This work is licensed under the GNU General Public License, version 2.": None,
    "This work is licensed under the GNU Affero General Public License, version 3.": None,
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": None,
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0-only",
    "SPDX-License-Identifier: WTFPL": None,
}


def test_neighbours_are_told_apart():
    for text, name in NEIGHBOURS.items():
        for whole in (text, f"some words\n# {text}\nmore words", f"> {text}"):
            assert {r[2] for r in L.licenses(whole) if r[3]} == ({name} if name else set()), whole


def test_every_template_is_only_itself():
    """No wording is confirmed as another license, alone or quoted."""
    for name, text in L.TEMPLATES:
        for whole in (text, "\n".join("> " + x for x in textwrap.wrap(text, 60, break_on_hyphens=False)), "\n".join("| " + x for x in textwrap.wrap(text, 40, break_on_hyphens=False))):
            assert {r[2] for r in L.licenses(whole) if r[3]} == {name}, (name, whole[:80])
