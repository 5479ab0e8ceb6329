"""Ids and pieces against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from barquet.llm import blocks, bpe, queries

SPECIAL = ["<|startoftext|>", "<|endoftext|>"]


@pytest.fixture(scope="module")
def definition():
    return queries.tokenizer()


def check(spark, definition, texts):
    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = bpe.encode(df, definition).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = made.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = made.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == back, repr(texts[r.doc_id])[:200]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    again = bpe.decode(spark.createDataFrame([(r.ids,) for r in got], "ids array<int>"), definition).collect()
    assert [r.decoded for r in again] == [r.decoded for r in got]


def test_random_texts(spark, definition, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    rng = random.Random(1)
    parts = ["the", "The", " ", "  ", "\n", "\t", " ", " ", "é", "é", "́", "Σ", "ΑΣ", "İ", "ß", "'s", "'S", "''ll", "12", "½", "²", "!!", "'", "don't", "日本", "😀", "‍", *SPECIAL, "<|", "|>", "x" * 40, "\x85", "\x1c", "ﬁ", "Ⅻ", "á̧"]
    check(spark, definition, ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(400)])


def test_defined_cases(spark, definition):
    check(spark, definition, [None, "", " ", " ", "a", "a", "word " * 30_000, "z" * 20_000, SPECIAL[0], f"a{SPECIAL[1]}b"])
    none = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.encode(none, definition).count() == 0


def test_whole_table(spark, definition):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    check(spark, definition, [r.text for r in rows])


def test_decode_defined_cases(spark, definition):
    df = spark.createDataFrame([(None,), ([],), ([320, None, 10**6],)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(df, definition).collect()]
    assert got[0] is None and got[1] == "" and got[2] and " " not in got[2]
