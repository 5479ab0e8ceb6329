"""Ids and bytes against the tiktoken library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from barquet.llm import blocks, bytebpe, queries


@pytest.fixture(scope="module")
def tokenizer():
    return queries.byte_tokenizer()


def check(spark, tokenizer, texts):
    plain = tiktoken.Encoding("plain", pat_str=tokenizer.pattern, mergeable_ranks=tokenizer.ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = bytebpe.encode(df, tokenizer).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids), repr(texts[r.doc_id])[:200]
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() == plain.decode_bytes(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
    again = bytebpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id int, ids array<int>"), tokenizer).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in again)


def test_random_texts(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    rng = random.Random(3)
    parts = ["the", "The", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", " ", "​", "é", "é", "Σ", "'s", "'S", "'ll", "''re", "12", "½", "²", "!!", "...", "日本", "한국어", "नमस्ते", "😀", "‍", "<|endoftext|>", "x" * 40, "ﬁ", "Ⅻ", "Ᲊ", "\U00010d40", "\U00013460", "\x00", "\x01", "\x01a", "\x01b", "\x01\n", "_", "--", "abab"]
    check(spark, tokenizer, ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)])


def test_defined_cases(spark, tokenizer):
    check(spark, tokenizer, [None, "", " ", "  ", "\n", "a", "a", "word " * 30_000, "z" * 3_000, "<|endoftext|>"])
    assert bytebpe.encode(spark.createDataFrame([], "doc_id int, text string"), tokenizer).count() == 0


def test_whole_table(spark, tokenizer):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    check(spark, tokenizer, [r.text for r in rows])


def test_every_character_is_classed_as_the_library_does(spark, tokenizer):
    """All code points, between a letter, a digit and a mark: the words are those of the library."""
    plain = tiktoken.Encoding("bytes", pat_str=tokenizer.pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    pieces = tiktoken.Encoding("class", pat_str=r"\p{L}", mergeable_ranks=plain._mergeable_ranks, special_tokens={})
    numbers = tiktoken.Encoding("number", pat_str=r"\p{N}", mergeable_ranks=plain._mergeable_ranks, special_tokens={})
    spaces = tiktoken.Encoding("space", pat_str=r"\s", mergeable_ranks=plain._mergeable_ranks, special_tokens={})
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kind = lambda c: 2 if pieces.encode_ordinary(c) else 3 if numbers.encode_ordinary(c) else 1 if spaces.encode_ordinary(c) else 4
    df = spark.createDataFrame([(c, kind(c)) for c in every], "c string, kind int")
    # a letter, number or mark joins its like; white space is cut off by a letter that follows
    words = F.regexp_extract_all(F.concat(F.lit("b"), "c", F.lit("1"), "c", F.lit("!"), "c"), F.lit(bytebpe.spark_pattern(tokenizer.pattern)), F.lit(0))
    want = {2: ["bX", "1", "X", "!", "X"], 3: ["b", "X1X", "!", "X"], 4: ["b", "X", "1", "X!X"], 1: ["b", "X", "1", "X", "!", "X"]}
    for k, split in want.items():
        shape = F.array(*(F.replace(F.lit(x), F.lit("X"), F.col("c")) for x in split))
        space = F.array(*(F.lit(x) if x != "X" else F.col("c") for x in ["b", "X", "1", "X", "!", "X"]))
        wrong = df.where(F.col("kind") == k).where(words != (space if k == 1 else shape)).where("c <> ' '")
        assert wrong.count() == 0, (k, [hex(ord(r.c)) for r in wrong.take(5)])


def test_ranks_out_of_order(spark):
    """A token with a lower rank than one it is made of by the only way: pairs are joined one at a time."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 301, b"abc": 300, b"bb": 302, b"cab": 299, b"abab": 298}
    assert not bytebpe.in_order(ranks)
    tokenizer = bytebpe.Ranks(ranks, queries.byte_tokenizer().pattern)
    rng = random.Random(4)
    check(spark, tokenizer, ["".join(rng.choices("abc", k=rng.randrange(14))) for _ in range(150)])


def test_given_ranks_are_in_order(tokenizer):
    assert tokenizer.at_once


def test_rows_of_a_block_are_bounded(spark, tokenizer):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(5000)),)], "text string").select(F.split("text", " ").alias("__words"))
    assert bytebpe.ask(df, 16).count() == 16
