"""Blocks and ranges: a bounded number of rows for each block, whatever the size of the input."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from barquet.llm import blocks, bpe, jaccard, lm
from barquet.llm.queries import tokenizer
from tests.llm.test_jaccard import brute, joined, texts


def sent(name, rows, p):
    """Rows that one block of these texts asks with."""

    class Docs:
        def mapInArrow(self, run, schema):
            return sum(b.num_rows for b in run(iter([rows])))

    return {"jaccard": lambda: jaccard._ask(Docs(), 5, p), "bpe": lambda: bpe.ask(Docs(), "text", p), "lm": lambda: lm.ask(Docs(), "text", "train", p)}[name]()


@pytest.mark.parametrize("name", ["jaccard", "bpe", "lm"])
def test_rows_of_a_block(name):
    words = [f"word{i}" for i in range(40_000)]
    rows = pa.record_batch({"text": [" ".join(words)], "train": [True]})
    for buckets in (12, 1000, 12_500, 10_000_000):
        assert sent(name, rows, blocks.Plan.of(1, buckets)) <= min(buckets, blocks.FAN_OUT)


def test_ranges_hold_whole_buckets():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 10_000, np.uint64))
    for buckets in (12, 1024, 1025, 5000):
        p = blocks.Plan.of(1, buckets)
        assert buckets <= p.buckets < buckets + p.within and p.ranges <= blocks.FAN_OUT
        fine = blocks.bucket_of(keys, p.buckets)
        assert (fine // np.uint64(p.within) == blocks.bucket_of(keys, p.ranges)).all()
        for k, part in blocks.runs(keys, p.ranges):
            at = blocks.within(keys[part], k, p)
            assert at[0] == 0 and (np.repeat(np.arange(p.within) + k * p.within, np.diff(at)) == fine[part]).all()


def test_frames():
    for bodies in ([], [b""], [b"a", b"", b"cde"]):
        assert blocks.unframe(blocks.frame(bodies)) == bodies


@pytest.fixture
def several(monkeypatch):
    """Ranges of several buckets each."""
    monkeypatch.setattr(blocks, "FAN_OUT", 3)


def test_join_of_several_buckets(spark, several):
    rows = list(enumerate(texts(5)))
    assert joined(spark, rows) == brute(rows)


@pytest.mark.parametrize("run", ["bpe", "lm"])
def test_same_as_one_bucket_each(spark, monkeypatch, run):
    rows = [(i, t, i % 7 != 2) for i, t in enumerate([*texts(6), None, "", "  "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4, "doc_id")
    made = {"bpe": lambda: bpe.encode(docs, tokenizer(), keep=["doc_id"]), "lm": lambda: lm.score(docs, keep=["doc_id"])}[run]
    one = sorted(map(str, made().collect()))
    monkeypatch.setattr(blocks, "FAN_OUT", 3)
    assert sorted(map(str, made().collect())) == one


def test_distinct_keys():
    """Sorted and distinct; the keys given stay as they are."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        for top in (1, 3, 1 << 63):
            keys = rng.integers(0, top, n, np.uint64)
            before = keys.copy()
            assert blocks.distinct(keys).tolist() == sorted(set(keys.tolist())) and (keys == before).all()


def test_counts_are_exact():
    keys, counts = blocks.counted([np.array([3, 5], np.uint64), np.array([5, 1], np.uint64)], [np.array([1, 1 << 53], np.uint64), np.array([1, 2], np.uint64)])
    assert keys.tolist() == [1, 3, 5] and counts.tolist() == [2, 1, (1 << 53) + 1]
    assert [len(x) for x in blocks.counted([], [])] == [0, 0]


HELD = """
import ctypes
import re
from pathlib import Path
import numpy as np, pyarrow as pa
from barquet.llm import blocks, bpe, jaccard

def held():
    return int(re.search(r"\\nAnonymous: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

class Docs:
    def mapInArrow(self, run, schema):
        return sum(b.num_rows for b in run(made() for _ in range(2)))

def made():
    words = np.random.default_rng(0).integers(0, 1 << 40, 1_200_000)
    return pa.record_batch({"text": [" ".join(map(str, words[k : k + 600].tolist())) for k in range(0, len(words), 600)]})

ask = {"jaccard": lambda: jaccard._ask(Docs(), 5, p), "bpe": lambda: bpe.ask(Docs(), "text", p)}
p = blocks.Plan.of(2, 12)
made(), blocks.tokens._powers(), pa.default_memory_pool().release_unused(), ctypes.CDLL(None).malloc_trim(0)
before = held()
assert ask[NAME]() > 0
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
@pytest.mark.parametrize("name", ["jaccard", "bpe"])
def test_memory_is_given_back(name):
    code = HELD.replace("NAME", repr(name))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert float(out.stdout) < 40
