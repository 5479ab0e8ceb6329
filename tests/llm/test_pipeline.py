"""The pipeline's stages on a table with odd rows, each against what it should keep."""

import math

import pytest

import corpus_pipeline as P
from barquet.llm import bpe, pii, queries
from tests.llm.test_pii import brute as _  # noqa: F401  (the network itself is tested there)

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [
        (9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, "123 456", "en", "src1", 7), (None, "the words of that and this are here for the", None, "src2", None),
        (9004, "the words of that and this are here for the call +1 (017) 555-7713", "en", None, 1), (9004, "the words of that and this are here for the call +1 (017) 555-7713", "en", None, 1),
    ]
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    real.unionByName(spark.createDataFrame(odd, COLUMNS)).write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, docs, tmp_path_factory):
    kept, out = docs, {}
    for name, stage in P.STAGES:
        made = stage(spark, kept, "unused")
        path = str(tmp_path_factory.mktemp("s") / name)
        made.write.parquet(path)
        kept = out[name] = spark.read.parquet(path)
        if name != "bpe":
            assert kept.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    gone = ids(docs) - ids(out["language"])
    assert {9001, 9002, 9003} <= gone and len(gone) <= 5
    near = out["near_duplicates"].collect()
    assert len({r.doc_id for r in near}) == len(near) and sum(r.doc_id == 9004 for r in near) == 1 and None in {r.doc_id for r in near}
    before = {r.doc_id: r.text for r in near}
    want = {r.doc_id: r.text for r in pii.pseudonymize(out["near_duplicates"], queries.PII_KEY).collect()}
    for r in out["pii"].collect():
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text)
    assert want[9004] != before[9004]
    copies = {}
    for r in out["mix"].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2 and math.isclose(sum(copies.values()) / len(near), 1.5, abs_tol=0.35)
    last = out["bpe"].collect()
    assert len(last) == sum(copies.values())
    made = bpe._tokenizer(queries.tokenizer())
    for r in last[:50]:
        assert r.ids == made.encode(want[r.doc_id], add_special_tokens=False).ids


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "ids_sha256" in out.columns


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0
