"""From raw documents to token ids: five stages over the table ``documents``.

Each stage takes what the one before it kept, as a Parquet table, and all but the last return the columns of
``documents``. Defined cases are those of the operators; in short: documents without text or letters go in the first
stage, rows without id are kept apart from near-duplicate search, null sources are a source of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.llm import bpe, jaccard, language, mixing, pii
from barquet.llm.queries import MIX_SEED, PII_KEY, tokenizer
from barquet.session import scratch, table

#: Least share of a document's letters that its language must have, and of those in scripts that this language is
#: written in. Mixed texts pass; texts in no language, or in scripts that none of the learned ones uses, don't.
LEAST_SHARE, LEAST_IN_SCRIPT = 0.4, 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a known language, and name it in ``lang``."""
    found = language.identify(docs, language.fit(docs))
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE) & (F.col("in_script") >= LEAST_IN_SCRIPT))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms for personal data, and count the characters anew."""
    return pii.pseudonymize(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(mixing.mix(docs, seed=MIX_SEED)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, tokenizer(), keep=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "ids_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("pii", without_personal_data),
    ("mix", mixed),
    ("bpe", encoded),
]

#: The Viterbi labels and the tokenizer's merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the cluster's shared folder and read again."""
    place = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{place}/{k}-{name}")
            docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
