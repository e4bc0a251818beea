"""A training corpus from documents: toxic texts go, then exact and near copies, then sources are mixed and encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. The last gives
doc_id, n_tokens, ids, ids_sha256 and decoded_sha256, one row per copy that the mix emits.

Defined cases: null texts count as empty everywhere and pass toxicity by the model's prior; of equal texts one row stays,
null identifiers losing; documents without words are near copies of nothing; null sources are a source; repeated rows are
one text; very long texts go through whole; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import bpe, mixing, patricia, superminhash, toxicity
from lodestream.session import remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return patricia.distinct_texts(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays."""
    return superminhash.one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses the model and the tokenizer; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again; a stage's input goes once it is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
