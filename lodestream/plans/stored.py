"""Queries over kept indexes: built in a folder of the shared one, brought up to date, and asked through a fresh reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.stored_cells import VectorIndex
from lodestream.operators.stored_index import Index
from lodestream.plans.retrieval import DIM, _benchmark, _docs, _queries, _vectors
from lodestream.registry import oracle_sql, register
from lodestream.session import scratch


@register("bm25_stored", oracle_sql()["bm25_topk"])
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over an earlier state of the documents (a fifth missing, a seventh with other texts, some that have gone since), refreshed, then ranked."""
    docs, folder = _docs(spark, sf_dir), scratch(spark, "bm25-stored")
    earlier = docs.filter("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, F.reverse("text")).otherwise(F.col("text")))
    gone = docs.filter("id % 3 = 0").select((-1 - F.col("id")).alias("id"), "text")
    Index(spark, folder).build(earlier.unionByName(gone))
    Index(spark, folder).refresh(docs.filter("id % 5 = 0 or id % 7 = 0"), gone.select("id"))
    return Index(spark, folder).top(_benchmark(spark, sf_dir), 20)


@register("ivf_stored", oracle_sql()["cosine_topk_batch"])
def ivf_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted file over all vectors but a fifth, a seventh of them turned round, refreshed, then asked exactly."""
    vectors, folder = _vectors(spark, sf_dir), scratch(spark, "ivf-stored")
    earlier = vectors.filter("id % 5 <> 0").withColumn("vector", F.when(F.col("id") % 7 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    VectorIndex(spark, folder).ensure(earlier, DIM)
    VectorIndex(spark, folder).refresh(vectors.filter("id % 5 = 0 or id % 7 = 0"), vectors.select("id").limit(0))
    return VectorIndex(spark, folder).top(_queries(vectors), 10, exact=True)
