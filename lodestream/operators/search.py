"""Retrieval in one call: variants of the queries, hybrid retrieval, merging, reranking, and the passages around what was found.

Each variant of a query is retrieved as a query of its own, in the same batch; a passage keeps its best score over the variants.
The first places may then be put in order by a reranker, and every hit gets the texts of its neighbours in the same file.

Defined cases: a variant or query without a vector goes by its words alone; without words and vector it finds nothing; an expander or
reranker that fails changes nothing; passages without a file or ordinal have their own text as context; ties go to the smaller identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import chunking, embedding, hybrid
from lodestream.session import cut

#: Variants of a query at most, itself included; queries are told apart by query_id * VARIANTS + variant meanwhile.
VARIANTS = 16


def _asked(queries: DataFrame, expander: embedding.Expander | None, most: int, vectors_of: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Queries and their variants as (query_id, text, vector), under numbers that hold both."""
    number = lambda variant: (F.col("query_id") * VARIANTS + variant).alias("query_id")
    own = queries.select(number(F.lit(0)), "text", F.col("vector").cast("array<double>").alias("vector"))
    if expander is None:
        return own
    if most >= VARIANTS:
        raise ValueError(f"at most {VARIANTS - 1} variants")
    more = embedding.expanded(queries.select("query_id", "text"), expander, most=most).filter("variant > 0").select(number(F.col("variant")), "text")
    more = vectors_of(more) if vectors_of else more.withColumn("vector", F.lit(None).cast("array<double>"))
    return cut(own.unionByName(more.select("query_id", "text", F.col("vector").cast("array<double>").alias("vector"))))  # a model's replies are asked for once


def search(passages: DataFrame, queries: DataFrame, *, k: int = 10, expander: embedding.Expander | None = None, most: int = 3, vectors_of: Callable[[DataFrame], DataFrame] | None = None, reranker: embedding.Reranker | None = None, window: int = 10, radius: int = 1, **retrieval) -> DataFrame:
    """passages(id, group, ordinal, text, vector), queries(query_id, text, vector) to (query_id, place, id, group, ordinal, score, context).

    group is the passage's file. expander gives other wordings of a query's text, vectors_of their vectors (query_id, text to query_id, text, vector).
    """
    found = hybrid.retrieve(passages, _asked(queries, expander, most, vectors_of), k=k, **retrieval)
    found = found.withColumn("query_id", F.floor(F.col("query_id") / VARIANTS).cast("long"))
    hits = hybrid.merged(found, k).select("query_id", (F.col("rank") - 1).alias("place"), "id", "score")
    told = passages.select("id", "group", "ordinal", "text")
    hits = cut(hits.join(told, "id"))  # k rows a query
    if reranker is not None:
        rows = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("query_id", "place", "id", "query", "text")
        placed = embedding.rerank(rows, reranker, window=window).select("query_id", "place", "id")
        hits = hits.drop("place").join(placed, ["query_id", "id"])
    near = hits.select(F.col("group").alias("id"), "ordinal").distinct()
    around = chunking.with_neighbours(near, told.select(F.col("group").alias("id"), "ordinal", "text"), radius).withColumnRenamed("id", "group")
    out = hits.join(around, ["group", "ordinal"], "left")
    return out.select("query_id", "place", "id", "group", "ordinal", "score", F.coalesce("context", "text").alias("context"))
