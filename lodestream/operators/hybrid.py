"""Hybrid retrieval: a lexical and a semantic arm, fused by reciprocal rank, over a batch of queries.

The lexical arm is BM25, the semantic one cosine; each brings its best candidates, and both scores are then known for
every candidate of either. A candidate stays if its cosine reaches a floor or a query term hits it. Reciprocal rank
fusion orders the rest; queries without a vector fall back to the lexical ranking alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.vectors import cosine
from lodestream.operators import text_search, vector_search


def first_groups(ranked: DataFrame, groups: int, *, key: str = "query_id", group: str = "group", rank: str = "place") -> DataFrame:
    """The rows of each key's first so many distinct groups, in the order of their best ranked row; null is a group."""
    best = ranked.groupBy(key, group).agg(F.min(rank).alias("__best"))
    turn = best.withColumn("__turn", F.row_number().over(Window.partitionBy(key).orderBy("__best"))).filter(F.col("__turn") <= groups)
    kept = turn.select(F.col(key).alias("__key"), F.col(group).alias("__group"))
    return ranked.join(kept, (F.col(key) == F.col("__key")) & F.col(group).eqNullSafe(F.col("__group")), "left_semi")


def first_of_group(ranked: DataFrame, *, key: str = "query_id", group: str = "group", rank: str = "place") -> DataFrame:
    """The best ranked row of each group."""
    return ranked.withColumn("__turn", F.row_number().over(Window.partitionBy(key, group).orderBy(rank))).filter("__turn = 1").drop("__turn")


def merged(results: DataFrame, k: int) -> DataFrame:
    """Results (query_id, variant, id, score) of several variants of a query: the best score of each row, then the k best."""
    best = results.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return vector_search.ranked(best, k)


def candidates(passages: DataFrame, queries: DataFrame, *, lexical: int, semantic: int, groups: int, dim: int) -> DataFrame:
    """(query_id, id, group, similarity, keyword): every candidate of either arm with both scores (null: not comparable, not hit)."""
    docs = passages.select("id", "text")
    hits = text_search.bm25_top(docs, queries.select("query_id", "text"), lexical)
    hits = first_groups(hits.join(passages.select("id", "group"), "id"), groups)
    asked = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
    near = vector_search.top_k(passages.select("id", "vector"), asked, semantic, dim)
    both = hits.select("query_id", "id", F.col("score").alias("keyword")).join(near.select("query_id", "id", F.col("score").alias("similarity")), ["query_id", "id"], "full")
    # hits that the semantic arm did not bring are scored now: at most `lexical` a query
    known = both.join(passages.select("id", "group", "vector"), "id").join(asked.withColumnRenamed("vector", "wanted"), "query_id", "left")
    comparable = F.col("wanted").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == F.size("wanted"))
    late = F.when(comparable, F.round(cosine(F.col("vector"), F.col("wanted")), vector_search.DIGITS))
    return known.select("query_id", "id", "group", F.coalesce("similarity", late).alias("similarity"), "keyword", F.col("wanted").isNotNull().alias("semantic"))


def retrieve(passages: DataFrame, queries: DataFrame, *, lexical: int = 100, semantic: int = 100, groups: int = 20, floor: float = 0.2, k: int = 10, rrf: int = 60, dim: int = 64) -> DataFrame:
    """passages(id, group, text, vector), queries(query_id, text, vector) to (query_id, place, id, group, similarity, score).

    score is the sum of 1 / (rrf + rank), ranks from 0, of the arms that have the passage; for a query without vector that of
    the lexical ranking alone. Ties go to the smaller id.
    """
    found = candidates(passages, queries, lexical=lexical, semantic=semantic, groups=groups, dim=dim)
    kept = found.filter(F.col("keyword").isNotNull() | F.coalesce(F.col("similarity") >= floor, F.lit(False)))
    arm = lambda score: F.when(F.col(score).isNotNull(), F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), "id")) - 1)
    ordered = kept.withColumn("by_meaning", arm("similarity")).withColumn("by_words", arm("keyword"))
    part = lambda rank: F.coalesce(1.0 / (rrf + F.col(rank)), F.lit(0.0))
    scored = ordered.withColumn("score", F.round(part("by_meaning") + part("by_words"), 9))
    return text_search.ranks(scored, "place", k).select("query_id", "place", "id", "group", "similarity", "score")


def recent_turns(turns: DataFrame, n: int, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every user turn with asked: the texts of the n user turns before it and its own, oldest first, parted by line ends."""
    users = turns.filter(F.col(role) == "user")
    last = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-n, Window.currentRow)
    return users.withColumn("asked", F.array_join(F.collect_list(F.coalesce(text, F.lit(""))).over(last), "\n"))
