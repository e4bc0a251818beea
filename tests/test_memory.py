"""What a task holds at a time does not grow with the rows of its batches."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lodestream.operators import hybrid, text_search


def test_scores_of_many_pairs_are_made_in_bounded_slices():
    """4000 documents of 50 terms that 100 queries ask for are 20,000,000 pairs: over a GB at once."""
    words, queries, documents = [f"w{i}" for i in range(50)], 100, 4000
    block = object.__new__(text_search._Block)
    times = np.full(len(words), queries)
    block.words, block.k1, block.b, block.n_all, block.n_words = SimpleNamespace(value=words), 1.2, 0.75, documents, documents * len(words)
    block.sent = SimpleNamespace(value=(np.arange(queries), np.ones(len(words)), np.tile(np.arange(queries), len(words)), np.cumsum(times) - times, times))
    batch = pa.RecordBatch.from_arrays([pa.array(range(documents), pa.int64()), pa.array([words] * documents)], names=["id", "tokens"])
    tracemalloc.start()
    met, seen = 0, []
    for scores, shared, ids in block.scores(iter([batch])):
        assert np.allclose(scores, len(words)) and (shared == len(words)).all()
        met, seen = met + shared.size, seen + ids.tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met == queries * documents and seen == list(range(documents)) and peak < 150 << 20


WORDS = " ".join(f"w{i}" for i in range(50))


@pytest.fixture
def watched(monkeypatch):
    """Tasks that hold more than 150 MB in Python fail."""
    whole = DataFrame.mapInArrow

    def limited(self, func, schema, *more, **named):
        def run(batches):
            tracemalloc.start()
            yield from func(batches)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 150 << 20, f"a task held {peak >> 20} MB"

        return whole(self, run, schema, *more, **named)

    monkeypatch.setattr(DataFrame, "mapInArrow", limited)


def test_the_tasks_of_a_hybrid_search_hold_no_more_for_more_passages_of_a_batch(spark, watched):
    """4000 passages, 100 queries of 50 terms that all of them have: 471 MB in a task when a batch's scores of words were made at once."""
    vector = F.array(*[(F.col("id") % (i + 2)).cast("float") + 1 for i in range(64)])
    passages = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 5).alias("group"), F.lit(WORDS).alias("text"), vector.alias("vector"))
    queries = spark.range(0, 100, 1, 1).select(F.col("id").alias("query_id"), F.lit(WORDS).alias("text"), vector.alias("vector"))
    found = hybrid.retrieve(passages, queries, k=10).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r.query_id, r.n) for r in found) == [(q, 10) for q in range(100)]


def test_the_tasks_of_a_ranking_by_words_hold_no_more_for_more_documents_of_a_batch(spark, watched):
    """All documents are alike, so the smallest ids come first."""
    docs = spark.range(0, 4000, 1, 1).select("id", F.lit(WORDS).alias("text"))
    queries = spark.range(0, 100, 1, 1).select(F.col("id").alias("query_id"), F.lit(WORDS).alias("text"))
    found = text_search.bm25_top(docs, queries, 20).select("query_id", "id", "place").collect()
    assert sorted(map(tuple, found)) == [(q, i, i) for q in range(100) for i in range(20)]
