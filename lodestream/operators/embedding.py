"""Models from outside as functions: embedding in batches, reranking, query expansion. What they are and where they run is the caller's."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import incremental
from lodestream.operators.stored import Store, bucket_of
from lodestream.session import cut

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], str]
Expander = Callable[[str], list[str]]


def _tried(call: Callable[[], object], tries: int, wait: float):
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2


def embed(passages: DataFrame, embedder: Embedder, *, model: str, batch: int = 64, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """passages(id, text) to (id, vector, model). A batch is tried several times, each wait twice the one before, then fails the task (which Spark tries again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                vectors = _tried(lambda: embedder(texts), tries, wait)  # noqa: B023
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([model] * len(texts))], names=["id", "vector", "model"])

    source = passages.select("id", F.col("text").cast("string"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, vector array<float>, model string")


def completed(passages: DataFrame, vectors: DataFrame, embedder: Embedder, *, model: str, **how) -> DataFrame:
    """vectors with those that passages still lack; a run that was lost goes on from what is stored."""
    waiting = incremental.pending(passages, vectors, model)
    fresh = embed(waiting, embedder, model=model, **how)
    return incremental.replaced(vectors, fresh, waiting, ["id"])


def keep_completed(store: Store, passages: DataFrame, embedder: Embedder, *, model: str, buckets: int = 64, buckets_a_stride: int = 4, **how) -> int:
    """Bring the store's table of vectors up to passages(id, text), stride by stride; how many strides had something to do.

    Vectors are in buckets by identifier. A stride takes some buckets, embeds the passages in them that lack a vector of this model and
    moves the store's marker, so a run that fails after k strides leaves k of them done, and the next run embeds the rest alone.
    """
    buckets, done = store.info.setdefault("vector_buckets", buckets), 0
    spark = passages.sparkSession
    placed = passages.select(bucket_of(buckets, "id").alias("bucket"), "id", "text")
    kind = placed.schema["id"].dataType.simpleString()
    for at in range(0, buckets, buckets_a_stride):
        stride = list(range(at, min(at + buckets_a_stride, buckets)))
        held = store.read("vectors", stride) if "vectors" in store else spark.createDataFrame([], f"bucket int, id {kind}, vector array<float>, model string")
        waiting = cut(incremental.pending(placed.filter(F.col("bucket").isin(stride)), held, model))
        if waiting.isEmpty():
            continue
        fresh = embed(waiting, embedder, model=model, **how).withColumn("bucket", bucket_of(buckets, "id")).select("bucket", "id", "vector", "model")
        store.replace("vectors", fresh, waiting.select("bucket", "id"), ["id"])
        store.commit()
        done += 1
    return done


def order_from(reply: str, n: int) -> list[int]:
    """The order that a reply names, by numbers from 1: those in range, once each, then the rest as they stood."""
    named = dict.fromkeys(int(x) - 1 for x in re.findall(r"\d{1,9}", reply or "") if 0 < int(x) <= n)
    return [*named, *(i for i in range(n) if i not in named)]


def rerank(found: DataFrame, reranker: Reranker, *, window: int = 10) -> DataFrame:
    """found(query_id, place, id, query, text) with the first places of each query in the order of the reranker's reply; a reranker that fails changes nothing."""
    first = found.filter(F.col("place") < window)

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        try:
            order = order_from(reranker(rows["query"].iloc[0], rows["text"].tolist()), len(rows))
        except Exception:  # a model that is away must not cost the result
            order = list(range(len(rows)))
        out = rows.iloc[order].copy()
        out["place"] = rows["place"].to_numpy()
        return out

    ordered = first.groupBy("query_id").applyInPandas(step, first.schema)  # at most window rows a query
    return ordered.unionByName(found.filter(F.col("place") >= window))


def expanded(queries: DataFrame, expander: Expander, *, most: int = 3) -> DataFrame:
    """queries(query_id, text) to (query_id, variant, text): the query itself is variant 0, then at most so many others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, variants, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    more = [t for t in expander(text or "") if t and t != text]
                except Exception:
                    more = []
                for k, t in enumerate([text, *list(dict.fromkeys(more))[:most]]):
                    keys.append(key)
                    variants.append(k)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(variants, pa.int32()), pa.array(texts, pa.string())], names=["query_id", "variant", "text"])

    source = queries.select("query_id", F.col("text").cast("string"))
    return source.mapInArrow(run, f"query_id {source.schema['query_id'].dataType.simpleString()}, variant int, text string")


def event_data(lines: DataFrame, *, stream: str = "stream", order: str = "n", value: str = "value") -> DataFrame:
    """The data of server-sent events (the WHATWG format) among the lines of streams: one row per event, its data lines joined; [DONE] is none."""
    turn = Window.partitionBy(stream).orderBy(order)
    marked = lines.withColumn("event", F.sum(F.when(F.trim(value) == "", 1).otherwise(0)).over(turn))
    data = marked.filter(F.col(value).startswith("data:")).withColumn("data", F.regexp_replace(value, "^data: ?", ""))
    whole = data.groupBy(stream, "event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "data"))), lambda x: x["data"]), "\n").alias("data"))
    return whole.filter("data <> '[DONE]'")
