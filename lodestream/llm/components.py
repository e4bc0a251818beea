"""Connected components of an edge list by union-find inside tasks and star contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges with the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)].tolist(), at[len(a) :].tolist()
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left, right):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def _contract(batches):
    """Edges of one task to the stars of their components; a batch at a time, so memory stays bounded."""
    for batch in batches:
        if batch.num_rows:
            nodes, roots = union_find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            own = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) to rows (node, component): every node of an edge and its smallest reachable node.

    Large-star and small-star steps (each a minimum per node and a join) alternate until the stars stand still;
    minima are combined before the shuffle, so a node that is linked with a third of all others is no single task.
    """
    stars = cut(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a > b").mapInArrow(_contract, "a long, b long").distinct())
    mark = None
    for _ in range(most_rounds):
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        hung = large.join(low, F.col("a") == F.col("u"))
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("u", "m")).filter("a > b").distinct()
        stars = cut(small)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"the components did not settle within {most_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select("b", "b").distinct())
