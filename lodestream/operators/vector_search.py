"""Exact and inverted-file nearest neighbours by cosine similarity.

Published methods: exhaustive scan with a bounded top-k, and the inverted file (k-means cells, some of which are
probed). Many queries are answered in one pass: the query matrix is broadcast in blocks of a bounded size, tasks score
their vectors with matrix products over slices of bounded size and keep one running top-k per query, and only those
meet in the final ranking. Scores are rounded before they are compared, so equal ones are ordered by id everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.vectors import matrix_of, unit_rows

#: Numbers in the query matrix that may be broadcast (8 bytes each); more queries are answered in several passes.
BROADCAST_NUMBERS = 8_000_000
#: Queries of one pass: with more of them a slice of scores would have too few rows to be worth a look at each query.
MOST_QUERIES = 8192
#: Scores that a task holds at a time.
SCORES = 4_000_000
#: Digits behind the point that scores are compared by.
DIGITS = 6
#: Vectors that k-means looks at per cell, and in all, and its rounds: Faiss takes up to 256 per cell and 25 rounds.
SAMPLE_PER_CELL, MOST_SAMPLE, ROUNDS = 256, 100_000, 25


def _query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[list, np.ndarray]]:
    """The queries' ids and unit vectors, in blocks of a bounded size."""
    most = max(1, min(MOST_QUERIES, BROADCAST_NUMBERS // max(dim, 1)))
    ids, rows = [], []
    for r in queries.select("query_id", "vector").orderBy("query_id").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield ids, unit_rows(np.array(rows, np.float64))
            ids, rows = [], []
    if ids:
        yield ids, unit_rows(np.array(rows, np.float64))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties by id, with a rank from 1."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


class Best:
    """The k best of each query so far: scores and ids, best first, ties by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.least = np.full(queries, -np.inf)  # what a score has to reach
        self.scores = [np.zeros(0) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.scores[query]
        if len(own) == self.k:
            near = np.flatnonzero(scores >= own[-1])
            if not len(near):
                return
            scores, ids = scores[near], ids[near]
        if len(scores) > 4 * self.k:  # all that reach the k-th best, ties with it too
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = np.flatnonzero(scores >= least)
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate([own, scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[query] = self.scores[query][-1]

    def add_all(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows by queries; only queries that some row may enter are looked at one by one."""
        for q in np.flatnonzero((scores >= self.least).any(0)).tolist():
            self.add(q, scores[:, q], ids)

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        sizes = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.scores))], names=["query_id", "id", "score"])


FOUND = "query_id long, id long, score double"


def _usable(vectors: DataFrame, dim: int, *more: str) -> DataFrame:
    return vectors.filter(F.col("vector").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())).select(F.col("id").cast("long"), "vector", *more)


def _best_of(vectors: DataFrame, queries: DataFrame, k: int, dim: int, probed=None) -> DataFrame:
    """The ranked best of every query; probed gives a block's queries by cells as a matrix of which meet."""
    spark, out = vectors.sparkSession, None
    usable = _usable(vectors, dim, *(["cell"] if probed else []))
    for ids, matrix in _query_blocks(queries.filter(F.size("vector") == dim), dim):
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), matrix, probed(ids, matrix) if probed else None))

        def run(batches, sent=sent):
            names, block, meets = sent.value
            best, step = Best(len(names), k), max(1, SCORES // len(names))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    own, rows = part.column(0).to_numpy(), unit_rows(matrix_of(part.column(1), dim))
                    if meets is None:
                        best.add_all(np.round(rows @ block.T, DIGITS), own)
                        continue
                    cells = part.column(2).to_numpy()
                    for cell in np.unique(cells).tolist():
                        # vectors without a cell are always looked at
                        asking = np.flatnonzero(meets[:, cell]) if cell >= 0 else np.arange(len(names))
                        inside = np.flatnonzero(cells == cell)
                        scores = np.round(rows[inside] @ block[asking].T, DIGITS)
                        for j, q in enumerate(asking.tolist()):
                            best.add(q, scores[:, j], own[inside])
            yield best.batch(names)

        part = usable.mapInArrow(run, FOUND)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    return ranked(out, k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """vectors(id, vector), queries(query_id, vector) to (query_id, id, score, rank); other dimensions and nulls are left out."""
    return _best_of(vectors, queries, k, dim)


def coverage(vectors: DataFrame, queries: DataFrame, dim: int, floor: float) -> DataFrame:
    """Per query the best similarity to any vector (best) and how many reach floor (strong): maximum and count are kept in the tasks, no pair leaves them.

    Queries that no vector can be compared with are left out.
    """
    spark, out = vectors.sparkSession, None
    for ids, matrix in _query_blocks(queries.filter(F.size("vector") == dim), dim):
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), matrix))

        def run(batches, sent=sent):
            names, block = sent.value
            best, strong, step = np.full(len(names), -np.inf), np.zeros(len(names), np.int64), max(1, SCORES // len(names))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    scores = np.round(unit_rows(matrix_of(batch.column(1).slice(at, step), dim)) @ block.T, DIGITS)
                    best = np.maximum(best, scores.max(0))
                    strong += (scores >= floor).sum(0)
            some = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(best[some]), pa.array(strong[some])], names=["query_id", "best", "strong"])

        part = _usable(vectors, dim).mapInArrow(run, "query_id long, best double, strong long")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, best double, strong long")
    return out.groupBy("query_id").agg(F.max("best").alias("best"), F.sum("strong").alias("strong"))


def cells_for(vectors: int) -> int:
    """Cells of an inverted file over so many vectors: their root, within bounds that a broadcast of centroids allows."""
    return max(16, min(1 << 14, int(vectors**0.5)))


def outgrown(vectors: int, built_over: int | None) -> bool:
    """Whether an inverted file should be built again: none yet, or the table has doubled since."""
    return built_over is None or vectors > 2 * built_over


def train_cells(vectors: DataFrame, cells: int, *, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids of spherical k-means on a bounded sample (the first vectors by a hash of their id)."""
    sample = min(MOST_SAMPLE, SAMPLE_PER_CELL * cells)
    rows = vectors.filter("vector is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").toArrow().column(0)
    points = unit_rows(np.array(rows.to_pylist(), np.float64))
    if not len(points):
        return np.zeros((0, 0))
    centre = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, points)
        filled = np.bincount(near, minlength=len(centre)) > 0
        centre[filled] = unit_rows(total[filled])
    return centre


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with the column cell: the nearest centroid (the lowest of equals), -1 for vectors without one."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            cell = np.full(len(values), -1, np.int32)
            fit = [i for i, v in enumerate(values) if v is not None and sent.value.size and len(v) == sent.value.shape[1]]
            if fit:
                cell[fit] = (np.array([values[i] for i in fit], np.float64) @ sent.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{schema}, cell int")


def probe(celled: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """Top k among the rows of each query's nearest cells; rows without a cell are always looked at.

    Queries are broadcast in blocks of bounded size with the cells that each probes, so no row is shuffled to a cell.
    """

    def probed(ids: list, matrix: np.ndarray) -> np.ndarray:
        meets = np.zeros((len(matrix), len(centroids)), bool)
        np.put_along_axis(meets, np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        return meets

    return _best_of(celled, queries, k, centroids.shape[1], probed)


def probes_for(celled: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, *, wanted: float = 0.9, sample: int = 256) -> int:
    """The fewest probes whose recall at k, measured against the exact top k of the whole table, is at least wanted.

    Measured on the queries themselves, or on so many of them, the first by a hash of their id; of a sample, two
    standard errors below its recall have to reach wanted. Probing all cells is exact, so there is always an answer.
    """
    if not centroids.size:
        return len(centroids)
    dim = centroids.shape[1]
    usable = queries.filter(F.size("vector") == dim)
    asked = usable.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    part = usable.count() > sample
    place = {}
    for ids, matrix in _query_blocks(asked, dim):
        order = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")
        place |= zip(ids, np.argsort(order, axis=1))
    needed = {q: [] for q in place}
    for q, _, cell in F.broadcast(top_k(celled, asked, k, dim).select("query_id", "id")).join(celled.select("id", "cell"), "id").select("query_id", "id", "cell").collect():
        needed[q].append(place[q][cell] + 1 if cell >= 0 else 0)
    if not any(needed.values()):
        return len(centroids)
    for probes in range(1, len(centroids)):
        found = np.array([np.mean(np.array(n) <= probes) for n in needed.values() if n])
        error = found.std(ddof=1) / len(found) ** 0.5 if part and len(found) > 1 else 0.0
        if found.mean() - 2 * error >= wanted:
            return probes
    return len(centroids)
