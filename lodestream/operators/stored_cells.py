"""An inverted file that is kept: vectors in folders by cell, centroids beside them, read by the cells that a query probes.

The vectors' buckets are the cells of k-means over the whole table (clustering.py); -1 holds what has no direction. Beside each centroid
stands the least similarity of its vectors to it, which bounds how similar to a query any vector of the cell can be: with the
angles a to the centroid and r of the cell's rim no vector is nearer to the query than a - r. top() probes each query's nearest
cells and reads their folders alone; with exact=True a second pass reads the cells whose bound still reaches the k-th
best similarity, so the result is that of a scan of all vectors, whatever the cells.

Before an index is used, ensure() asks whether the table has outgrown it, and trains and writes it anew only then.
Upkeep writes the touched cells alone.

Defined cases: vectors that are null, of another dimension or zero are kept and never found; an empty table has no cells and
gives an empty result; repeated identifiers are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.vectors import unit_rows
from lodestream.operators import clustering, vector_search
from lodestream.operators.clustering import Cells
from lodestream.operators.stored import Store

#: Vectors of one file of a cell; a crowded cell is written by several tasks.
ROWS_A_FILE = 1 << 18


class VectorIndex:
    """The index under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._cells: tuple[Cells, np.ndarray] | None = None

    @property
    def built_over(self) -> int | None:
        """Vectors of the table when the cells were made."""
        return self.store.info.get("built_over")

    @property
    def dim(self) -> int:
        return self.store.info["dim"]

    def cells(self) -> tuple[Cells, np.ndarray]:
        """The centroids, and each cell's least similarity of a vector to its centroid; as many rows as cells come to the driver."""
        if self._cells is None:
            rows = self.store.read("centroids").orderBy("cell").collect()
            matrix = np.array([r["vector"] for r in rows], np.float64).reshape(-1, self.dim)
            tops = {r["group"]: r["top"] for r in rows}
            groups = np.array([tops.get(g) or [0.0] * self.dim for g in range(max(tops, default=0) + 1)], np.float64)
            self._cells = Cells(groups, matrix, np.array([r["group"] for r in rows], np.int64)), np.array([r["least"] for r in rows], np.float64)
        return self._cells

    def _assigned(self, vectors: DataFrame, cells: Cells) -> DataFrame:
        """vectors(id, vector) to (bucket, id, vector, near)."""
        sent, dim = self.spark.sparkContext.broadcast(cells), self.dim

        def run(batches):
            for batch in batches:
                values = batch.column(1).to_pylist()
                bucket, near = np.full(len(values), -1, np.int32), np.zeros(len(values))
                fit = [i for i, v in enumerate(values) if v is not None and len(v) == dim and None not in v and any(v)]
                if fit:
                    bucket[fit], near[fit] = sent.value.nearest(unit_rows(np.array([values[i] for i in fit], np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns, pa.array(near)], names=["bucket", "id", "vector", "near"])

        source = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        return source.mapInArrow(run, "bucket int, id long, vector array<float>, near double")

    def _put_centroids(self, cells: Cells, least: np.ndarray) -> None:
        rows = [(0, c, int(cells.group[c]), cells.groups[cells.group[c]].tolist(), cells.centroids[c].tolist(), float(least[c])) for c in range(len(cells))]
        self.store.write("centroids", self.spark.createDataFrame(rows, "bucket int, cell int, group int, top array<double>, vector array<double>, least double").coalesce(1))
        self._cells = cells, least

    def build(self, vectors: DataFrame, dim: int, *, cells: int | None = None, probes: int | None = None) -> None:
        """Train on vectors(id, vector) and write them by cell."""
        n = vectors.count()
        trained = clustering.train(vectors, cells or vector_search.cells_for(n), dim)
        held = clustering.measure(clustering.usable(vectors, dim), trained) if len(trained) else {}
        filled = sorted(held)  # cells without a vector are left out
        trained = Cells(trained.groups, trained.centroids[filled], trained.group[filled])
        least = np.array([held[c][4] for c in filled])
        self.store.info |= {"built_over": n, "dim": dim, "probes": probes or max(1, len(filled) // 8)}
        files = {i: -(-held[c][0] // ROWS_A_FILE) for i, c in enumerate(filled) if held[c][0] > ROWS_A_FILE}
        assigned = self._assigned(vectors, trained)
        spread = F.lit(0)
        for c, parts in files.items():  # crowded cells alone
            spread = F.when(F.col("bucket") == c, F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(spread)
        self.store.write("vectors", assigned.withColumn("spread", spread).repartition("bucket", "spread").select("bucket", "id", "vector"))
        self._put_centroids(trained, least)
        self.store.commit()

    def ensure(self, vectors: DataFrame, dim: int, **how) -> bool:
        """Build if there is no index yet or the table has outgrown it; whether it was built."""
        if not vector_search.outgrown(vectors.count(), self.built_over):
            return False
        self.build(vectors, dim, **how)
        return True

    def choose_probes(self, sample: DataFrame, k: int, *, wanted: float = 0.9) -> int:
        """Keep the fewest probes whose recall at k, measured on the vectors of sample(id, vector) as queries against an exact search, is at least wanted."""
        cells, _ = self.cells()
        asked = sample.select(F.col("id").alias("query_id"), "vector")
        self.store.info["probes"] = vector_search.probes_for(self.vectors(), asked, cells.centroids, k, wanted=wanted)
        self.store.commit()
        return self.store.info["probes"]

    def refresh(self, fresh: DataFrame, gone: DataFrame) -> list[int]:
        """Vectors of fresh(id, vector) come in place of what they were, those of gone(id) go, cells stay; the cells written anew."""
        cells, least = self.cells()
        new = self._assigned(fresh, cells)
        ids = fresh.select(F.col("id").cast("long").alias("id")).unionByName(gone.select(F.col("id").cast("long").alias("id"))).distinct()
        old = self.store.read("vectors").select("bucket", "id").join(ids, "id")  # the column of identifiers alone
        touched = old.select("bucket", "id").unionByName(new.select("bucket", "id"))
        buckets = sorted({r[0] for r in touched.select("bucket").distinct().collect()})  # at most the cells
        if not buckets:
            return []
        self.store.replace("vectors", new.select("bucket", "id", "vector"), touched, ["id"])
        for r in new.filter("bucket >= 0").groupBy("bucket").agg(F.min("near")).collect():  # at most the cells
            least[r[0]] = min(least[r[0]], r[1])
        self._put_centroids(cells, least)
        self.store.commit()
        return buckets

    def vectors(self, cells: Iterable[int] | None = None) -> DataFrame:
        """id, vector, cell of the rows of some cells: only their files are read."""
        return self.store.read("vectors", cells).select("id", "vector", F.col("bucket").alias("cell"))

    def _search(self, queries: DataFrame, k: int, chosen) -> DataFrame:
        """The top k of each query within the cells that chosen(ids, matrix) gives as a matrix of queries by cells."""
        union: set[int] = set()
        for ids, matrix in vector_search._query_blocks(queries.filter(F.size("vector") == self.dim), self.dim):
            union |= set(np.flatnonzero(chosen(ids, matrix).any(0)).tolist())
        return vector_search._best_of(self.vectors(union), queries, k, self.dim, chosen)

    def top(self, queries: DataFrame, k: int, *, probes: int | None = None, exact: bool = False) -> DataFrame:
        """queries(query_id, vector) to (query_id, id, score, rank), from each query's nearest cells, or as a scan of all cells gives it."""
        if "vectors" not in self.store:
            return vector_search.ranked(self.spark.createDataFrame([], vector_search.FOUND), k)
        cells, least = self.cells()
        probes = min(len(cells), probes or self.store.info["probes"])

        def nearest(ids: list, matrix: np.ndarray) -> np.ndarray:
            meets = np.zeros((len(matrix), len(cells)), bool)
            if probes:
                np.put_along_axis(meets, np.argsort(-(matrix @ cells.centroids.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            return meets

        first = self._search(queries, k, nearest)
        if not exact:
            return first
        kth = {r[0]: (r[1], r[2]) for r in first.groupBy("query_id").agg(F.count("*"), F.min("score")).collect()}  # a row per query, as many as are broadcast anyway
        rim = np.arccos(np.clip(least, -1, 1))

        def reaching(ids: list, matrix: np.ndarray) -> np.ndarray:
            angle = np.arccos(np.clip(matrix @ cells.centroids.T, -1, 1))
            bound = np.cos(np.maximum(0, angle - rim))
            wanted = np.array([kth[q][1] if q in kth and kth[q][0] == k else -2.0 for q in ids])
            return (bound >= wanted[:, None] - 1e-6) & ~nearest(ids, matrix)

        return vector_search.ranked(first.select("query_id", "id", "score").unionByName(self._search(queries, k, reaching).select("query_id", "id", "score")), k)
