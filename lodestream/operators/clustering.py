"""Spherical k-means over a whole table: assignment and partial sums in tasks, centroids by broadcast each round.

Every round sends the centroids to the tasks; each task assigns its vectors and gives, per cell, a count, a sum, the cost
(one minus the cosine, summed) and the vector that is farthest from its centroid. These partial rows, at most tasks times cells, are added up
by cell, and one row per cell comes back. A cell that is left empty moves onto the farthest vector of the costliest cell,
so the cost never rises. More than ONE_LEVEL cells are made in two levels: first their root, then each of these is
cut in proportion to its vectors, so a vector is compared with two times the root of the cells and not with all of them.

Defined cases: nulls, vectors of another dimension or with null entries, and zero vectors are in no cell (-1); of equal similarities the lowest
cell wins; repeated rows count as often as they are there; with fewer distinct vectors than cells some cells stay empty and are left out;
an empty table gives no cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.vectors import matrix_of, unit_rows

#: Cells that are trained at once; more are made in two levels.
ONE_LEVEL = 256
#: Rounds at most, and the share by which the cost has to fall for another one.
ROUNDS, GAIN = 25, 1e-3
#: Similarities that a task holds at a time.
HELD = 4_000_000

_SUMS = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("sum", pa.list_(pa.float64())), ("cost", pa.float64()), ("far", pa.list_(pa.float64())), ("least", pa.float64())])
_SUMS_DDL = "cell int, n long, sum array<double>, cost double, far array<double>, least double"


@dataclass
class Cells:
    """Centroids in two levels: cell c belongs to group group[c]; groups[g] is what a vector is compared with first."""

    groups: np.ndarray
    centroids: np.ndarray
    group: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1] if self.centroids.ndim == 2 else 0

    def __len__(self) -> int:
        return len(self.centroids)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit row, and its similarity to the centroid."""
        cell, near = np.full(len(rows), -1, np.int32), np.full(len(rows), -2.0)
        step = max(1, HELD // max(1, len(self.groups), np.bincount(self.group).max() if len(self.group) else 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            first = (part @ self.groups.T).argmax(1) if len(self.groups) > 1 else np.zeros(len(part), np.int64)
            for g in np.unique(first).tolist():
                mine, own = np.flatnonzero(first == g), np.flatnonzero(self.group == g)
                if len(own):
                    scores = part[mine] @ self.centroids[own].T
                    best = scores.argmax(1)
                    cell[at + mine], near[at + mine] = own[best], scores[np.arange(len(mine)), best]
        return cell, near


def one_level(centroids: np.ndarray) -> Cells:
    return Cells(np.zeros((1, centroids.shape[1] if centroids.ndim == 2 else 0)), centroids, np.zeros(len(centroids), np.int64))


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """id and vector of the rows that have a direction in so many dimensions."""
    fits = F.col("vector").isNotNull() & (F.size("vector") == dim) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull())
    return vectors.filter(fits).select(F.col("id").cast("long").alias("id"), "vector")


def _by_cell(cells: np.ndarray, rows: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for c in np.unique(cells[cells >= 0]).tolist():
        inside = cells == c
        yield c, rows[inside], near[inside]


def _sums(sent, dim: int):
    def run(batches):
        own = sent.value
        total, count, cost = np.zeros((len(own), dim)), np.zeros(len(own), np.int64), np.zeros(len(own))
        far, least = np.zeros((len(own), dim)), np.full(len(own), 2.0)
        for batch in batches:
            rows = unit_rows(matrix_of(batch.column(1), dim))
            cells, near = own.nearest(rows)
            for c, inside, similar in _by_cell(cells, rows, near):
                total[c] += inside.sum(0)
                count[c] += len(inside)
                cost[c] += (1 - similar).sum()
                at = similar.argmin()
                if similar[at] < least[c]:
                    least[c], far[c] = similar[at], inside[at]
        some = np.flatnonzero(count)
        columns = (some.astype(np.int32), count[some], list(total[some]), cost[some], list(far[some]), least[some])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS)], schema=_SUMS)

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The partial rows of one cell as one."""
    least = rows.column("least").to_numpy()
    at = int(least.argmin())
    total = np.array(rows.column("sum").to_pylist()).sum(0)
    values = (rows.column("cell")[0].as_py(), int(rows.column("n").to_numpy().sum()), total, float(rows.column("cost").to_numpy().sum()), rows.column("far")[at].as_py(), float(least[at]))
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SUMS)], schema=_SUMS)


def measure(points: DataFrame, cells: Cells) -> dict[int, tuple]:
    """Per filled cell: n, sum, cost, the farthest vector and its similarity; one row per cell comes to the driver."""
    sent = points.sparkSession.sparkContext.broadcast(cells)
    partial = points.mapInArrow(_sums(sent, cells.dim), _SUMS_DDL)
    return {r[0]: (r[1], np.array(r[2]), r[3], np.array(r[4]), r[5]) for r in partial.groupBy("cell").applyInArrow(_added, _SUMS_DDL).collect()}


def _seeds(points: DataFrame, cells: Cells, wanted: np.ndarray, seed: int) -> list[np.ndarray]:
    """For each group of cells the first vectors by a hash of their identifiers, as many as wanted."""
    sent = points.sparkSession.sparkContext.broadcast((cells, wanted))
    schema = pa.schema([("cell", pa.int32()), ("turn", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def first(batches):
        own, wanted = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows, turn = unit_rows(matrix_of(batch.column(0), own.dim)), batch.column(1).to_numpy()
            found, _ = own.nearest(rows)
            for c in np.unique(found[found >= 0]).tolist():
                inside = np.flatnonzero(found == c)
                before = held.get(c, (np.zeros(0, np.int64), np.zeros((0, own.dim))))
                turns, kept = np.concatenate([before[0], turn[inside]]), np.concatenate([before[1], rows[inside]])
                order = np.argsort(turns, kind="stable")[: wanted[c]]
                held[c] = turns[order], kept[order]
        for c, (turns, kept) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(turns), c, np.int32)), pa.array(turns), pa.array(list(kept), schema.field(2).type)], schema=schema)

    def merged(rows: pa.Table) -> pa.Table:
        return rows.sort_by("turn").slice(0, int(sent.value[1][rows.column("cell")[0].as_py()]))

    ddl = "cell int, turn long, vector array<double>"
    chosen = points.select("vector", F.xxhash64("id", F.lit(seed)).alias("turn")).mapInArrow(first, ddl).groupBy("cell").applyInArrow(merged, ddl)
    found = chosen.orderBy("cell", "turn").collect()  # at most the wanted cells
    return [np.array([r[2] for r in found if r[0] == c]).reshape(-1, cells.dim) for c in range(len(cells))]


def _settle(points: DataFrame, cells: Cells, rounds: int, costs: list[float]) -> Cells:
    """Rounds of k-means from these centroids, until the cost stands still; cells stay in their groups."""
    for _ in range(rounds):
        found = measure(points, cells)
        costs.append(sum(f[2] for f in found.values()))
        centre = cells.centroids.copy()
        for c, (_, total, *_) in found.items():
            if np.linalg.norm(total) > 1e-12:
                centre[c] = total / np.linalg.norm(total)
        empty = [c for c in range(len(cells)) if c not in found]
        # costliest first, within the empty cell's own group
        costly = sorted(((f[2], c) for c, f in found.items() if f[0] > 1 and f[2] > 1e-9), reverse=True)
        for c in empty:
            at = next((i for i, (_, o) in enumerate(costly) if cells.group[o] == cells.group[c]), None)
            if at is not None:
                centre[c] = found[costly.pop(at)[1]][3]
        cells = Cells(cells.groups, centre, cells.group)
        if not costs[-1] or not empty and len(costs) > 1 and costs[-2] - costs[-1] <= GAIN * costs[-1]:
            break
    return cells


def train(vectors: DataFrame, cells: int, dim: int, *, rounds: int = ROUNDS, seed: int = 0, costs: list[list[float]] | None = None) -> Cells:
    """Cells of vectors(id, vector), fitted on all of them; costs gets each level's costs by round."""
    points, costs = usable(vectors, dim), [] if costs is None else costs
    start = one_level(np.eye(1, dim))
    top = cells if cells <= ONE_LEVEL else int(np.ceil(cells**0.5))
    seeds = np.unique(_seeds(points, start, np.array([top]), seed)[0], axis=0)
    if not len(seeds):
        return one_level(np.zeros((0, dim)))
    costs.append([])
    found = _settle(points, one_level(seeds), rounds, costs[-1])
    if cells <= ONE_LEVEL:
        return found
    held = measure(points, found)
    all_ = sum(f[0] for f in held.values())
    wanted = np.array([max(1, round(cells * held[c][0] / all_)) if c in held else 1 for c in range(len(found))])
    parts = [np.unique(s, axis=0) for s in _seeds(points, found, wanted, seed + 1)]
    parts = [s if len(s) else found.centroids[c : c + 1] for c, s in enumerate(parts)]
    split = Cells(found.centroids, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(s) for s in parts]))
    costs.append([])
    return _settle(points, split, rounds, costs[-1])
