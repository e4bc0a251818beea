"""Per-session working sets kept item by item, with their vectors, and queries answered from them where they can be.

Events of a session are hits (an item with its score and vector), touches (an item without a score), queries (a vector), and
clears. The state is a map from item to its best score, last turn and vector, so a micro-batch writes the items that it
changes and no others, and one value for the session's project and turn. Entries go after `keep` without an update, and a session
that is idle for `idle` is cleared by a timer.

Each micro-batch of a session is a turn. Hits come first in it, then queries: a query is covered if at least `enough` held vectors
reach `floor`, or one reaches floor + margin (cosine, rounded to six digits). Rows of the kind "query" that are not covered need the
full search: searches() has them alone.

Defined cases: another project than the held one clears the set first; a null item is no hit; a touch of an item that isn't held is nothing; a null or zero vector, and vectors of another length, are
similar to nothing (0); of equal items' hits in a turn the greatest score counts and the last vector; eviction keeps the capacity
best by score, then turn, then the smaller item; a query of an empty set has best null and is not covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HIT, TOUCH, QUERY, CLEAR = "hit", "touch", "query", "clear"
#: The events' columns.
EVENTS = "session string, kind string, project string, item long, score double, query_id long, vector array<double>"
#: Rows of the kind "item" are the set after the turn, by place; those of the kind "query" are answers.
OUTPUT = "session string, kind string, turn int, place int, item long, best double, last_turn int, query_id long, strong long, covered boolean"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def similarities(query: np.ndarray, held: list) -> np.ndarray:
    """Cosines of a query and the held vectors, 0 where there is none to speak of."""
    out = np.zeros(len(held))
    size = np.linalg.norm(query)
    for i, v in enumerate(held):
        if v is not None and len(v) == len(query) and size > 0 and (own := np.linalg.norm(v)) > 0:
            out[i] = np.dot(query, v) / size / own
    return np.round(out, 6)


class SessionItems(StatefulProcessor):
    def __init__(self, capacity: int, floor: float, enough: int, margin: float, keep_ms: int | None, idle_ms: int | None):
        self.capacity, self.floor, self.enough, self.margin = capacity, floor, enough, margin
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "item long", "best double, turn int, vector array<double>", self.keep_ms)
        self.session = handle.getValueState("session", "project string, turn int")

    def _all(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.held.iterator()}

    def _event(self, row, held: dict[int, tuple], changed: set[int], turn: int) -> None:
        if pd.isna(row.item):
            return
        item = int(row.item)
        if row.kind == TOUCH:
            if item in held:
                held[item] = (held[item][0], turn, held[item][2])
                changed.add(item)
        elif not pd.isna(row.score):
            vector = [float(x) for x in row.vector] if row.vector is not None else held.get(item, (0, 0, None))[2]
            held[item] = (max(float(row.score), held[item][0]) if item in held else float(row.score), turn, vector)
            changed.add(item)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        project, turn = tuple(self.session.get()) if self.session.exists() else (None, 0)
        turn, stored = turn + 1, self._all()
        held, changed, queries = dict(stored), set(), []
        for row in pd.concat(list(rows)).itertuples(index=False):
            mine = None if pd.isna(row.project) else row.project
            if row.kind == QUERY:
                queries.append(row)
                continue
            if row.kind == CLEAR or mine != project:
                held, changed, project = {}, set(), mine
            if row.kind != CLEAR:
                self._event(row, held, changed, turn)
        order = sorted(held, key=lambda i: (-held[i][0], -held[i][1], i))
        kept = order[: self.capacity]
        for item in stored.keys() - set(kept):
            self.held.removeKey((item,))
        for item in changed & set(kept):
            self.held.updateValue((item,), held[item])
        self.session.update((project, turn))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out = [(key[0], "item", turn, place, item, held[item][0], held[item][1], None, None, None) for place, item in enumerate(kept, 1)]
        for q in queries:
            near = similarities(np.array([] if q.vector is None else q.vector, np.float64), [held[i][2] for i in kept])
            strong = int((near >= self.floor).sum())
            best = float(near.max()) if len(near) else None
            covered = strong >= self.enough or best is not None and best >= self.floor + self.margin
            out.append((key[0], "query", turn, None, None, best, None, q.query_id, strong, covered))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"place": "Int32", "item": "Int64", "last_turn": "Int32", "query_id": "Int64", "strong": "Int64", "covered": "boolean", "best": "Float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.session.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, *, capacity: int, floor: float = 0.35, enough: int = 2, margin: float = 0.1, keep_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """events(EVENTS) to OUTPUT, in append mode. The session needs the RocksDB state store."""
    processor = SessionItems(capacity, floor, enough, margin, keep_ms, idle_ms)
    mode = "ProcessingTime" if keep_ms is not None or idle_ms is not None else "None"
    return events.groupBy("session").transformWithStateInPandas(processor, OUTPUT, "Append", mode)


def searches(answered: DataFrame) -> DataFrame:
    """session and query_id of the queries that the sets don't cover."""
    return answered.filter((F.col("kind") == "query") & ~F.col("covered")).select("session", "query_id")
