"""Streams: debounced changes, a working set per session, and values that changed; each has a batch form in operators/."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounced(events: DataFrame, gap: str, *, key: str, time: str, late: str = "10 seconds") -> DataFrame:
    """The last event of each burst of a key, once the watermark has passed the gap: built-in session windows, no Python."""
    others = [c for c in events.columns if c not in (key, time)]
    value = F.max_by(F.struct(*others), F.col(time)) if others else F.lit(None)
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.max(time).alias(time), value.alias("__value"))
    return grouped.select(key, time, *[F.col(f"__value.{c}").alias(c) for c in others])


def working_sets(hits: DataFrame, capacity: int, *, idle: str | None = None) -> DataFrame:
    """hits(session, project, item, score) to each session's items after every micro-batch: session, project, item, best, turn, place.

    A micro-batch of a session is a turn. Items keep their best score and last turn; the capacity best stay (by score, recency,
    item). A score of null touches an item without a score of its own; another project, or an item of null, clears the set.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        project, turn, held = (state.get[0], state.get[1], dict(zip(state.get[2], zip(state.get[3], state.get[4])))) if state.exists else (None, 0, {})
        turn += 1
        for part in parts:
            for p, item, score in zip(part["project"], part["item"], part["score"]):
                if p != project or pd.isna(item):
                    project, held = p, {}
                if pd.isna(item):
                    continue
                best = held.get(int(item), (None, 0))[0]
                if pd.isna(score):
                    if best is not None:
                        held[int(item)] = (best, turn)
                else:
                    held[int(item)] = (float(score) if best is None else max(best, float(score)), turn)
        kept = sorted(held.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:capacity]
        state.update((project, turn, [i for i, _ in kept], [b for _, (b, _) in kept], [t for _, (_, t) in kept]))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"session": [key[0]] * len(kept), "project": [project] * len(kept), "item": [i for i, _ in kept], "best": [b for _, (b, _) in kept], "turn": [t for _, (_, t) in kept], "place": range(1, len(kept) + 1)})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return hits.groupBy("session").applyInPandasWithState(step, "session long, project string, item long, best double, turn int, place int", "project string, turn int, items array<long>, best array<double>, turns array<int>", "update", timeout)


def changed_values(events: DataFrame, *, key: str, time: str, value: str) -> DataFrame:
    """Events (key long, time timestamp, value string) whose value differs from the one before of the key."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        keep = []
        for now in rows[value]:
            now = None if pd.isna(now) else now
            keep.append(not seen or now != last)
            seen, last = True, now
        state.update((last,))
        yield rows[keep][[key, time, value]]

    return events.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} long, {time} timestamp, {value} string", "last string", "append", GroupStateTimeout.NoTimeout)


def upkeep(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the stored table, merged with a micro-batch of changes, written as the next version.

    write gets the batch's number, so a batch that is run again after a failure writes the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(merge(read(), batch), number)

    return step
