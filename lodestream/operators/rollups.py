"""Rollups over logs, samples and working sets, as windows over keys.

Windows are partitioned by their key. Where only a key's last rows count, they are first kept by parts of the key, so that a key with most
of the rows meets in one task as a few of them; running windows (rolling, history, shares) do gather a key's rows in one task, which sorts and
spills them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a key whose last rows are found apart.
PARTS = 64
LEVELS = ["debug", "info", "warning", "error"]


def at_least(level: Column, least: str) -> Column:
    """Whether a log level reaches another one; unknown levels do not."""
    order = F.array(*map(F.lit, LEVELS))
    return F.array_position(order, F.lower(level)) >= LEVELS.index(least) + 1


def last_of(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n last rows of a table (a ring buffer's content), last first: a distributed top-n, no sort of all rows."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def last_of_each(rows: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """The n last rows of each key: of each of PARTS parts of it, then of those that are left."""
    last = [F.col(c).desc() for c in order]
    out = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    for by in ([*key, "__part"], key):
        out = out.withColumn("__turn", F.row_number().over(Window.partitionBy(*by).orderBy(*last))).filter(F.col("__turn") <= n).drop("__turn")
    return out.drop("__part")


def rolling(rows: DataFrame, n: int, key: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the mean and the maximum of the last n values, itself included, and the change since the one before."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    last = ordered.rowsBetween(-(n - 1), Window.currentRow)
    return rows.withColumn("mean", F.avg(value).over(last)).withColumn("most", F.max(value).over(last)).withColumn("change", F.col(value) - F.lag(value).over(ordered))


def history(rows: DataFrame, n: int, key: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the last n values of its key, itself included, oldest first; nulls are left out."""
    last = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)
    return rows.withColumn("history", F.collect_list(value).over(last))


def share_of_change(rows: DataFrame, key: list[str], order: list[str | Column], part: str, whole: str) -> DataFrame:
    """Each row with share: by how much a running counter grew since the key's row before, as a share of another's growth, between 0 and 1.

    Null for a key's first row; 0 where the whole did not grow, as after a counter was set back.
    """
    before = Window.partitionBy(*key).orderBy(*order)
    grown = F.col(whole) - F.lag(whole).over(before)
    share = F.when(grown <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(part) - F.lag(part).over(before)) / grown)))
    return rows.withColumn("share", F.when(grown.isNotNull(), share))


def last_changes(rows: DataFrame, n: int, key: list[str], order: list[str], value: str) -> DataFrame:
    """Of each key's changes of value the n last."""
    return last_of_each(without_repeats(rows, key, order, value), n, key, order)


def without_repeats(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the one before of the same key (nulls are values)."""
    before = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("__first", F.row_number().over(before) == 1).withColumn("__before", F.lag(value).over(before))
    return marked.filter(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__first", "__before")


def debounced(events: DataFrame, gap: str, key: list[str], time: str) -> DataFrame:
    """The last event of each burst of a key: those that no event of the key follows within the gap. The batch form of the stream's debounce."""
    later = F.lead(time).over(Window.partitionBy(*key).orderBy(time))
    return events.withColumn("__later", later).filter(F.col("__later").isNull() | (F.col("__later") > F.col(time) + F.expr(f"interval {gap}"))).drop("__later")


def working_set(hits: DataFrame, capacity: int, *, session: str = "session", item: str = "item", score: str = "score", turn: str = "turn") -> DataFrame:
    """Per session its items with their best score and last turn, the capacity best of them: by score, then recency, then item."""
    kept = hits.groupBy(session, item).agg(F.max(score).alias("best"), F.max(turn).alias("last_turn"))
    place = Window.partitionBy(session).orderBy(F.col("best").desc(), F.col("last_turn").desc(), F.col(item).asc_nulls_last())
    return kept.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= capacity)


def coverage(similarities: DataFrame, threshold: float, *, enough: int = 2, margin: float = 0.1, key: str = "query_id", score: str = "score") -> DataFrame:
    """Per query the best similarity, how many reach the threshold, and whether they answer it without a search."""
    out = similarities.groupBy(key).agg(F.max(score).alias("best"), F.count_if(F.col(score) >= threshold).alias("strong"))
    return out.withColumn("covered", (F.col("strong") >= enough) | (F.col("best") >= threshold + margin))


def footprint(files: DataFrame, kinds: dict[str, str], *, path: str = "path", size: str = "size") -> DataFrame:
    """Bytes by kind, a kind being the first whose pattern the path matches, else 'other'; with each one's share."""
    kind = F.lit("other")
    for name, pattern in reversed(kinds.items()):
        kind = F.when(F.col(path).rlike(pattern), F.lit(name)).otherwise(kind)
    by = files.groupBy(kind.alias("kind")).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))
    return by.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy()), 6))  # a few kinds
