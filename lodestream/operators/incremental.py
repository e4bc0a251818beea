"""Incremental upkeep of an index: what changed since the last run, and stored tables brought up to date by it.

Tables are DataFrames; a new state is an anti-join with what goes and a union with what comes, so a run that
is lost half-way can be started again from the last written state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, CHANGED, SAME, GONE = "new", "changed", "same", "gone"


def changes(scanned: DataFrame, prior: DataFrame, *, keys: list[str], version: list[str], force: bool = False) -> DataFrame:
    """keys and status of every row that is in either: new, changed (any of version differs), same or gone.

    Of several prior rows with the same keys the last by stored_at counts, if there is such a column; nulls are values.
    """
    if "stored_at" in prior.columns:
        prior = latest(prior, keys, F.col("stored_at"))
    left = scanned.select(*keys, F.struct(*version).alias("__now"), F.lit(True).alias("__here"))
    right = prior.select(*keys, F.struct(*version).alias("__then"), F.lit(True).alias("__known"))
    both = left.join(right, keys, "full")
    same = F.col("__now").eqNullSafe(F.col("__then")) & F.lit(not force)
    status = F.when(F.col("__here").isNull(), GONE).when(F.col("__known").isNull(), NEW).when(same, SAME).otherwise(CHANGED)
    return both.select(*keys, status.alias("status"))


def latest(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Of each key's rows the last by this order: the upsert rule."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc()))).filter("__turn = 1").drop("__turn")


def replaced(stored: DataFrame, fresh: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the rows of touched keys, and the fresh rows: a file's passages, postings or vectors are replaced as a whole."""
    return stored.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def pending(passages: DataFrame, vectors: DataFrame, model: str, *, key: str = "id") -> DataFrame:
    """Passages without a vector of this model."""
    return passages.join(vectors.filter(F.col("vector").isNotNull() & F.col("model").eqNullSafe(F.lit(model))).select(key), key, "left_anti")


def compacted(df: DataFrame, rows_a_file: int) -> DataFrame:
    """df in as many partitions as give files of about so many rows."""
    return df.repartition(max(1, -(-df.count() // rows_a_file)))


def issues(files: DataFrame) -> DataFrame:
    """Files with the status error or with a message, warnings too."""
    return files.filter((F.col("status") == "error") | (F.coalesce(F.trim("message"), F.lit("")) != ""))


def ignored(path: Column, folders: list[str], extensions: list[str]) -> Column:
    """Whether a change of this path is none of the index's: a left-out folder, another format, an editor's or download's temporary file."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    kind = F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1))
    return F.arrays_overlap(parts, F.array(*map(F.lit, folders))) | ~kind.isin(extensions) | name.endswith("~") | name.startswith(".") | name.contains(".tmp")
