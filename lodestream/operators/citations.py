"""Which of an answer's sources it names, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import mentions


def cited(sources: DataFrame, *, answer: str = "answer", name: str = "name", heading: str | None = None, least: int = 3, least_heading: int = 4) -> DataFrame:
    """sources with cited: whether the answer names the source, or the heading of its passage."""
    found = mentions(F.col(answer), F.col(name), least)
    if heading:
        found = found | mentions(F.col(answer), F.col(heading), least_heading)
    return sources.withColumn("cited", found)


def ordered(marked: DataFrame, *, key: list[str], score: str = "score", tie: str = "name") -> DataFrame:
    """Each answer's sources once, the best score of each; cited ones first if there are any, then by score."""
    once = marked.withColumn("__turn", F.row_number().over(Window.partitionBy(*key, tie).orderBy(F.col("cited").desc(), F.col(score).desc()))).filter("__turn = 1").drop("__turn")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("cited").desc(), F.col(score).desc(), tie)))
