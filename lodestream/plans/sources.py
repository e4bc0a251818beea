"""Queries of formats over the test tables: pages as Markdown, tables through CSV."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.plans.retrieval import table
from lodestream.registry import register
from lodestream.sources import formats


def _extracted(source: DataFrame, kind: str) -> DataFrame:
    """source(id, text) to (id, markdown, title, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [formats.extract("", kind, (t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.markdown for d in found], pa.string()), pa.array([d.title for d in found], pa.string()), pa.array([d.links for d in found], pa.list_(pa.string()))], names=["id", "markdown", "title", "links"])

    return source.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, markdown string, title string, links array<string>")


@register(
    "page_outlines",
    r"""SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS headings, len(regexp_extract_all(html, '<li[ >]')) AS items,
    list_sort(list_distinct([x FOR x IN regexp_extract_all(html, '<a href="([^"]*)"', 1) IF x <> ''])) AS links, contains(html, '<title>') AS titled FROM pages""",
)
def page_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages' Markdown keeps: headings, list items and links."""
    pages = _extracted(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), "html")
    return pages.select(
        F.col("id").alias("page_id"),
        F.size(F.regexp_extract_all("markdown", F.lit("(?m)^# "), F.lit(0))).cast("long").alias("headings"),
        F.size(F.regexp_extract_all("markdown", F.lit(r"(?m)^\s*- "), F.lit(0))).cast("long").alias("items"),
        F.array_sort("links").alias("links"),
        (F.col("title") != "").alias("titled"),
    )


@register("page_markdown")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as Markdown; held against fixtures in the tests."""
    return _extracted(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), "html")


@register("tables_from_csv", """SELECT n_regionkey AS id, '| key | name | "comment" |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | a "quoted", word |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def tables_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations, written as CSV with quotes and commas, as a Markdown table."""
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_name"), F.lit(',"a ""quoted"", word"'))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), "n_nationkey", line.alias("line"))
    whole = rows.groupBy("id").agg(F.concat(F.lit('key,name,"""comment"""\n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    return _extracted(whole, "csv").select("id", "markdown")
