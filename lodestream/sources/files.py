"""Folders of files as a DataFrame: scanned by Spark's own listing, filtered by path and size, read and extracted in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import extension, file_fingerprint, file_name, relative_path
from lodestream.sources import formats

#: Bytes of a file that is still read.
MOST_BYTES = 64 << 20
#: Files that are read by name; their names come to the driver.
LISTED = 10_000
_DOCUMENT = "markdown string, title string, tags array<string>, links array<string>, warnings array<string>"


def path_pattern(pattern: str) -> str:
    """A pattern of paths as a regular expression: * and ? stay within a name, **/ is any folders or none, a last ** is all below."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?s)^" + "".join(parts.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", pattern) if p) + "$"


def scan(spark: SparkSession, root: str, *, extensions: list[str] | None = None, without_folders: list[str] = (), without_names: list[str] = (), without_paths: list[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files below root: path (below root), name, kind (extension), size, modified, fingerprint, status, message, url.

    Folders that begin with a dot or are left out by name, names like those left out (SQL's % and _), and paths that fit a pattern
    (* for anything in a name, ** for any folders, ? for one character) are not listed;
    a file that is too large is listed with the status 'error' and why. Spark lists no empty files. Contents are not read (no column of them is).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    clean = F.regexp_replace("path", r"^\w+:/+", "/")
    base = "/" + root.split(":", 1)[-1].lstrip("/") if "://" in root or root.startswith("file:") else root
    named = files.select(relative_path(clean, base).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("path").alias("url"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    named = named.withColumn("name", file_name(F.col("path"))).withColumn("kind", extension(F.col("path")))
    kept = named.filter(~F.exists(folders, lambda f: f.startswith(".") | f.isin(list(without_folders) or [""])) & ~F.col("name").startswith("."))
    for pattern in without_names:
        kept = kept.filter(~F.col("name").like(pattern))
    for pattern in without_paths:
        kept = kept.filter(~F.col("path").rlike(path_pattern(pattern)))
    if extensions is not None:
        kept = kept.filter(F.col("kind").isin([e.lower() for e in extensions]))
    large = F.col("size") > most_bytes
    status = F.when(large, "error").otherwise("ready")
    message = F.when(large, F.concat(F.lit("larger than "), F.lit(str(most_bytes)), F.lit(" bytes"))).otherwise("")
    return kept.withColumn("fingerprint", file_fingerprint(F.col("size"), F.col("modified"))).withColumn("status", status).withColumn("message", message)


def _contents(ready: DataFrame, root: str) -> DataFrame:
    """url and content of the ready files. Up to LISTED of them are read by name and nothing else is; more, as on a first run, by a scan of the folder."""
    spark = ready.sparkSession
    urls = [r[0] for r in ready.select("url").limit(LISTED + 1).collect()]
    reader = spark.read.format("binaryFile")
    if not urls:
        return spark.createDataFrame([], "url string, content binary")
    if len(urls) <= LISTED:
        found = reader.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", u) for u in urls])
    else:
        found = reader.option("recursiveFileLookup", "true").load(root)
    return found.select(F.col("path").alias("url"), "content")


def documents(scanned: DataFrame, root: str) -> DataFrame:
    """The scanned files that are ready with their document, status and message: a file that cannot be read as its format is read as text, with a warning."""
    ready = scanned.filter("status = 'ready'").drop("status", "message")
    read = ready.join(_contents(ready, root), "url").select("path", "name", "kind", "size", "modified", "fingerprint", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("name", "kind", "content")}
            found = [formats.extract(*x) for x in zip(*(batch.column(at[n]).to_pylist() for n in ("name", "kind", "content")))]
            strings = pa.list_(pa.string())
            columns = [pa.array([d.markdown for d in found], pa.string()), pa.array([d.title for d in found], pa.string()), pa.array([d.tags for d in found], strings), pa.array([d.links for d in found], strings), pa.array([d.warnings for d in found], strings)]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "content"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *columns], names=[*[batch.schema.names[i] for i in kept], "markdown", "title", "tags", "links", "warnings"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "content")
    out = read.mapInArrow(run, f"{schema}, {_DOCUMENT}")
    status = F.when(F.col("markdown").isNull(), "error").when(F.trim("markdown") == "", "empty").otherwise("synced")
    return out.withColumn("status", status).withColumn("message", F.array_join("warnings", "; "))


def read_lines(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """One JSON object per line; fields that are missing or of another type are null, or their default; lines that are no object are kept in _corrupt."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(value).cast(rows.schema[name].dataType)))
    return rows


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def log_text(logs: DataFrame, *, time: str = "ts", level: str = "level", category: str = "category", message: str = "message") -> DataFrame:
    """Logs as lines of text (value), in the order of time: what a text sink writes."""
    line = F.concat_ws(" ", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.concat(F.lit("["), F.upper(level), F.lit("]")), F.concat(F.col(category), F.lit(":")), F.regexp_replace(message, r"\s*\n\s*", " "))
    return logs.orderBy(time, level, category, message).select(line.alias("value"))
