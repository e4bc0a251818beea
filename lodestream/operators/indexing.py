"""Indexing a folder: scan, find what changed, extract and chunk that alone, and bring states and passages up to date.

refreshed() gives the next states and passages as DataFrames. bring_up_to_date() keeps them in a store of buckets by path
(stored.py): the folder's listing is taken once, the due files are read once and by name, their documents are fixed before
states and passages are made of them, so both tell of the same contents; only the touched buckets are written, and both
tables change together when the marker moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import chunking, incremental
from lodestream.operators.stored import Store, bucket_of
from lodestream.session import cut
from lodestream.sources import files

#: Buckets of a kept folder's tables.
BUCKETS = 64

STATES = "path string, fingerprint string, parameters string, size long, modified timestamp, status string, message string, title string, tags array<string>, links array<string>, passages long"
PASSAGES = "path string, ordinal int, headings string, text string, tokens long, indexed string"


def refreshed(spark: SparkSession, root: str, states: DataFrame | None = None, passages: DataFrame | None = None, *, budget: int = 400, overlap: int = 50, force: bool = False, **scan) -> tuple[DataFrame, DataFrame]:
    """The states and passages of a folder's files after a run; the stored ones are those of the run before.

    A file is read again if its size or time, or the parameters of chunking, are others than those that are stored. Files that
    are too large have the status error and no passages, as have those that cannot be read.
    """
    states = spark.createDataFrame([], STATES) if states is None else states
    passages = spark.createDataFrame([], PASSAGES) if passages is None else passages
    scanned = files.scan(spark, root, **scan).withColumn("parameters", F.lit(chunking.parameters(budget, overlap)))
    found = incremental.changes(scanned, states, keys=["path"], version=["fingerprint", "parameters"], force=force)
    touched = found.filter(F.col("status") != incremental.SAME).select("path")
    due = scanned.join(touched, "path", "left_semi")
    now, fresh = _made(due, files.documents(due, root), budget, overlap)
    return incremental.replaced(states, now, touched, ["path"]), incremental.replaced(passages, fresh, touched, ["path"])


def _made(due: DataFrame, read: DataFrame, budget: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """States and passages of due files, of which read has the documents."""
    made = chunking.chunks(read.select(F.col("path").alias("id"), F.col("markdown").alias("text")), budget=budget, overlap=overlap).withColumnRenamed("id", "path")
    titled = made.join(read.select("path", "title"), "path")
    fresh = chunking.with_context(titled, F.col("title")).select("path", "ordinal", "headings", "text", "tokens", "indexed")
    counted = fresh.groupBy("path").agg(F.count("*").alias("passages"))
    known = read.select("path", "status", "message", "title", "tags", "links").join(counted, "path", "left")
    failed = due.filter("status = 'error'").select("path", "status", "message", F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("links"), F.lit(0).cast("long").alias("passages"))
    outcome = known.withColumn("passages", F.coalesce("passages", F.lit(0)).cast("long")).unionByName(failed)
    now = due.select("path", "fingerprint", "parameters", "size", "modified").join(outcome, "path")
    return now, fresh


def bring_up_to_date(spark: SparkSession, root: str, kept: str, *, budget: int = 400, overlap: int = 50, force: bool = False, only: DataFrame | None = None, buckets: int = BUCKETS, **scan) -> dict[str, int]:
    """Index the files below root into the store at kept (tables states and passages); files by what became of them.

    only(path) confines the run to some paths, as a change feed names them; a path among them that is not there any more goes.
    A file that goes or changes between the listing and its reading is left as it was, and is due again at the next run. If nothing is due nothing is written.
    """
    store = Store(spark, kept)
    buckets = store.info.setdefault("buckets", buckets)
    scanned = files.scan(spark, root, **scan).withColumn("parameters", F.lit(chunking.parameters(budget, overlap)))
    prior = store.read("states").select("path", "fingerprint", "parameters") if "states" in store else spark.createDataFrame([], "path string, fingerprint string, parameters string")
    if only is not None:
        scanned, prior = scanned.join(only.select("path").distinct(), "path", "left_semi"), prior.join(only.select("path").distinct(), "path", "left_semi")
    scanned = cut(scanned)
    found = cut(incremental.changes(scanned, prior, keys=["path"], version=["fingerprint", "parameters"], force=force))
    counts = {r[0]: r[1] for r in found.groupBy("status").count().collect()}  # four rows at most
    if set(counts) <= {incremental.SAME}:
        return counts
    due = scanned.join(found.filter(F.col("status").isin(incremental.NEW, incremental.CHANGED)), "path", "left_semi")
    read = cut(files.documents(due, root))
    seen = read.select("path").unionByName(due.filter("status = 'error'").select("path"))
    touched = cut(seen.unionByName(found.filter(F.col("status") == incremental.GONE).select("path")).withColumn("bucket", bucket_of(buckets, "path")))
    now, fresh = _made(due.join(touched, "path", "left_semi"), read, budget, overlap)
    placed = lambda df: df.withColumn("bucket", bucket_of(buckets, "path"))
    store.replace("states", placed(now), touched, ["path"])
    store.replace("passages", placed(fresh), touched, ["path"])
    store.commit()
    return counts
