"""A catalogue of models: which entry a configured name means, and in what state it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tag that a name without one stands for, as registries of container images and models have it.
DEFAULT_TAG = "latest"


def resolved(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """names(wanted) with name: the entry of catalog(name) of that name, else with or without the default tag, else the first with any tag; null for none."""
    plain = lambda c: F.regexp_replace(c, f":{DEFAULT_TAG}$", "")
    base = lambda c: F.regexp_extract(c, "^[^:]*", 0)
    both = names.withColumn("__base", base(F.col("wanted"))).join(catalog.select("name").withColumn("__base", base(F.col("name"))), "__base", "left")
    fit = F.when(F.col("name") == F.col("wanted"), 0).when(plain(F.col("name")) == plain(F.col("wanted")), 1).when(~F.col("wanted").contains(":") & F.col("name").startswith(F.concat("wanted", F.lit(":"))), 2)
    ranked = both.withColumn("__fit", fit).withColumn("__turn", F.row_number().over(Window.partitionBy("wanted").orderBy(F.col("__fit").asc_nulls_last(), "name")))
    return ranked.filter("__turn = 1").select("wanted", F.when(F.col("__fit").isNotNull(), F.col("name")).alias("name"))


def state(wanted: Column, online: Column, name: Column, loaded: Column) -> Column:
    """none, offline, missing, loaded or ready: what can be said of a configured model."""
    return F.when(wanted.isNull() | (F.trim(wanted) == ""), "none").when(~online, "offline").when(name.isNull(), "missing").when(F.coalesce(loaded, F.lit(False)), "loaded").otherwise("ready")


def first_by(catalog: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """Of each kind the entry that is greatest by these columns, ties by name."""
    order = Window.partitionBy(kind).orderBy(*[F.col(c).desc_nulls_last() for c in by], "name")
    return catalog.withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").drop("__turn")


def manifest_sizes(manifests: DataFrame) -> DataFrame:
    """manifests(name, body) to (name, bytes, layers): the sizes that an OCI image manifest gives for its configuration and layers, summed.

    A body that is no such JSON has 0 bytes and layers; sizes that are missing or negative count as 0.
    """
    read = F.from_json("body", "config struct<size: bigint>, layers array<struct<size: bigint>>")
    known = lambda size: F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    layers = F.coalesce(F.col("read.layers"), F.array())
    total = F.aggregate(layers, F.lit(0).cast("long"), lambda s, layer: s + known(layer["size"]))
    return manifests.withColumn("read", read).select("name", (total + known(F.col("read.config.size"))).alias("bytes"), F.size(layers).alias("layers"))
