"""Tables whose rows were written under several versions of their schema, read as the newest.

Rows lie in folders schema=<version>. A step takes a DataFrame from one version's columns to the next one's; steps are
expressions over rows, so each folder is read with its own columns and filters still reach its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]


def write_version(rows: DataFrame, root: str, version: int, mode: str = "append") -> None:
    rows.write.mode(mode).parquet(f"{root.rstrip('/')}/schema={version}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that a folder has rows of."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(int(n[7:]) for n in names if n.startswith("schema=") and n[7:].isdigit())


def read_newest(spark: SparkSession, root: str, steps: list[Step]) -> DataFrame:
    """All rows with the columns of version len(steps); steps[v] goes from version v to v + 1.

    Rows of a newer version than this code knows are refused; a folder without rows has no columns to read and is refused, too.
    """
    newest, found = len(steps), versions(spark, root)
    if not found:
        raise ValueError(f"no version of a table in {root}")
    if found[-1] > newest:
        raise ValueError(f"{root} was written by version {found[-1]}, this is version {newest}")
    out = None
    for v in found:
        rows = spark.read.parquet(f"{root.rstrip('/')}/schema={v}")
        for step in steps[v:]:
            rows = step(rows)
        out = rows if out is None else out.unionByName(rows)
    return out


def migrate(spark: SparkSession, root: str, target: str, steps: list[Step]) -> None:
    """Rewrite all rows under the newest version in another folder."""
    write_version(read_newest(spark, root, steps), target, len(steps), "overwrite")
