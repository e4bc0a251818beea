"""Session-wide helpers: shipping the package to executors, the shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Let executors import this package: the driver serves one zip of it per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestream_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, target = tempfile.mkstemp(prefix="lodestream-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    sc.addPyFile(target)
    sc._lodestream_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one, if all executors are on this machine."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if set_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(set_dir)
        return set_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="lodestream-checkpoint-")
    sc.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has gone, and with it the way to the store
        remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it is deleted when this Python process ends in good order."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
