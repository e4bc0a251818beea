"""A stream of what becomes of a folder's files: new, changed and gone, each once, also after a restart.

The source lists the folder whenever Spark asks for the latest offset. An offset names a listing, which is kept beside the query's
checkpoint under a digest of its contents; a micro-batch's rows are the differences between its two listings, so they
are the same when the batch is run again. The listing is metadata alone and is made where Spark makes its own, on the driver; a listing that equals the one before is no
new offset. Files are told apart by path, size and time of change.

Defined cases: a folder that is not there, or is empty, has an empty listing, so all its files are gone; files and folders whose names begin
with a dot or an underscore don't count; a file that comes and goes between two listings is never seen; an unfinished copy
is seen as it is, and again as changed when it has grown.
"""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestream.operators import indexing
from lodestream.operators.incremental import CHANGED, GONE, NEW

#: Rows of one partition of a micro-batch.
ROWS_A_TASK = 10_000
SCHEMA = "path string, kind string, size long, modified timestamp"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(root: str) -> dict[str, tuple[int, int]]:
    """Size and time of change (nanoseconds) of every file below root, by its path below root."""
    system, folder = _place(root)
    folder = folder.rstrip("/")
    found = {}
    for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        path = info.path[len(folder) + 1 :]
        if info.type == fs.FileType.File and not any(p[:1] in (".", "_") for p in path.split("/")):
            found[path] = (info.size, info.mtime_ns or 0)
    return found


def differences(old: dict, new: dict) -> list[tuple[str, str, int, int]]:
    """path, kind, size and time of every file that is not the same in both, in order of paths; a file that has gone with what it was."""
    out = [(p, CHANGED if p in old else NEW, *now) for p, now in new.items() if tuple(old.get(p, ())) != tuple(now)]
    return sorted(out + [(p, GONE, *was) for p, was in old.items() if p not in new])


class _Rows(InputPartition):
    def __init__(self, rows: list):
        super().__init__(None)
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, kept: str):
        self.root, self.kept = root, kept.rstrip("/")
        self.written: list[str] = []

    def _load(self, digest: str) -> dict:
        if not digest:
            return {}
        system, folder = _place(self.kept)
        with system.open_input_stream(f"{folder}/{digest}.json.gz", compression=None) as f:
            return json.loads(gzip.decompress(f.read()))

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        text = json.dumps(listing(self.root), sort_keys=True).encode()
        if text == b"{}":
            return {"listing": ""}
        digest = hashlib.sha256(text).hexdigest()
        if digest not in self.written[-1:]:
            system, folder = _place(self.kept)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{digest}.tmp", compression=None) as f:
                f.write(gzip.compress(text, mtime=0))
            system.move(f"{folder}/{digest}.tmp", f"{folder}/{digest}.json.gz")
            self.written.append(digest)
        return {"listing": digest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = differences(self._load(start["listing"]), self._load(end["listing"]))
        return [_Rows(rows[at : at + ROWS_A_TASK]) for at in range(0, len(rows), ROWS_A_TASK)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for path, kind, size, changed in partition.rows:
            yield path, kind, size, datetime.fromtimestamp(changed // 1000 / 1e6, timezone.utc)

    def commit(self, end: dict) -> None:
        """Listings of this run that came before are needed no more; one that came back since is kept."""
        if end["listing"] in self.written:
            at = len(self.written) - 1 - self.written[::-1].index(end["listing"])
            gone, self.written = set(self.written[:at]) - set(self.written[at:]), self.written[at:]
            system, folder = _place(self.kept)
            for digest in gone:
                system.delete_file(f"{folder}/{digest}.json.gz")

    def stop(self) -> None:
        pass


class FolderChanges(DataSource):
    """Options: path (the folder that is watched), listings (where listings are kept; shared and lasting like a checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options["listings"])


def folder_changes(spark: SparkSession, root: str, listings: str) -> DataFrame:
    """The stream of changes below root: path, kind (new, changed, gone), size, modified."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("listings", listings).load(root)


def keep_indexed(root: str, kept: str, **how) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that brings the store at kept up to date for the paths of each micro-batch; files that have gone go there, too.

    A batch that is run again finds its paths up to date and writes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        paths = batch.select("path").distinct()
        if not paths.isEmpty():
            indexing.bring_up_to_date(batch.sparkSession, root, kept, only=paths, **how)

    return step
