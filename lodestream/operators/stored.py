"""Tables in buckets under one folder, replaced bucket by bucket, with a version marker that moves last.

A table's rows carry the column `bucket` (0 up to a fixed number). Writing puts the touched buckets' new rows into a
folder of the next version and leaves all other buckets' files where they are; the marker, one small JSON file per
version that names the folder of every bucket, is written when all rows are. A run that is killed before leaves the old
version in force, and its half-written folder is never read. Readers name the buckets that they need, so nothing else is listed.

    root/<table>/v=<version>/bucket=<bucket>/[more partitions/]*.parquet
    root/_versions/<version>.json

The marker is bounded by tables times buckets, whatever the rows. Two writers of the same version meet at the marker's
creation, which only one of them is granted.

Defined cases: a folder without a marker holds no tables; a bucket that loses all rows loses its entry; an empty table reads
as no rows of its schema; null keys are in a bucket like others (the hash of null).
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import remove


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    """One version of the tables; a writer's changes are seen by others, and by a new Store, after commit()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version, state = self._last()
        self.tables: dict[str, dict[int, int]] = {t: {int(b): v for b, v in bs.items()} for t, bs in state.get("tables", {}).items()}
        self.schemas: dict[str, str] = state.get("schemas", {})
        self.info: dict = state.get("info", {})

    # -- files, by Hadoop's interface, so in whatever store the folder lies

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _system(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, dict]:
        system, folder = self._system(), self._path(f"{self.root}/_versions")
        if not system.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        versions = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not versions:
            return 0, {}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/_versions/{versions[-1]}.json").collect())  # one small file
        return versions[-1], json.loads(text)

    # -- reading

    def __contains__(self, table: str) -> bool:
        return table in self.tables

    def buckets(self, table: str) -> list[int]:
        return sorted(self.tables.get(table, {}))

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets; other buckets' folders are not even listed."""
        held = self.tables[table]
        chosen = sorted(held if buckets is None else set(buckets) & set(held))
        paths = [f"{self.root}/{table}/v={held[b]}/bucket={b}" for b in chosen]
        schema = self.schemas[table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*names)

    # -- writing

    def write(self, table: str, rows: DataFrame, touched: Iterable[int] | None = None, within: tuple[str, ...] = ()) -> None:
        """Put rows in place of the touched buckets, or of the whole table; once per table and version. within: columns that split a bucket's folder further.

        rows holds all that the touched buckets will hold. It may read the present version: nothing of it is overwritten.
        """
        at = self.version + 1
        folder = f"{self.root}/{table}/v={at}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket", *within).parquet(folder)
        held = self.tables.get(table, {})
        kept = {} if touched is None else {b: v for b, v in held.items() if b not in set(touched)}
        system = self._system()
        listed = [s.getPath().getName() for s in system.listStatus(self._path(folder))]
        self.tables[table] = kept | {int(n[7:]): at for n in listed if n.startswith("bucket=")}
        self.schemas[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def replace(self, table: str, fresh: DataFrame, touched: DataFrame, keys: list[str]) -> None:
        """Rows of touched keys go, fresh rows come; only the buckets of touched keys (bucket, *keys) are read and written.

        A table that is not there yet is made of the fresh rows.
        """
        if table not in self.tables:
            self.write(table, fresh.repartition("bucket"))
            return
        buckets = {r[0] for r in touched.select("bucket").distinct().collect()}  # bounded by the number of buckets
        if not buckets:
            return
        held = self.read(table, buckets)
        stays = held.join(touched.select(*keys).distinct(), keys, "left_anti").select(*held.columns)
        self.write(table, stays.unionByName(fresh).repartition("bucket"), buckets)

    def commit(self) -> int:
        """Move the marker: from now on this version is read."""
        at = self.version + 1
        text = json.dumps({"tables": self.tables, "schemas": self.schemas, "info": self.info}, sort_keys=True)
        system, place = self._system(), self._path(f"{self.root}/_versions/{at}.json")
        draft = self._path(f"{self.root}/_versions/.{at}-{id(self)}.tmp")
        out = system.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if system.exists(place) or not system.rename(draft, place):
            system.delete(draft, False)
            raise RuntimeError(f"version {at} of {self.root} was written by another run")
        self.version = at
        return at

    def compact(self, table: str, bytes_a_file: int = 128 << 20) -> list[int]:
        """Rewrite the buckets whose files are many and small, each into files of about this size; sizes are known from the listing.

        Gives the buckets that were rewritten.
        """
        system, small = self._system(), []
        for b, v in self.tables[table].items():
            files, size = 0, 0
            listing = system.listFiles(self._path(f"{self.root}/{table}/v={v}/bucket={b}"), True)
            while listing.hasNext():
                status = listing.next()
                if status.getPath().getName().endswith(".parquet"):
                    files, size = files + 1, size + status.getLen()
            if files > max(1, -(-size // bytes_a_file)):
                small.append((b, max(1, -(-size // bytes_a_file))))
        if small:
            parts = [self.read(table, [b]).coalesce(n) for b, n in small]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            self.write(table, rows, [b for b, _ in small])
        return [b for b, _ in small]

    def vacuum(self) -> list[str]:
        """Delete folders and markers that the version in force does not use; readers of older versions lose theirs."""
        system, gone = self._system(), []
        for table, held in self.tables.items():
            used = {f"v={v}/bucket={b}" for b, v in held.items()}
            for version in system.listStatus(self._path(f"{self.root}/{table}")):
                name = version.getPath().getName()
                if not name.startswith("v="):
                    continue
                for bucket in system.listStatus(version.getPath()):
                    inner = f"{name}/{bucket.getPath().getName()}"
                    if bucket.getPath().getName().startswith("bucket=") and inner not in used:
                        remove(self.spark, f"{self.root}/{table}/{inner}")
                        gone.append(f"{table}/{inner}")
        for marker in system.listStatus(self._path(f"{self.root}/_versions")):
            if marker.getPath().getName() != f"{self.version}.json":
                remove(self.spark, f"{self.root}/_versions/{marker.getPath().getName()}")
        return gone
