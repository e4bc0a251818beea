"""Streams against their batch forms, over files that arrive one by one."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestream.operators import incremental, rollups
from lodestream.streaming import stateful


def arriving(spark, folder, schema, batches):
    """A stream that reads each batch of rows as one micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"{k:03}"))
    paths = sorted(folder.glob("*/*.parquet"))
    flat = folder / "flat"
    flat.mkdir()
    for k, p in enumerate(paths):
        target = flat / f"{k:03}.parquet"
        p.rename(target)
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def drained(spark, stream, tmp_path, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.table(name)


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_debounced_stream_equals_the_batch(spark, tmp_path):
    schema = "path string, ts timestamp, kind string"
    batches = [[("a", at(0), "x"), ("b", at(0.2), "x"), ("a", at(0.4), "y")], [("a", at(0.8), "z"), ("b", at(3), "w")], [("c", at(500), "end")], [("c", at(1000), "end")]]
    out = drained(spark, stateful.debounced(arriving(spark, tmp_path, schema, batches), "600 milliseconds", key="path", time="ts", late="1 second"), tmp_path, "append", "debounced")
    found = sorted((r.path, r.ts, r.kind) for r in out.collect())
    frame = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = sorted((r.path, r.ts, r.kind) for r in rollups.debounced(frame, "600 milliseconds", ["path"], "ts").collect())
    assert [r for r in batch if r[0] != "c"] == [r for r in found if r[0] != "c"] == [("a", at(0.8), "z"), ("b", at(0.2), "x"), ("b", at(3), "w")]


def test_working_sets(spark, tmp_path):
    schema = "session long, project string, item long, score double"
    batches = [[(1, "p", 10, 0.5), (1, "p", 11, 0.9), (2, "q", 10, 0.1)], [(1, "p", 12, 0.5), (1, "p", 10, 0.2)], [(1, "p", 10, None), (1, "p", 13, 0.4)], [(2, "r", 20, 0.3)], [(1, "p", None, None)]]
    out = drained(spark, stateful.working_sets(arriving(spark, tmp_path, schema, batches), 3), tmp_path, "update", "sets").collect()
    by = {}
    for r in out:
        by.setdefault((r.session, r.turn if r.session == 2 else None), []).append((r.item, r.best, r.turn, r.place))
    sessions = [(r.session, r.item, r.best, r.turn, r.place) for r in out]
    assert sessions.count((1, 11, 0.9, 1, 1)) == 3  # best of three micro-batches
    assert (1, 10, 0.5, 3, 2) in sessions and (1, 12, 0.5, 2, 3) in sessions  # a touch is the latest turn
    assert not any(r[1] == 13 for r in sessions)  # the fourth of three
    assert (2, 20, 0.3, 2, 1) in sessions and sessions.count((2, 10, 0.1, 1, 1)) == 1  # another project clears the set


def test_changed_values(spark, tmp_path):
    schema = "key long, ts timestamp, value string"
    batches = [[(1, at(0), "a"), (1, at(1), "a"), (2, at(0), None)], [(1, at(2), "a"), (1, at(3), "b"), (2, at(1), None), (2, at(2), "x")]]
    out = drained(spark, stateful.changed_values(arriving(spark, tmp_path, schema, batches), key="key", time="ts", value="value"), tmp_path, "append", "changed")
    found = sorted((r.key, r.ts) for r in out.collect())
    frame = spark.createDataFrame([r for b in batches for r in b], schema)
    assert found == sorted((r.key, r.ts) for r in rollups.without_repeats(frame, ["key"], ["ts"], "value").collect()) == [(1, at(0)), (1, at(3)), (2, at(0)), (2, at(2))]


def test_upkeep_merges_micro_batches(spark, tmp_path):
    schema = "path string, text string"
    versions = {-1: spark.createDataFrame([("a", "old"), ("b", "old")], schema)}
    paths = []

    def read():
        return spark.read.schema(schema).parquet(paths[-1]) if paths else versions[-1]

    def write(df, number):
        paths.append(str(tmp_path / f"v{number}"))
        df.write.mode("overwrite").parquet(paths[-1])

    def merge(stored, batch):
        return incremental.replaced(stored, batch.filter("text is not null"), batch, ["path"])

    stream = arriving(spark, tmp_path, schema, [[("a", "new")], [("b", None), ("c", "new")]])
    query = stream.writeStream.foreachBatch(stateful.upkeep(read, write, merge)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(map(tuple, read().collect())) == [("a", "new"), ("c", "new")]


@pytest.mark.parametrize("force, told", [(False, {"a": "same", "b": "changed", "c": "gone", "d": "new"}), (True, {"a": "changed", "b": "changed", "c": "gone", "d": "new"})])
def test_changes(spark, force, told):
    now = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("d", 1, "x")], "path string, size long, extra string")
    then = spark.createDataFrame([("a", 9, None, 1), ("a", 1, None, 2), ("b", 2, "y", 1), ("c", 1, "x", 1)], "path string, size long, extra string, stored_at int")
    assert {r.path: r.status for r in incremental.changes(now, then, keys=["path"], version=["size", "extra"], force=force).collect()} == told
    assert incremental.compacted(now, 2).rdd.getNumPartitions() == 2
    order = F.col("stored_at")
    assert {r.path: r.stored_at for r in incremental.latest(then, ["path"], order).collect()} == {"a": 2, "b": 1, "c": 1}
