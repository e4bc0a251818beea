"""Kept folders, the change feed, containment, schema versions, embedding by strides, session state by item."""

import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import embedding, indexing, matching, schemas, vector_search
from lodestream.operators.stored import Store
from lodestream.sources import files
from lodestream.streaming import feed, sessions


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- kept folders ------------------------------------------------------------------


def states(spark, kept):
    return {r.path: (r.status, r.passages) for r in Store(spark, kept).read("states").collect()}


def test_one_changed_file_is_read_and_one_bucket_written(spark, tmp_path, monkeypatch):
    root, kept = tmp_path / "in", str(tmp_path / "kept")
    root.mkdir()
    for i in range(60):
        (root / f"f{i} [x]{{y}}%20.txt").write_text(f"words of {i}")
    (root / "big.txt").write_text("y" * 900)
    assert indexing.bring_up_to_date(spark, str(root), kept, most_bytes=500, buckets=16) == {"new": 61}
    assert len(states(spark, kept)) == 61 and states(spark, kept)["big.txt"] == ("error", 0)
    assert indexing.bring_up_to_date(spark, str(root), kept, most_bytes=500) == {"same": 61} and Store(spark, kept).version == 1
    (root / "f7 [x]{y}%20.txt").write_text("other words here")
    read = []
    contents = files._contents
    monkeypatch.setattr(files, "_contents", lambda ready, folder: read.append(contents(ready, folder)) or read[-1])
    before = Store(spark, kept).tables
    assert indexing.bring_up_to_date(spark, str(root), kept, most_bytes=500) == {"same": 60, "changed": 1}
    assert len(read) == 1 and len(read[0].inputFiles()) == 1
    after = Store(spark, kept).tables
    for t in ("states", "passages"):
        assert sum(before[t].get(b) != v for b, v in after[t].items()) == 1
    passages = {r.path: r.text for r in Store(spark, kept).read("passages").collect()}
    assert passages["f7 [x]{y}%20.txt"] == "other words here" and passages["f8 [x]{y}%20.txt"] == "words of 8" and len(passages) == 60
    os.remove(root / "f9 [x]{y}%20.txt")
    (root / "new.md").write_text("# H\nnew")
    assert indexing.bring_up_to_date(spark, str(root), kept, most_bytes=500) == {"same": 60, "gone": 1, "new": 1}
    assert "f9 [x]{y}%20.txt" not in states(spark, kept) and states(spark, kept)["new.md"] == ("synced", 1)
    # confined to some paths, nothing else is looked at
    (root / "new.md").unlink()
    (root / "f1 [x]{y}%20.txt").unlink()
    only = spark.createDataFrame([("new.md",), ("never.txt",)], "path string")
    assert indexing.bring_up_to_date(spark, str(root), kept, only=only, most_bytes=500) == {"gone": 1}
    assert "new.md" not in states(spark, kept) and "f1 [x]{y}%20.txt" in states(spark, kept)


# -- the change feed ---------------------------------------------------------------


def test_differences():
    old, new = {"a": [1, 2], "b": [1, 2], "c": [1, 2]}, {"a": (1, 2), "b": (9, 2), "d": (0, 5)}
    assert feed.differences(old, new) == [("b", "changed", 9, 2), ("c", "gone", 1, 2), ("d", "new", 0, 5)]
    assert feed.differences({}, {}) == [] and feed.listing("/nowhere/at/all") == {}


def test_new_changed_and_gone_files_arrive_once_and_after_a_restart(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    seen = []

    def run(change):
        stream = feed.folder_changes(spark, str(root), str(tmp_path / "listings"))
        query = stream.writeStream.foreachBatch(lambda b, n: seen.extend((r.path, r.kind, r.size) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
            change()
            query.processAllAvailable()
        finally:
            query.stop()
        out = sorted(seen)
        seen.clear()
        return out

    (root / "a.txt").write_text("a")
    (root / ".hidden").write_text("h")
    assert run(lambda: (root / "sub" / "b.txt").write_text("bb")) == [("a.txt", "new", 1), ("sub/b.txt", "new", 2)]
    # while no query runs
    (root / "a.txt").write_text("aaa")
    (root / "empty.txt").write_text("")
    assert run(lambda: (root / "sub" / "b.txt").unlink()) == [("a.txt", "changed", 3), ("empty.txt", "new", 0), ("sub/b.txt", "gone", 2)]
    assert run(lambda: None) == []


def test_the_feed_keeps_an_index(spark, tmp_path):
    root, kept = tmp_path / "in", str(tmp_path / "kept")
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("two")
    step = feed.keep_indexed(str(root), kept, buckets=8)

    def run():
        query = feed.folder_changes(spark, str(root), str(tmp_path / "l")).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return {r.path: r.text for r in Store(spark, kept).read("passages").collect()}

    assert run() == {"a.txt": "one", "b.txt": "two"}
    (root / "b.txt").unlink()
    (root / "c.txt").write_text("three")
    assert run() == {"a.txt": "one", "c.txt": "three"}
    version = Store(spark, kept).version
    step(spark.createDataFrame([("b.txt",), ("c.txt",)], "path string"), 1)  # the batch again
    assert Store(spark, kept).version == version


# -- containment -------------------------------------------------------------------


@pytest.mark.parametrize("chars", [1_000_000, 6])
def test_contained_equals_a_search_for_each_pattern(spark, monkeypatch, chars):
    monkeypatch.setattr(matching, "BLOCK_CHARS", chars)
    random_ = random.Random(1)
    word = lambda n: "".join(random_.choice("abé") for _ in range(n))
    texts = [(i, word(random_.randint(0, 12))) for i in range(80)] + [(3, None), (4, "")]
    patterns = [(word(random_.randint(1, 4)), random_.randint(0, 30)) for _ in range(25)] + [(None, 0), ("zz", 1), ("aa", 7), ("aa", 3)]
    least = {}
    for p, place in patterns:
        if p is not None:
            least[p] = min(place, least.get(p, place))
    expected = sorted((i, min(found), len(found)) for i, t in texts if t is not None and (found := [place for p, place in least.items() if p in t]))
    frames = spark.createDataFrame([(*t, "x", 1) for t in texts], "id long, text string, pattern string, row int").repartition(3), spark.createDataFrame(patterns, "pattern string, place int")
    assert rows_of(matching.contained(*frames)) == sorted(expected, key=repr)
    assert matching.contained(frames[0], frames[1].limit(0)).count() == 0
    every = matching.contained(frames[0], spark.createDataFrame([("", 5)], "pattern string, place int"))
    assert every.count() == 81 and {(r["first"], r.matches) for r in every.collect()} == {(5, 1)}


# -- schema versions -----------------------------------------------------------------


def test_three_versions_read_as_the_newest(spark, tmp_path):
    root = str(tmp_path / "t")
    steps = [lambda df: df.withColumnRenamed("txt", "text"), lambda df: df.withColumn("size", F.length("text"))]
    schemas.write_version(spark.createDataFrame([(1, "a")], "id long, txt string"), root, 0)
    schemas.write_version(spark.createDataFrame([(2, "bb")], "id long, text string"), root, 1)
    schemas.write_version(spark.createDataFrame([(3, "ccc", 30)], "id long, text string, size int"), root, 2)
    rows = schemas.read_newest(spark, root, steps)
    assert rows_of(rows.select("id", "text", "size")) == [(1, "a", 1), (2, "bb", 2), (3, "ccc", 30)]
    assert rows.filter("id = 1")._jdf.queryExecution().executedPlan().toString().count("EqualTo(id,1)") >= 3  # the filter reaches every folder
    schemas.migrate(spark, root, str(tmp_path / "n"), steps)
    assert schemas.versions(spark, str(tmp_path / "n")) == [2] and schemas.read_newest(spark, str(tmp_path / "n"), steps).count() == 3
    with pytest.raises(ValueError):
        schemas.read_newest(spark, root, steps[:1])
    with pytest.raises(ValueError):
        schemas.read_newest(spark, str(tmp_path / "none"), steps)


# -- embedding by strides ----------------------------------------------------------------


def test_embedding_goes_on_after_a_failure(spark, tmp_path):
    log = str(tmp_path / "log")

    def embedder(texts, broken=False):
        if broken and any(int(t) % 7 == 0 for t in texts) and os.path.exists(log) and len(open(log).read().split()) > 20:
            raise OSError("away")
        with open(log, "a") as out:
            out.write("".join(f"{t} " for t in texts))
        return [[float(t), 1.0] for t in texts]

    passages = spark.createDataFrame([(i, str(i)) for i in range(60)], "id long, text string")
    root = str(tmp_path / "kept")
    with pytest.raises(Exception, match="away"):
        embedding.keep_completed(Store(spark, root), passages, lambda t: embedder(t, True), model="m", buckets=16, buckets_a_stride=2, tries=1, batch=4)
    stored = Store(spark, root)
    done = {r.id for r in stored.read("vectors").collect()}
    assert 0 < len(done) < 60 and stored.version >= 1
    open(log, "w").close()
    assert embedding.keep_completed(Store(spark, root), passages, embedder, model="m", buckets=16, buckets_a_stride=2, batch=4) > 0
    again = {int(x) for x in open(log).read().split()}
    assert again == set(range(60)) - done
    assert {r.id: r.vector for r in Store(spark, root).read("vectors").collect()} == {i: [float(i), 1.0] for i in range(60)}
    assert embedding.keep_completed(Store(spark, root), passages, embedder, model="m") == 0


# -- session state by item -----------------------------------------------------------------


def simulate(batches, capacity, floor, enough, margin):
    """The same rules over plain dictionaries."""
    state, out = {}, []
    for batch in batches:
        for s in sorted({r[0] for r in batch}):
            project, turn, held = state.get(s, (None, 0, {}))
            turn, held, queries = turn + 1, dict(held), []
            for _, kind, p, item, score, q, v in [r for r in batch if r[0] == s]:
                if kind == "query":
                    queries.append((q, v))
                    continue
                if kind == "clear" or p != project:
                    held, project = {}, p
                if kind == "clear" or item is None:
                    continue
                if kind == "touch":
                    if item in held:
                        held[item] = (held[item][0], turn, held[item][2])
                elif score is not None:
                    old = held.get(item)
                    held[item] = (max(score, old[0]) if old else score, turn, v if v is not None else old[2] if old else None)
            kept = sorted(held, key=lambda i: (-held[i][0], -held[i][1], i))[:capacity]
            held = {i: held[i] for i in kept}
            out += [(s, "item", turn, n, i, held[i][0], held[i][1], None, None, None) for n, i in enumerate(kept, 1)]
            for q, v in queries:
                near = sessions.similarities(np.array(v), [held[i][2] for i in kept])
                strong = int((near >= floor).sum())
                best = float(near.max()) if len(near) else None
                out.append((s, "query", turn, None, None, best, None, q, strong, strong >= enough or best is not None and best >= floor + margin))
            state[s] = (project, turn, held)
    return sorted(out, key=repr)


def test_session_items(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    random_ = random.Random(5)
    vector = lambda: [random_.gauss(0, 1) for _ in range(4)]
    batches = []
    for _ in range(4):
        batch = []
        for s in ("a", "b", "c"):
            for _ in range(random_.randint(0, 7)):
                kind = random_.choices(["hit", "touch", "clear"], [8, 3, 1])[0]
                batch.append((s, kind, random_.choices(["p", "q", None], [12, 1, 1])[0], random_.choice([None, *range(9)]), random_.choice([None, 0.5, 0.7, random_.random()]), None, random_.choice([None, vector()])))
            batch.append((s, "query", None, None, None, random_.randint(0, 99), vector()))
        batches.append(batch)
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, sessions.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        part = next((tmp_path / f"w{k}").glob("*.parquet"))
        shutil.move(part, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    answered = sessions.session_stream(stream, capacity=4, floor=0.3)
    query = answered.writeStream.format("memory").queryName("session_items").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    expected = simulate(batches, 4, 0.3, 2, 0.1)
    assert rows_of(spark.table("session_items")) == expected
    assert rows_of(sessions.searches(spark.table("session_items"))) == sorted((r[0], r[7]) for r in expected if r[1] == "query" and not r[9])


# -- coverage and many queries ---------------------------------------------------------------


def test_coverage_and_many_queries_in_blocks(spark, monkeypatch):
    random_ = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, random_.normal(size=8).tolist()) for i in range(120)] + [(500, None)], "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, random_.normal(size=8).tolist()) for i in range(50)] + [(70, None), (71, [1.0])], "query_id long, vector array<double>")
    every = {}
    for r in vector_search.top_k(vectors, asked, 1000, 8).collect():
        every.setdefault(r.query_id, []).append(r.score)
    expected = sorted((q, max(s), sum(x >= 0.4 for x in s)) for q, s in every.items())
    few = rows_of(vector_search.top_k(vectors, asked, 7, 8))
    for most in (8192, 9):
        monkeypatch.setattr(vector_search, "MOST_QUERIES", most)
        assert rows_of(vector_search.coverage(vectors, asked, 8, 0.4)) == sorted(expected, key=repr)
        assert rows_of(vector_search.top_k(vectors, asked, 7, 8)) == few


# -- search in one call ----------------------------------------------------------------


def test_search_composes_variants_reranking_and_neighbours(spark):
    from lodestream.operators import hybrid, search

    words = ["river", "bridge", "train", "town", "mayor", "flood", "boat", "rain"]
    random_ = random.Random(8)
    rows = [(i, f"f{i // 4}", i % 4, " ".join(random_.choice(words) for _ in range(5)), [random_.gauss(0, 1) for _ in range(4)]) for i in range(24)] + [(50, None, 0, "river lonely", None)]
    passages = spark.createDataFrame(rows, "id long, group string, ordinal int, text string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(1, "river boat", [1.0, 0.0, 0.0, 0.0]), (2, "lonely", None), (3, None, None)], "query_id long, text string, vector array<double>")
    texts, ids = {r[0]: r[3] for r in rows}, {(r[1], r[2]): r[0] for r in rows}

    def expander(text):
        if "lonely" in text:
            raise OSError("away")
        return ["flood rain", "mayor"] if text else []

    variants = spark.createDataFrame([(100, "river boat", [1.0, 0.0, 0.0, 0.0]), (101, "flood rain", None), (102, "mayor", None), (200, "lonely", None)], "query_id long, text string, vector array<double>")
    best = {}
    for r in hybrid.retrieve(passages, variants, k=6, dim=4).collect():
        key = (r.query_id // 100, r.id)
        best[key] = max(best.get(key, 0), r.score)
    expected = {}
    for q in (1, 2):
        order = sorted((i for n, i in best if n == q), key=lambda i: (-best[q, i], i))[:6]
        order = [order[2], order[0], order[1], *order[3:]] if q == 1 else order
        for place, i in enumerate(order):
            group, ordinal = next((r[1], r[2]) for r in rows if r[0] == i)
            near = [ids[group, o] for o in range(ordinal - 1, ordinal + 2) if (group, o) in ids] if group else [i]
            expected[q, place] = (i, round(best[q, i], 9), "\n\n".join(texts[n] for n in near))
    out = search.search(passages, asked, k=6, expander=expander, reranker=lambda query, found: "3, 1, 2" if query == "river boat" else "", window=3, dim=4)
    assert {(r.query_id, r.place): (r.id, round(r.score, 9), r.context) for r in out.collect()} == expected
    plain = search.search(passages, asked, k=6, dim=4).collect()
    assert {r.query_id for r in plain} == {1, 2} and all(r.context for r in plain)
