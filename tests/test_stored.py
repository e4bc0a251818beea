"""The versioned store and the kept indexes over it, against plain recomputation."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import clustering, stored_index, text_search, vector_search
from lodestream.operators.stored import Store, bucket_of
from lodestream.operators.stored_cells import VectorIndex

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").select(bucket_of(16, "id").alias("bucket"), "id", "text")


def files_of(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


# -- the store -------------------------------------------------------------------


def test_replacing_touches_only_its_buckets(spark, tmp_path):
    root = str(tmp_path)
    store = Store(spark, root)
    assert "t" not in store and store.version == 0
    store.write("t", table(spark, [(i, f"old {i}") for i in range(200)] + [(None, "none")]))
    assert store.commit() == 1
    before = files_of(root)
    store = Store(spark, root)
    touched = table(spark, [(3, None), (5, None)])
    store.replace("t", table(spark, [(3, "new 3")]), touched, ["id"])
    # nothing has changed for anybody else until the marker moves, and a run that dies here leaves it so
    assert rows_of(Store(spark, root).read("t").select("id", "text"))[-1] == (None, "none") and Store(spark, root).version == 1
    assert Store(spark, root).read("t").filter("text like 'new%'").count() == 0
    store.commit()
    after = Store(spark, root)
    expected = [(i, f"old {i}") for i in range(200) if i not in (3, 5)] + [(3, "new 3"), (None, "none")]
    assert rows_of(after.read("t").select("id", "text")) == sorted(expected, key=repr)
    assert before.items() <= files_of(root).items()
    moved = {b for b, v in after.tables["t"].items() if v == 2}
    assert moved == {r[0] for r in touched.select("bucket").collect()} and len(after.tables["t"]) == 16
    assert rows_of(after.read("t", [7]).select("bucket").distinct()) == [(7,)]


def test_a_run_that_died_is_written_over(spark, tmp_path):
    root = str(tmp_path)
    store = Store(spark, root)
    store.write("t", table(spark, [(i, "a") for i in range(50)]))
    store.commit()
    died = Store(spark, root)
    died.replace("t", table(spark, [(i, "lost") for i in range(50)]), table(spark, [(i, "") for i in range(50)]), ["id"])
    again = Store(spark, root)
    again.replace("t", table(spark, [(1, "kept")]), table(spark, [(1, "")]), ["id"])
    again.commit()
    assert rows_of(Store(spark, root).read("t").groupBy("text").count()) == [("a", 49), ("kept", 1)]
    with pytest.raises(RuntimeError):
        died.commit()
    assert Store(spark, root).version == 2


def test_a_bucket_may_lose_all_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", table(spark, [(1, "a"), (2, "b")]))
    store.commit()
    store.replace("t", table(spark, []), table(spark, [(1, ""), (2, "")]), ["id"])
    store.commit()
    assert store.buckets("t") == [] and store.read("t").count() == 0 and Store(spark, str(tmp_path)).read("t").columns == ["bucket", "id", "text"]


def test_compaction_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    store = Store(spark, root)
    store.write("t", table(spark, [(i, "x" * 50) for i in range(400)]).repartition(6))
    store.commit()
    expected, many = rows_of(store.read("t")), len(files_of(root))
    assert len(store.compact("t")) == 16
    store.commit()
    assert rows_of(Store(spark, root).read("t")) == expected
    assert Store(spark, root).compact("t") == []
    gone = store.vacuum()
    assert len(gone) == 16 and len(files_of(root)) == 16 < many and rows_of(Store(spark, root).read("t")) == expected


# -- the inverted index ------------------------------------------------------------


def test_varints_and_blocks():
    random = np.random.default_rng(1)
    values = np.concatenate([np.array([0, 1, 127, 128, 2**63, 2**64 - 1], np.uint64), random.integers(0, 2**40, 500).astype(np.uint64)])
    data, size = stored_index.to_varints(values)
    assert (stored_index.from_varints(data) == values).all() and size.sum() == len(data) and size[:5].tolist() == [1, 1, 1, 2, 10]
    ids = np.unique(np.concatenate([random.integers(-(2**63), 2**63 - 1, 300), np.array([-(2**63), 2**63 - 1, 0, 1, 2])]))
    counts, lengths = random.integers(1, 90, len(ids)), random.integers(1, 90_000, len(ids))
    first, most, least, starts, raw = stored_index.encode_blocks(ids, counts, lengths)
    raw = np.frombuffer(raw, np.uint8)
    back = [stored_index.decode_block(f, raw[a:b]) for f, a, b in zip(first.tolist(), starts, [*starts[1:], len(raw)])]
    for k, given in enumerate((ids, counts, lengths)):
        assert (np.concatenate([x[k] for x in back]) == given).all()
    assert most.tolist() == [x[1].max() for x in back] and least.tolist() == [x[2].min() for x in back]


def test_pruning_loses_no_row_and_decodes_less():
    random = np.random.default_rng(2)
    norm = lambda length: 0.25 + 0.75 * length / 50
    decoded = {}
    for prune in (True, False):
        best, decoded[prune] = stored_index.Best(3, 5), 0
        random = np.random.default_rng(2)
        for _ in range(6):
            lists = {}
            for t in range(8):
                ids = np.unique(random.integers(0, 20_000, 30 * 3**t if t < 6 else 200))
                made = stored_index.encode_blocks(ids, random.integers(1, 4 + 30 * (random.random(len(ids)) < 0.01)), random.integers(5, 300, len(ids)))
                lists[t] = stored_index._Postings(*made, 9.0 / 2**t, 1.2, norm)
            stored_index.rank_part(lists, [np.array([0, 3, 5]), np.array([5]), np.arange(8)], best, prune)
            decoded[prune] += sum(len(x.held) for x in lists.values())
        if prune:
            pruned = best
    assert all((a == b).all() for a, b in zip(pruned.scores, best.scores)) and all((a == b).all() for a, b in zip(pruned.ids, best.ids))
    assert decoded[True] < 0.8 * decoded[False]


def test_the_kept_index_ranks_as_the_texts_do(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    odd = spark.createDataFrame([(-5, "zebra Été"), (-4, None), (-3, ""), (None, "zebra")], "id long, text string")
    index = stored_index.Index(spark, str(tmp_path))
    assert index.top(queries, 5).count() == 0
    early = docs.filter("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, F.reverse("text")).otherwise(F.col("text"))).unionByName(odd)
    index.build(early, parts=16)
    found = stored_index.Index(spark, str(tmp_path)).top(queries.unionByName(spark.createDataFrame([(-1, "ZEBRA ete"), (-2, None)], "query_id long, text string")), 10)
    known = early.filter("id is not null")
    expected = text_search.bm25_top(known, queries.unionByName(spark.createDataFrame([(-1, "ZEBRA ete")], "query_id long, text string")), 10)
    assert rows_of(found) == rows_of(expected)
    before = files_of(tmp_path)
    one = spark.createDataFrame([(-5, "lion")], "id long, text string")
    assert len(stored_index.Index(spark, str(tmp_path)).refresh(one, one.limit(0))) == 1
    assert before.items() <= files_of(tmp_path).items() and len(files_of(tmp_path)) - len(before) <= 9
    index = stored_index.Index(spark, str(tmp_path))
    index.refresh(docs.filter("id % 5 = 0 or id % 7 = 0"), odd.select("id"))
    index = stored_index.Index(spark, str(tmp_path))
    assert rows_of(index.top(queries, 10)) == rows_of(text_search.bm25_top(docs, queries, 10))
    assert rows_of(index.top(queries, 3, prune=False)) == rows_of(index.top(queries, 3))
    plan = index.asked(["zebra"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    read = index.asked(["zebra"]).inputFiles()
    assert index.asked(["zebra"]).select("shard").distinct().count() <= 1 and read


# -- cells -------------------------------------------------------------------------


def blobs(n=600, dim=16, k=12, seed=3):
    random = np.random.default_rng(seed)
    centre = random.normal(size=(k, dim))
    return [(i, (centre[i % k] + 0.4 * random.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


ODD_VECTORS = [(9000, None), (9001, [1.0]), (9002, [0.0] * 16), (9003, [None] * 16)]


def vectors_of(spark, rows, parts=5):
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(parts)


def test_kmeans_equals_numpy_and_its_cost_falls(spark):
    rows = blobs()
    costs = []
    found = clustering.train(vectors_of(spark, rows + ODD_VECTORS), 10, 16, costs=costs)
    assert len(costs[0]) > 2 and all(b <= a + 1e-9 for a, b in zip(costs[0], costs[0][1:]))
    # the same rounds over one array, from the same seeds
    points = np.array([v for _, v in rows], np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    turns = [r[0] for r in spark.createDataFrame([(i,) for i, _ in rows], "id long").selectExpr("xxhash64(id, 0)").collect()]
    centre = np.unique(points[np.argsort(turns, kind="stable")[:10]], axis=0)
    for _ in range(len(costs[0])):
        near = (points @ centre.T).argmax(1)
        centre = np.array([points[near == c].sum(0) for c in range(10)])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    assert np.allclose(centre, found.centroids, atol=1e-9)


def test_empty_cells_move_onto_far_vectors(spark):
    points = vectors_of(spark, blobs())
    alike = np.tile(np.array(blobs()[0][1]), (6, 1))  # five of six seeds get nothing in the first round
    costs = []
    found = clustering._settle(clustering.usable(points, 16), clustering.one_level(alike / np.linalg.norm(alike[0])), 30, costs)
    assert len(clustering.measure(clustering.usable(points, 16), found)) == 6
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:])) and costs[-1] < 0.9 * costs[0]


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(clustering, "ONE_LEVEL", 8)
    rows = blobs(1500)
    costs = []
    found = clustering.train(vectors_of(spark, rows), 40, 16, costs=costs)
    assert 30 <= len(found) <= 50 and len(found.groups) == 7 and len(costs) == 2
    assert all(b <= a + 1e-9 for level in costs for a, b in zip(level, level[1:])) and costs[1][-1] < costs[0][-1]


def test_few_or_no_vectors(spark):
    assert len(clustering.train(vectors_of(spark, ODD_VECTORS), 4, 16)) == 0
    assert len(clustering.train(vectors_of(spark, [(i, [1.0] * 16) for i in range(9)]), 4, 16)) == 1


def exact(spark, rows, asked, k=10):
    return rows_of(vector_search.top_k(vectors_of(spark, rows), asked, k, 16))


def test_kept_cells(spark, tmp_path, monkeypatch):
    rows = blobs(900)
    asked = vectors_of(spark, rows).filter("id % 60 = 0").select(F.col("id").alias("query_id"), "vector")
    index = VectorIndex(spark, str(tmp_path))
    assert index.top(asked, 10).count() == 0
    assert index.ensure(vectors_of(spark, rows + ODD_VECTORS), 16, cells=24, probes=6)
    # another session: nothing is trained, and a search reads the folders of the probed cells alone
    monkeypatch.setattr(clustering, "train", None)
    index = VectorIndex(spark, str(tmp_path))
    assert not index.ensure(vectors_of(spark, rows), 16)
    expected = exact(spark, rows, asked)
    found = {r[:2] for r in rows_of(index.top(asked, 10))}
    assert len(found & {r[:2] for r in expected}) >= 0.9 * len(expected)
    assert rows_of(index.top(asked, 10, exact=True)) == expected == rows_of(index.top(asked, 10, probes=24))
    assert rows_of(index.top(asked, 10, probes=1, exact=True)) == expected
    one = asked.filter("query_id = 60")
    files = [len(set(index.vectors(cells).inputFiles())) for cells in ([3], [3, 4, 5], range(24))]
    assert files[0] == 1 and files[1] == 3 and files[2] >= 20
    scanned = len(index.top(one, 10, probes=2).inputFiles())
    assert scanned == 2
    # upkeep writes the touched cells alone
    before = files_of(tmp_path)
    touched = index.refresh(vectors_of(spark, [(60, rows[7][1]), (7000, rows[60][1])]), spark.createDataFrame([(61,)], "id long"))
    assert len(touched) <= 4 and before.items() <= files_of(tmp_path).items()
    now = [(i, rows[7][1] if i == 60 else v) for i, v in rows if i != 61] + [(7000, rows[60][1])]
    assert rows_of(VectorIndex(spark, str(tmp_path)).top(asked, 10, exact=True)) == exact(spark, now, asked)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_kept_cells_have_the_recall_from_a_fresh_session(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    index = VectorIndex(spark, str(tmp_path))
    index.ensure(vectors, 64)
    index.choose_probes(vectors.filter("id % 100 = 0"), 10)
    found = {r[:2] for r in rows_of(VectorIndex(spark, str(tmp_path)).top(asked, 10))}
    expected = {r[:2] for r in rows_of(vector_search.top_k(vectors, asked, 10, 64))}
    assert len(found & expected) >= 0.9 * len(expected)
