"""Indexing a folder run by run, embedding, reranking, expansion, catalogues."""

import os

import pytest
from pyspark.sql import functions as F

from lodestream.operators import embedding, indexing, models


def test_a_folder_run_by_run(spark, tmp_path):
    root, store = tmp_path / "in", tmp_path / "store"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# A\none\n# B\ntwo")
    (root / "sub" / "b.txt").write_text("plain")
    (root / "c.html").write_text("<title>T</title><p>x</p>")
    (root / "big.txt").write_text("y" * 900)

    def run(k, **how):
        old = [spark.read.schema(s).parquet(str(store / f"{n}{k - 1}")) for n, s in (("s", indexing.STATES), ("p", indexing.PASSAGES))] if k else [None, None]
        states, passages = indexing.refreshed(spark, str(root), *old, most_bytes=500, budget=100, **how)
        states.write.parquet(str(store / f"s{k}"))
        passages.write.parquet(str(store / f"p{k}"))
        return {r.path: r for r in spark.read.parquet(str(store / f"s{k}")).collect()}, sorted((r.path, r.ordinal, r.indexed) for r in spark.read.parquet(str(store / f"p{k}")).collect())

    states, passages = run(0)
    assert {p: (r.status, r.passages) for p, r in states.items()} == {"a.md": ("synced", 2), "sub/b.txt": ("synced", 1), "c.html": ("synced", 1), "big.txt": ("error", 0)}
    assert passages == [("a.md", 0, "a > A\n\none"), ("a.md", 1, "a > B\n\ntwo"), ("c.html", 0, "T\n\nx"), ("sub/b.txt", 0, "b\n\nplain")]
    # a stored passage that is no longer what the file gives shows that an unchanged file is not read again
    (root / "a.md").write_text("# A\nother words")
    os.remove(root / "c.html")
    (root / "d.md").write_text("new")
    states, passages = run(1)
    assert set(states) == {"a.md", "sub/b.txt", "big.txt", "d.md"}
    assert passages == [("a.md", 0, "a > A\n\nother words"), ("d.md", 0, "d\n\nnew"), ("sub/b.txt", 0, "b\n\nplain")]
    _, again = run(2, overlap=10)  # other parameters: all files anew
    assert again == passages


def test_embedding_is_tried_again_and_completed(spark, tmp_path):
    flag = str(tmp_path / "failed")

    def embedder(texts):
        if "b" in texts and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("away")
        return [[float(len(t)), 1.0] for t in texts]

    passages = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "dddd")], "id long, text string").coalesce(1)
    stored = spark.createDataFrame([(1, [9.0, 9.0], "m"), (4, [9.0, 9.0], "old"), (7, None, "m")], "id long, vector array<float>, model string")
    out = {(r.id, r.model): r.vector for r in embedding.completed(passages, stored, embedder, model="m", batch=2, wait=0.01).collect()}
    assert out == {(1, "m"): [9.0, 9.0], (2, "m"): [1.0, 1.0], (3, "m"): [0.0, 1.0], (4, "m"): [4.0, 1.0], (7, "m"): None}
    with pytest.raises(Exception, match="vectors for"):
        embedding.embed(passages, lambda texts: [], model="m").collect()


def test_rerank_and_expand(spark):
    assert embedding.order_from("3, 1, 9, 3", 4) == [2, 0, 1, 3] and embedding.order_from("", 2) == [0, 1] and embedding.order_from("0 -1", 2) == [0, 1]
    found = spark.createDataFrame([(q, p, 10 * q + p, f"q{q}", f"t{p}") for q in (1, 2) for p in range(4)], "query_id long, place int, id long, query string, text string")

    def reranker(query, texts):
        if query == "q2":
            raise OSError("away")
        return "3 then 2"

    out = sorted((r.query_id, r.place, r.id) for r in embedding.rerank(found, reranker, window=3).collect())
    assert out == [(1, 0, 12), (1, 1, 11), (1, 2, 10), (1, 3, 13), (2, 0, 20), (2, 1, 21), (2, 2, 22), (2, 3, 23)]
    queries = spark.createDataFrame([(1, "x"), (2, None)], "query_id long, text string")
    rows = sorted(((r.query_id, r.variant, r.text) for r in embedding.expanded(queries, lambda t: [t + "1", t + "1", t, "", t + "2", t + "3"], most=2).collect()), key=repr)
    assert rows == [(1, 0, "x"), (1, 1, "x1"), (1, 2, "x2"), (2, 0, None), (2, 1, "1"), (2, 2, "2")]


def test_event_data(spark):
    lines = ["data: {\"a\"", "data: :1}", "", ": comment", "data: two", "", "data: [DONE]", ""]
    frame = spark.createDataFrame([(1, *x) for x in enumerate(lines)], "stream long, n long, value string")
    assert sorted(r.data for r in embedding.event_data(frame).collect()) == ["two", '{"a"\n:1}']


def test_catalogue(spark):
    catalog = spark.createDataFrame([("m:latest", "chat", 7, False), ("n", "chat", 9, True), ("p:7b", "chat", 9, False), ("p:13b", "embed", 1, False)], "name string, kind string, size int, loaded boolean")
    names = spark.createDataFrame([("m",), ("n:latest",), ("p",), ("p:7b",), ("q",), ("p:1b",)], "wanted string")
    out = {r.wanted: r.name for r in models.resolved(names, catalog).collect()}
    assert out == {"m": "m:latest", "n:latest": "n", "p": "p:13b", "p:7b": "p:7b", "q": None, "p:1b": None}
    states = spark.createDataFrame([("", True, None, None), ("m", False, "m", True), ("m", True, None, None), ("m", True, "m", True), ("m", True, "m", None)], "w string, o boolean, n string, l boolean")
    assert [r.s for r in states.select(models.state(F.col("w"), F.col("o"), F.col("n"), F.col("l")).alias("s")).collect()] == ["none", "offline", "missing", "loaded", "ready"]
    assert {(r.kind, r.name) for r in models.first_by(catalog, "kind", ["size"]).collect()} == {("chat", "n"), ("embed", "p:13b")}


def test_manifests_lists_and_paths(spark, tmp_path):
    from lodestream.functions.text import united
    from lodestream.sources import files

    bodies = [("a", '{"config": {"size": 5}, "layers": [{"size": 10}, {"size": -3}, {}]}'), ("b", "no json"), ("c", None), ("d", '{"layers": []}')]
    assert sorted(map(tuple, models.manifest_sizes(spark.createDataFrame(bodies, "name string, body string")).collect())) == [("a", 15, 3), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0)]
    lists = spark.createDataFrame([(["MD", "txt"], ["csv", "md", None]), (None, ["x"]), (None, None)], "a array<string>, b array<string>")
    assert [r.u for r in lists.select(united(F.col("a"), F.col("b")).alias("u")).collect()] == [["md", "txt", "csv"], ["x"], []]
    for p in ("a/b/c.md", "a/c.md", "c.md", "a/b.txt", "x/a/b.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    kept = lambda *patterns: sorted(r.path for r in files.scan(spark, str(tmp_path), without_paths=list(patterns)).collect())
    assert kept("a/*.md") == ["a/b.txt", "a/b/c.md", "c.md", "x/a/b.txt"] and kept("**/*.md") == ["a/b.txt", "x/a/b.txt"]
    assert kept("a/**") == ["c.md", "x/a/b.txt"] and kept("?.md", "**/b.txt") == ["a/b/c.md", "a/c.md"]
    (tmp_path / "l.json").write_text('{"a": 1, "b": "x"}\n{"b": 7}\nnot\n{"a": "no"}\n')
    rows = files.read_lines(spark, str(tmp_path / "l.json"), "a int, b string", {"a": 9, "b": "none"}).collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x"), (9, "7"), (9, "none"), (9, "none")]


def test_last_rows_of_a_hot_key(spark):
    from lodestream.operators import rollups

    rows = spark.createDataFrame([("hot" if i % 5 else f"k{i % 3}", i, f"v{i // 4}") for i in range(3000)], "k string, at int, v string").repartition(6)
    found = sorted((r.k, r["at"]) for r in rollups.last_of_each(rows, 5, ["k"], ["at"]).collect())
    every = sorted((r.k, r["at"]) for r in rows.collect())
    assert found == sorted(x for k in ("hot", "k0", "k1", "k2") for x in [r for r in every if r[0] == k][-5:])
    shares = spark.createDataFrame([("a", 1, 10, 100), ("a", 2, 15, 110), ("a", 3, 2, 5), ("a", 4, 9, 10)], "k string, t int, p int, w int")
    assert [r.share for r in rollups.share_of_change(shares, ["k"], ["t"], "p", "w").orderBy("t").collect()] == [None, 0.5, 0.0, 1.0]
