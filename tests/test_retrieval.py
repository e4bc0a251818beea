"""The engine's operators against brute force, SQL and sqlite's full-text index."""

import sqlite3

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import vectors
from lodestream.operators import chunking, text_search, vector_search
from lodestream.plans import retrieval, sources, stored, telemetry, upkeep  # noqa: F401
from lodestream.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels", "pages", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {quoted} FROM ({oracle_sql()[name]})").fetchall()
    clean = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert clean(map(tuple, frame.select(*columns).collect())) == clean(expected)


def test_vector_functions(spark):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalized(F.col("a")).alias("u"))
    out = frame.collect()
    assert [r.c for r in out] == pytest.approx([1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    assert out[0].u == pytest.approx([0.6, 0.8]) and out[2].u == [0.0, 0.0]
    half = spark.createDataFrame([([0.1, 1000.5],), (None,), ([],)], "a array<float>").select(vectors.to_half("a").alias("h")).select("h", vectors.from_half("h").alias("a")).collect()
    assert half[0].a == pytest.approx([0.1, 1000.5], rel=1e-3) and len(half[0].h) == 4 and half[1].a is None and half[2].a == []


def test_equal_scores_are_ordered_by_id(spark):
    same = [(i, [1.0, float(i % 3) * 1e-9]) for i in range(40)]
    frame = spark.createDataFrame(same, "id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "query_id long, vector array<double>")
    out = vector_search.top_k(frame, asked, 10, 2).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in out) == [(1, i + 1, i) for i in range(10)]


def test_running_best_equals_a_sort():
    random = np.random.default_rng(5)
    scores, ids = np.round(random.random(5000), 2), random.permutation(5000)
    best = vector_search.Best(1, 7)
    for at in range(0, 5000, 300):
        best.add(0, scores[at : at + 300], ids[at : at + 300])
    order = np.lexsort((ids, -scores))[:7]
    assert best.ids[0].tolist() == ids[order].tolist() and best.scores[0].tolist() == scores[order].tolist()


def test_inverted_file_with_all_cells_is_exact_and_recall_is_high(spark):
    random = np.random.default_rng(3)
    centre = random.normal(size=(8, 16))
    points = [(i, (centre[i % 8] + 0.3 * random.normal(size=16)).tolist()) for i in range(400)] + [(900, None)]
    frame = spark.createDataFrame(points, "id long, vector array<double>")
    asked = frame.filter("id % 50 = 0 and vector is not null").select(F.col("id").alias("query_id"), "vector")
    exact = {(r.query_id, r["rank"]): r.id for r in vector_search.top_k(frame, asked, 10, 16).collect()}
    cells = vector_search.train_cells(frame, 8)
    celled = vector_search.assign_cells(frame, cells)
    assert {r.cell for r in celled.filter("vector is null").collect()} == {-1}
    every = {(r.query_id, r["rank"]): r.id for r in vector_search.probe(celled.filter("vector is not null"), asked, cells, 10, len(cells)).collect()}
    assert every == exact
    few = {(r.query_id, r.id) for r in vector_search.probe(celled.filter("vector is not null"), asked, cells, 10, 3).collect()}
    assert len(few & {(q, i) for (q, _), i in exact.items()}) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_inverted_file_has_the_recall_on_the_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    vectors = spark.read.parquet(f"{path}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r.query_id, r.id) for r in vector_search.top_k(vectors, asked, 10, 64).collect()}
    found = {(r.query_id, r.id) for r in queries()["ivf_topk"](spark, path).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_bm25_equals_the_full_text_index_of_sqlite(spark):
    texts = ["alpha beta gamma beta", "alpha delta", "beta beta beta", "epsilon zeta alpha", "gamma", "delta delta epsilon beta", ""]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(texts)))
    expected = {r: -s for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'beta OR gamma OR zeta'")}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = text_search.bm25(docs, spark.createDataFrame([(1, "Beta, gamma; zeta! beta a")], "query_id long, text string")).collect()
    assert {r.id: r.score for r in found} == pytest.approx(expected, abs=2e-6)


def test_top_of_bm25_equals_all_of_it(spark, monkeypatch):
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(random.choice(words, random.integers(0, 12)))) for i in range(300)] + [(900, None)], "id long, text string").repartition(4)
    asked = spark.createDataFrame([(q, " ".join(random.choice(words, 4))) for q in range(9)] + [(50, ""), (51, "none of it")], "query_id long, text string")
    every = text_search.ranks(text_search.bm25(docs, asked), "place", 7).collect()
    for pairs in (2_000_000, 5):
        monkeypatch.setattr(text_search, "BROADCAST_PAIRS", pairs)
        top = text_search.bm25_top(docs, asked, 7).collect()
        assert sorted((r.query_id, r.place, r.id, round(r.score, 5)) for r in top) == sorted((r.query_id, r.place, r.id, round(r.score, 5)) for r in every)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id long, id long, rank int")
    out = {r.id: (r.score, r.place) for r in text_search.fuse([a, b]).collect()}
    assert out[11] == (pytest.approx(1 / 60 + 1 / 61), 0) and out[10] == (pytest.approx(1 / 60), 1)


def test_fold_and_tokens(spark):
    from lodestream.functions.text import tokens

    rows = [("Für die Ração, e\u0301te; ΆΛΦΑ Ёж 東京 x1",), (None,), ("a_b-c",)]
    out = [r.t for r in spark.createDataFrame(rows, "t string").select(tokens(F.col("t")).alias("t")).collect()]
    assert out == [["fur", "die", "racao", "ete", "αλφα", "еж", "東京", "x1"], [], ["a", "b", "c"]]


def brute_chunks(section, budget, overlap):
    """Units by a loop over characters, windows by a loop over units."""
    wide, units, at = 4 * budget, [], 0
    for line in section.split("\n"):
        for k in range(0, max(len(line), 1), wide):
            units.append(at + k)
        at += len(line) + 1
    out = []
    for w in sorted({u // wide for u in units}):
        inside = [i for i, u in enumerate(units) if w * wide - 4 * overlap <= u < (w + 1) * wide]
        a, b = units[inside[0]], [*units, len(section)][inside[-1] + 1]
        if section[a:b].strip(" \t\n"):
            out.append(section[a:b].strip(" \t\n"))
    return out


FENCED = """intro
# A
one two

## B ##
```
# no heading
```
~~~ text
# neither
~~~
three
   ### C
#no heading
    # code
# D"""


def test_sections_know_their_headings():
    found = [(p, t.strip()) for p, t in chunking.sections(FENCED)]
    assert found == [((), "intro"), (("A",), "one two"), (("A", "B"), "```\n# no heading\n```\n~~~ text\n# neither\n~~~\nthree"), (("A", "B", "C"), "#no heading\n    # code"), (("D",), "")]
    assert list(chunking.sections("")) == [((), "")] and chunking.chunk(None) == []


@pytest.mark.parametrize("budget, overlap", [(5, 0), (8, 3), (20, 19)])
def test_chunks_equal_a_loop(budget, overlap):
    random = np.random.default_rng(budget)
    for _ in range(60):
        text = "".join(random.choice(list("ab \n"), p=[0.4, 0.3, 0.2, 0.1]) for _ in range(random.integers(0, 300)))
        assert list(chunking.windows(text, budget, overlap)) == brute_chunks(text, budget, overlap)
        joined = "".join(chunking.windows(text, budget, 0)).replace("\n", "").replace(" ", "")
        assert joined == text.replace("\n", "").replace(" ", "")  # no unit is lost


def test_chunk_tables(spark):
    frame = spark.createDataFrame([(1, FENCED), (2, None), (3, ""), (4, " \n"), (5, "x" * 5000)], "id long, text string")
    out = chunking.chunks(frame, budget=100, overlap=20)
    rows = sorted((r.id, r.ordinal, r.headings, r.text, r.tokens) for r in out.collect())
    assert [r[:3] for r in rows if r[0] == 1] == [(1, 0, ""), (1, 1, "A"), (1, 2, "A > B"), (1, 3, "A > B > C")]
    assert {r[0] for r in rows} == {1, 5} and sum(len(r[3]) for r in rows if r[0] == 5) == 5000
    indexed = {r.ordinal: r.indexed for r in chunking.with_context(out.filter("id = 1"), F.lit("Title")).collect()}
    assert indexed[0] == "Title\n\nintro" and indexed[1] == "Title > A\n\none two"
    context = {r.ordinal: r.context for r in chunking.with_neighbours(out.filter("id = 1").select("id", "ordinal"), out).collect()}
    assert context[0] == "intro\n\none two" and context[1].count("\n\n") == 2
    assert chunking.parameters_from(chunking.parameters(400, 50)) == {"budget": 400, "overlap": 50} and chunking.parameters_from("x") is None
    with pytest.raises(ValueError):
        chunking.chunks(frame, budget=5, overlap=5)


def test_hybrid_falls_back_to_words_and_keeps_hits_below_the_floor(spark):
    from lodestream.operators import hybrid

    passages = [(1, "a", "alpha beta", [1.0, 0.0]), (2, "a", "gamma", [0.0, 1.0]), (3, "b", "alpha", None), (4, "b", "delta", [-1.0, 0.0]), (5, "c", None, [0.9, 0.1])]
    frame = spark.createDataFrame(passages, "id long, group string, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "alpha delta", None), (3, "nothing", None)], "query_id long, text string, vector array<double>")
    found = {}
    for r in hybrid.retrieve(frame, asked, dim=2, floor=0.5).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert set(found[1]) == {1, 3, 5} and found[1][0] == 1  # 3 has a hit and no vector, 5 a vector and no hit
    assert found[2] == [4, 3, 1] or set(found[2]) == {1, 3, 4}
    assert 3 not in found
