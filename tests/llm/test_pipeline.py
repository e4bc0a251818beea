"""The pipeline against a brute-force version over the smallest tables."""

import zlib

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestream.llm import bpe, mixing, superminhash, toxicity

from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    rows = sorted((tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()), key=lambda r: r[0])
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    fit = [r for r in rows if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 5]
    order = {r.k: r.h for r in spark.createDataFrame([(r[0],) for r in fit], "k long").selectExpr("k", "xxhash64(k) as h").collect()}
    fit.sort(key=lambda r: (order[r[0]], r[0]))
    scores = toxicity.Scorer(toxicity.fit([r[1] for r in fit], [labels[r[0]] for r in fit]), "test").scores([r[1] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    last = {r[1]: r for r in rows}  # ascending doc_id: the largest stays
    rows = sorted(last.values())
    groups = brute_components(rows, 5, 80)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.key: r.copies for r in mixing.plan(kept).collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    expected = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in rows for _ in range(copies[r[0]]))
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == expected


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage[1](spark, docs, SF).columns == docs.columns


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key long, rest string, component_id long"
ODD = [(1, None, None, None, None), (None, "a b c", "en", "x", 3), (None, "a b c", "en", "x", 3), (4, "", "en", "y", 0), (5, "a b c", "en", "x", 3), (5, "a b c", "en", "x", 3), (6, "word " * 100_000, "en", None, 1), (7, "\t \n", "en", "x", 3)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_of_empty_and_odd_tables(spark, stage):
    """Nulls, repeated rows, empty and very long texts and clashing names pass; an empty table gives an empty result."""
    docs = spark.createDataFrame([(*r, 9, "r", 9) for r in ODD], CLASHING)
    out = stage[1](spark, docs, SF)
    if stage[0] != "bpe":
        assert out.schema == docs.schema
    count = {"toxicity": 8, "exact_dedup": 4, "near_dedup": None, "mixing": None, "bpe": 8}[stage[0]]
    rows = out.collect()
    assert count is None or len(rows) == count
    assert stage[1](spark, docs.limit(0), SF).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(*r, 9, "r", 9) for r in ODD], CLASHING)
    kept = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()))
    assert [k for known, k, _ in kept if known] == [1, 4, 5, 5, 6, 7] or [k for known, k, _ in kept if known] == [1, 4, 5, 6, 7]


def test_near_dedup_decides_row_by_row(spark):
    """Rows without an identifier, and rows that share one, are judged by their own texts."""
    a, b, c = "one two three four five six seven eight nine ten", "red green blue white black grey pink brown gold tin", "x y z u v w p q r s"
    rows = [(5, a), (None, a), (None, b), (None, f"{b} lead"), (7, c), (7, f"{c} t"), (7, "other words that nobody else has written so far"), (8, None), (None, ""), (9, f"{c} t")]
    docs = spark.createDataFrame([(k, t, "en", "x", 1, 9, "r", 9) for k, t in rows], CLASHING).repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()), key=repr)
    first_c, first_b = [t for k, t in kept if k == 7 and t in (c, f"{c} t")], [t for k, t in kept if k is None and t]
    assert len(first_c) == 1 and len(first_b) == 1 and first_b[0] in (b, f"{b} lead")
    assert kept == sorted([(5, a), (None, first_b[0]), (7, first_c[0]), (7, rows[6][1]), (8, None), (None, "")], key=repr)
    assert {r.component_id for r in superminhash.near_groups(docs).filter("doc_id = 9 or doc_id = 7").collect()} == {7}
