"""Full-text ranking with BM25 (Robertson and Zaragoza), and fusion of rankings by reciprocal rank.

Tokens are runs of Unicode letters and digits, folded. For a batch of queries the queries' terms are joined by
broadcast, under a counted bound, to the exploded tokens of the documents, so tokens that no query asks for never
leave their task, and counts are combined before they are shuffled. Postings can also be made once and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import tokens
from lodestream.operators.vector_search import FOUND, Best, ranked
from lodestream.session import cut

K1, B = 1.2, 0.75
#: Pairs of a query and a term that are broadcast in one block of queries (12 bytes each, and the terms).
BROADCAST_PAIRS = 2_000_000
#: What a task holds at a time of tokens, of pairs of a query and a document's term (some 50 bytes each), and of scores.
TOKENS, PAIRS, SCORES = 500_000, 1_000_000, 1_000_000
#: Queries whose rankings are fused at once.
FUSED_QUERIES = 1024
#: Pairs of a query and a term that are broadcast as a table; beyond, the joins are shuffles.
BROADCAST_TERMS = 200_000


def postings(docs: DataFrame) -> DataFrame:
    """docs(id, text) to (id, term, count, length): length is that of the document in tokens."""
    words = docs.select("id", tokens(F.col("text")).alias("tokens")).select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return words.groupBy("id", "term", "length").agg(F.count("*").alias("count"))


def query_terms(queries: DataFrame, most: int | None = None) -> DataFrame:
    """queries(query_id, text) to (query_id, term): the distinct tokens of two characters or more, or the first of them."""
    found = F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) > 1))
    return queries.select("query_id", F.explode(F.slice(found, 1, most) if most else found).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B, floor: float = 1e-6, most: int | None = None) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with the query.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least floor; N, n and the mean length are those of all documents. Null texts
    have no tokens and count as documents; identifiers are expected to be unique.
    """
    asked = query_terms(queries, most)
    terms = asked.select("term").distinct()
    # pairs of a query and a term are at least as many as terms, and what is broadcast
    small = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hint = F.broadcast if small else (lambda df: df)
    cut_up = docs.select("id", tokens(F.col("text")).alias("tokens"))
    sizes = cut_up.agg(F.count("*").alias("all"), F.sum(F.size("tokens")).alias("words"))
    met = cut_up.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(hint(terms), "term", "left_semi")
    counts = met.groupBy("id", "term", "length").agg(F.count("*").alias("count"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("n"))
    # one row by one row, then terms (at most BROADCAST_TERMS) with their weight
    weighed = frequency.crossJoin(F.broadcast(sizes)).withColumn("idf", F.greatest(F.log((F.col("all") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(floor)))
    share = F.col("count") * (k1 + 1) / (F.col("count") + k1 * (1 - b + b * F.col("length") * F.col("all") / F.col("words")))
    scored = counts.join(hint(weighed), "term").select("id", "term", (F.col("idf") * share).alias("part"))
    return scored.join(hint(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def _blocks(queries: DataFrame, most: int | None, at_once: int | None = None) -> Iterator[tuple[list, list[str], np.ndarray, np.ndarray]]:
    """Queries in blocks of a bounded number of terms, and of queries if told: their ids, the distinct terms, and the pairs of a term and a query, by term."""
    ids: list = []
    lists: list[list[str]] = []
    held = 0

    def block():
        number: dict[str, int] = {}
        term = np.array([number.setdefault(t, len(number)) for ts in lists for t in ts], np.int64)
        query = np.repeat(np.arange(len(ids)), [len(ts) for ts in lists])
        order = np.argsort(term, kind="stable")
        return ids, list(number), term[order], query[order]

    asked = query_terms(queries, most).groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    for r in asked.orderBy("query_id").toLocalIterator():
        if ids and (held + len(r[1]) > BROADCAST_PAIRS or len(ids) == at_once):
            yield block()
            ids, lists, held = [], [], 0
        ids.append(r[0])
        lists.append(r[1])
        held += len(r[1])
    if ids:
        yield block()


def _steps(ends: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most so many rows, and of at most so much of what the rows' running sums (from 0) tell; one row at least."""
    at, last = 0, len(ends) - 1
    while at < last:
        stop = min(max(int(np.searchsorted(ends, ends[at] + most, "right")) - 1, at + 1), at + rows, last)
        yield at, stop
        at = stop


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' documents by about TOKENS tokens, so that what a task holds does not grow with the rows of a batch."""
    for batch in batches:
        length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _steps(np.concatenate([[0], np.cumsum(length)]), TOKENS, batch.num_rows):
            yield batch.slice(a, b - a)


def _counted(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the batch's documents: their lengths, then document, term and count of every asked term that they hold."""
    lists = batch.column(1)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(lists.flatten(), terms).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(found >= 0)
    document = np.repeat(np.arange(len(length)), length)[at]
    key, count = np.unique(document * len(terms) + found[at], return_counts=True)
    return length, key // len(terms), key % len(terms), count


class _Block:
    """A block of queries with the weights of their terms; scores batches of documents in tasks."""

    def __init__(self, cut_up: DataFrame, block: tuple, k1: float, b: float, floor: float):
        ids, listed, term, query = block
        sc = cut_up.sparkSession.sparkContext
        self.words = words = sc.broadcast(listed)

        def count(batches):
            terms, total = pa.array(words.value, pa.string()), np.zeros(len(words.value) + 2, np.int64)
            for batch in _slices(batches):
                length, _, held, _ = _counted(batch, terms)
                total[:-2] += np.bincount(held, minlength=len(terms))
                total[-2:] += (len(length), length.sum())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

        total = np.zeros(len(listed) + 2, np.int64)
        for r in cut_up.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per asked term
            total[r[0]] = r[1]
        self.n_all, self.n_words = total[-2:].tolist()
        idf = np.maximum(np.log((self.n_all - total[:-2] + 0.5) / (total[:-2] + 0.5)), floor)
        times = np.bincount(term, minlength=len(listed))
        self.sent = sc.broadcast((np.array(ids, np.int64), idf, query, np.cumsum(times) - times, times))
        self.k1, self.b = k1, b

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By slices of documents: scores (queries by documents), how many terms each shares, and the documents' ids."""
        names, weight, asking, first, times = self.sent.value
        terms, step = pa.array(self.words.value, pa.string()), max(1, SCORES // len(names))
        for batch in _slices(batches):
            length, document, held, count = _counted(batch, terms)
            part = weight[held] * (count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length[document] * self.n_all / self.n_words)))
            ids = batch.column(0).to_numpy()
            start = np.searchsorted(document, np.arange(len(length) + 1))
            pairs = np.concatenate([[0], np.cumsum(times[held])])[start]
            for at, stop in _steps(pairs, PAIRS, step):
                own, size = slice(start[at], start[stop]), stop - at
                n = times[held[own]]
                ends = np.cumsum(n)
                if not len(ends):
                    continue
                met = asking[np.repeat(first[held[own]] - (ends - n), n) + np.arange(ends[-1])]
                place = met * size + np.repeat(document[own] - at, n)
                scores = np.bincount(place, np.repeat(part[own], n), len(names) * size).reshape(len(names), -1)
                yield np.round(scores, 6), np.bincount(place, minlength=scores.size).reshape(scores.shape), ids[at:stop]


def _add(best: Best, scores: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
    """The hits among scores (queries by documents) that may enter."""
    near = hit & (scores >= best.least[:, None])
    for q in np.flatnonzero(near.any(1)).tolist():
        here = np.flatnonzero(near[q])
        best.add(q, scores[q, here], ids[here])


def _token_lists(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").cast("long").alias("id"), tokens(F.col("text")).alias("tokens"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, *, k1: float = K1, b: float = B, floor: float = 1e-6, most: int | None = None) -> DataFrame:
    """The k best documents of each query by bm25(): (query_id, id, score, place).

    One pass counts the asked terms' documents, a second one scores in tasks, by products of sparse matrices, and keeps
    one running top k per query, so scores of other documents never leave their task.
    """
    cut_up, out = _token_lists(docs), None
    for made in _blocks(queries, most):
        block = _Block(cut_up, made, k1, b, floor)

        def top(batches, block=block):
            names = block.sent.value[0]
            best = Best(len(names), k)
            for scores, shared, ids in block.scores(batches):
                _add(best, scores, shared > 0, ids)
            yield best.batch(names)

        found = cut_up.filter("id is not null").mapInArrow(top, FOUND)
        out = found if out is None else out.unionAll(found)
    out = docs.sparkSession.createDataFrame([], FOUND) if out is None else out
    return ranked(out, k).select("query_id", "id", "score", (F.col("rank") - 1).alias("place"))


def ahead(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, own_ids: np.ndarray) -> np.ndarray:
    """For each of own how many rows stand before it: with a greater score, or an equal one and a smaller id."""
    kind = np.concatenate([np.ones(len(ids), bool), np.zeros(len(own_ids), bool)])
    order = np.lexsort((kind, np.concatenate([ids, own_ids]), -np.concatenate([scores, own])))
    before = np.cumsum(kind[order])
    out = np.zeros(len(kind), np.int64)
    out[order] = before
    return out[len(ids) :]


def fused_top(docs: DataFrame, queries: DataFrame, most: int, *, k: int = 60, depth: int = 400, k1: float = K1, b: float = B, floor: float = 1e-6) -> DataFrame:
    """The first rows of the fusion of two whole rankings: BM25, and the number of distinct shared terms: (query_id, id, score, place).

    Both rank the same documents, those that share a term with the query. The first `depth` of each are kept in the tasks; what is in
    neither scores at most 2 / (k + depth), less than the `most`-th place of one ranking alone gives from depth = k + 2 * most on,
    so every row of the result is among them. Of these, a row that is in one list only has a rank of at least depth in
    the other: if even that could not bring it among the first, it goes; for the few others a second pass counts the rows that
    stand before them. No ranking is ever sorted as a whole, and the result is that of the whole rankings.
    """
    depth = max(depth, k + 2 * most)
    cut_up, out = _token_lists(docs), None
    known = cut_up.filter("id is not null")
    for made in _blocks(queries, None, FUSED_QUERIES):
        block = _Block(cut_up, made, k1, b, floor)

        def both(batches, block=block):
            names = block.sent.value[0]
            best = [Best(len(names), depth) for _ in range(2)]
            for scores, shared, ids in block.scores(batches):
                for own, by in zip(best, (scores, shared.astype(np.float64))):
                    _add(own, by, shared > 0, ids)
            for arm, own in enumerate(best):
                rows = own.batch(names)
                yield rows.append_column("arm", pa.array(np.full(rows.num_rows, arm, np.int32)))

        order = Window.partitionBy("query_id", "arm").orderBy(F.col("score").desc(), "id")
        tops = known.mapInArrow(both, f"{FOUND}, arm int").withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < depth)
        arm = lambda of, column: F.max(F.when(F.col("arm") == of, F.col(column)))
        tops = cut(tops.groupBy("query_id", "id").agg(arm(0, "rank").alias("r0"), arm(1, "rank").alias("r1")))
        part = lambda rank: 1.0 / (k + rank)
        least = F.coalesce(part(F.col("r0")), F.lit(0.0)) + F.coalesce(part(F.col("r1")), F.lit(0.0))
        full = F.col("r0").isNotNull() & F.col("r1").isNotNull()
        lower = tops.withColumn("least", least).withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("least").desc(), "id")))
        bar = lower.filter(F.col("turn") == most).select("query_id", F.col("least").alias("bar"))
        kept = lower.join(bar, "query_id", "left").filter(full | (F.col("least") + 1.0 / (k + depth) >= F.coalesce("bar", F.lit(0.0)) - 1e-9)).select("query_id", "id", "r0", "r1")
        kept = cut(kept)
        open_: dict[int, list[int]] = {}
        for r in kept.filter("r0 is null or r1 is null").select("query_id", "id").collect():  # fewer than 2 * depth for each of at most FUSED_QUERIES queries
            open_.setdefault(r[0], []).append(r[1])
        if open_:
            kept = _with_counted(known, block, kept, open_)
        found = kept.select("query_id", "id", F.round(part(F.col("r0")) + part(F.col("r1")), 9).alias("score"))
        out = found if out is None else out.unionByName(found)
    out = docs.sparkSession.createDataFrame([], FOUND) if out is None else out
    return ranks(out, "place", most)


def _with_counted(known: DataFrame, block: _Block, kept: DataFrame, open_: dict[int, list[int]]) -> DataFrame:
    """kept(query_id, id, r0, r1) with the ranks that are missing, counted over all documents. open_: per query the ids in question."""
    sc = known.sparkSession.sparkContext
    asked = sc.broadcast({q: np.array(sorted(ids), np.int64) for q, ids in open_.items()})

    def own_scores(batches):
        """Both scores of the rows in question."""
        names = block.sent.value[0]
        for scores, shared, ids in block.scores(batches):
            for q, name in enumerate(names.tolist()):
                if name in asked.value and len(here := np.flatnonzero(np.isin(ids, asked.value[name]) & (shared[q] > 0))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), name)), pa.array(ids[here]), pa.array(scores[q, here]), pa.array(shared[q, here].astype(np.float64))], names=["query_id", "id", "s0", "s1"])

    found: dict[int, list[tuple]] = {}
    for r in known.mapInArrow(own_scores, "query_id long, id long, s0 double, s1 double").collect():  # the rows of open_
        found.setdefault(r[0], []).append((r[1], r[2], r[3]))
    told = sc.broadcast({q: tuple(np.array(c) for c in zip(*sorted(rows))) for q, rows in found.items()})

    def count(batches):
        names = block.sent.value[0]
        sums = {q: np.zeros((2, len(rows[0])), np.int64) for q, rows in told.value.items()}
        for scores, shared, ids in block.scores(batches):
            for q, name in enumerate(names.tolist()):
                if name in sums and len(here := np.flatnonzero(shared[q] > 0)):
                    own_ids, s0, s1 = told.value[name]
                    sums[name][0] += ahead(scores[q, here], ids[here], s0, own_ids)
                    sums[name][1] += ahead(shared[q, here].astype(np.float64), ids[here], s1, own_ids)
        for name, (c0, c1) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c0), name)), pa.array(told.value[name][0]), pa.array(c0), pa.array(c1)], names=["query_id", "id", "c0", "c1"])

    counted = known.mapInArrow(count, "query_id long, id long, c0 long, c1 long").groupBy("query_id", "id").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return kept.join(counted, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("r0", "c0").alias("r0"), F.coalesce("r1", "c1").alias("r1"))


def ranks(scored: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The rank of each row within its query, from 0, best first, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    out = scored.withColumn(name, F.row_number().over(order) - 1)
    return out.filter(F.col(name) < most) if most else out


def fuse(rankings: list[DataFrame], *, k: int = 60, most: int = 10) -> DataFrame:
    """Reciprocal rank fusion (Cormack, Clarke and Buettcher) of whole rankings (query_id, id, rank from 0)."""
    listed = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        listed = listed.unionByName(r.select("query_id", "id", "rank"))
    scored = listed.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return ranks(scored, "place", most)
