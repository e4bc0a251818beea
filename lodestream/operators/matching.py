"""Which of many patterns a text contains: an Aho-Corasick automaton in the tasks in place of a cross join.

The patterns are listed in an order; where several are contained the first listed wins. They are broadcast in blocks of a bounded size, each
worker builds a block's automaton once, and a text is read once per block, however many patterns there are.

Defined cases: a null text contains nothing; null patterns don't count; the empty pattern is in every text; equal patterns count
once, with the least place; matching is by code points, case counts; texts of any length are read whole; no patterns: nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns that are broadcast in one block; an automaton takes some 100 bytes for each at most.
BLOCK_CHARS = 1_000_000

_AUTOMATA: dict = {}


def _automaton(name: tuple, patterns: list[tuple[str, int]]):
    """This worker's automaton of a block; the one before it is let go."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for at, (text, _) in enumerate(patterns):
            made.add_word(text, at)
        made.make_automaton()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def _blocks(patterns: DataFrame) -> Iterator[list[tuple[str, int]]]:
    listed = patterns.filter("pattern is not null").groupBy("pattern").agg(F.min(F.col("place").cast("long")).alias("place"))
    block, size = [], 0
    for r in listed.orderBy("place", "pattern").toLocalIterator():
        if block and size + len(r[0]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[0])
    if block:
        yield block


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts(id, text), patterns(pattern, place) to (id, first, matches): the least place of a contained pattern, and how many are contained.

    Texts that contain none are left out; repeated identifiers are rows of their own.
    """
    spark = texts.sparkSession
    source = texts.select("id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")).filter("text is not null")
    kind, out = source.schema["id"].dataType.simpleString(), None
    for block in _blocks(patterns):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            held = sent.value
            name = (len(held), held[0], held[-1], sum(map(hash, held)))
            words, empty = [x for x in held if x[0]], [place for text, place in held if not text]
            places, automaton = [place for _, place in words], _automaton(name, words) if words else None
            for batch in batches:
                rows, firsts, counts = [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    found = {at for _, at in automaton.iter(text)} if automaton is not None else ()
                    if found or empty:
                        rows.append(i)
                        firsts.append(min([*empty, *(places[at] for at in found)]))
                        counts.append(len(found) + len(empty))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], names=["id", "row", "first", "matches"])

        part = source.mapInArrow(run, f"id {kind}, row long, first long, matches long")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], f"id {kind}, first long, matches long")
    return out.groupBy("id", "row").agg(F.min("first").alias("first"), F.sum("matches").alias("matches")).drop("row")
