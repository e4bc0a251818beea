"""Heading-aware chunking of Markdown (CommonMark's ATX headings and code fences).

A document is cut into sections at headings outside code fences; each section knows the headings above it. A section
is a row of units: its lines, and pieces of lines that are longer than a window. Windows lie at equal
distances of `budget` tokens (estimated at four characters each) over the section; a chunk is the part of the section
whose units begin in one window, and it begins earlier by the units that begin in the last `overlap` tokens before. So
where chunks are cut is known from the units' offsets alone, no unit is lost, and nothing within a unit is cut.

Null and empty documents, and sections of white space alone, give no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import CHARS_A_TOKEN

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")


def sections(markdown: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """Sections with the headings above them."""
    path: list[tuple[int, str]] = []
    begin = at = 0
    fence = ""
    for line in markdown.split("\n"):
        end = at + len(line) + 1
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line[mark.end() :].strip():
                fence = ""
        elif mark:
            fence = mark[1]
        elif heading := _HEADING.match(line):
            yield tuple(h for _, h in path), markdown[begin:at]
            begin, level = end, len(heading[1])
            path = [p for p in path if p[0] < level] + [(level, heading[2] or "")]
        at = end
    yield tuple(h for _, h in path), markdown[begin:]


def windows(section: str, budget: int, overlap: int) -> Iterator[str]:
    """The chunks of a section."""
    wide, before = budget * CHARS_A_TOKEN, overlap * CHARS_A_TOKEN
    lengths = np.fromiter((len(x) + 1 for x in section.split("\n")), np.int64)
    first = np.cumsum(lengths) - lengths
    # a line gives a unit at its start and one at every window's width
    per_line = np.maximum(1, -(-(lengths - 1) // wide))
    start = np.repeat(first, per_line) + wide * (np.arange(per_line.sum()) - np.repeat(np.cumsum(per_line) - per_line, per_line))
    stop = np.append(start[1:], len(section))
    own = np.unique(start // wide)
    low, high = np.searchsorted(start, own * wide - before), np.searchsorted(start, (own + 1) * wide) - 1
    for a, b in zip(start[low].tolist(), stop[high].tolist()):
        if text := section[a:b].strip(" \t\n"):
            yield text


def chunk(markdown: str | None, budget: int = 400, overlap: int = 50) -> list[tuple[str, str]]:
    """(headings joined by " > ", text) of each chunk."""
    return [(" > ".join(path), text) for path, section in sections(markdown or "") for text in windows(section, budget, overlap)]


def chunks(docs: DataFrame, *, budget: int = 400, overlap: int = 50) -> DataFrame:
    """docs(id, text) to (id, ordinal, headings, text, tokens); the identifier keeps its type."""
    if not 0 <= overlap < budget:
        raise ValueError("the overlap has to be less than the budget")

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = chunk(text, budget, overlap)
                if found:
                    headings, texts = zip(*found)
                    columns = [keys.take(pa.array([i] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array(headings, pa.string()), pa.array(texts, pa.string()), pa.array([-(-len(t) // CHARS_A_TOKEN) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "ordinal", "headings", "text", "tokens"])

    source = docs.select("id", F.col("text").cast("string"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ordinal int, headings string, text string, tokens long")


def with_context(found: DataFrame, title: Column | None = None) -> DataFrame:
    """Chunks with the column indexed: the document's title and the headings above the text, as an index reads it."""
    above = F.array_join(F.filter(F.array(title if title is not None else F.lit(""), F.col("headings")), lambda x: (x != "") & x.isNotNull()), " > ")
    return found.withColumn("indexed", F.when(above == "", F.col("text")).otherwise(F.concat(above, F.lit("\n\n"), F.col("text"))))


def parameters(budget: int, overlap: int) -> str:
    """The parameters as a text that is kept with what was made by them."""
    return f"window={budget};overlap={overlap}"


def parameters_from(text: str | None) -> dict[str, int] | None:
    """The parameters of such a text, None where it is none."""
    found = re.fullmatch(r"window=(\d+);overlap=(\d+)", text or "")
    return {"budget": int(found[1]), "overlap": int(found[2])} if found else None


def with_neighbours(found: DataFrame, every: DataFrame, radius: int = 1) -> DataFrame:
    """found(id, ordinal, ...) with context: the texts of the chunks around it, in order; an equi-join on offset ordinals."""
    around = found.select("id", "ordinal", F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius)).alias("near")).distinct()
    texts = every.select("id", F.col("ordinal").alias("near"), "text")
    merged = around.join(texts, ["id", "near"]).groupBy("id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("near", "text"))).alias("parts"))
    return found.join(merged.select("id", "ordinal", F.array_join("parts.text", "\n\n").alias("context")), ["id", "ordinal"])
