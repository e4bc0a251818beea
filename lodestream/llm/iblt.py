"""Document fingerprints as invertible Bloom lookup sketches, with SQL functions only.

A text's paragraphs are its lines, cut at every PIECE code points; a text below SHORT code points has, beside them,
pieces of FINE code points. Each distinct piece has a 64-bit digest. A fingerprint is a power of two of blocks of
3 x SIDE cells, as many as its digests ask for (BLOCK_LOAD a block at most on average): a digest falls into one block,
and there into one cell of each third. A cell keeps how many digests fell into it, their exclusive or, and that of
their check hashes. Blocks are chosen by low bits, so a fingerprint folds to any smaller one by adding blocks.

Two fingerprints are compared by their cells alone: folded to the smaller number of blocks, one is subtracted from
the other. What is left holds only the digests in which they differ, and peeling recovers these one by one from cells
that hold a single one. It is tried with a quarter of the blocks; a block that fails is tried again as the two blocks of
a sketch twice as large, up to the whole sketch. What a block of the whole sketch doesn't give up is counted by the
least number that its cells can hold if at most half of them are left, else all of the block's digests count as differing.

The likeness of two fingerprints is the share of common digests among all digests of both.

Defined cases: null text counts as empty; two texts without pieces are alike (1.0), one without and one with
are not (0.0); rows are ordered by identifier (null as the least) and, where they share one, by a hash of the text and
the text; equal rows are neighbours; a single document is its own successor; very long texts only have more blocks;
repeated pieces count once; an empty table gives an empty result; only the key and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.tables import table, whole_text

#: Code points of a piece; those of the finer pieces that a text below SHORT code points has as well.
PIECE, FINE, SHORT = 128, 8, 512
#: Cells in each third of a block, a power of two, and digests that a block of a whole fingerprint takes on average at most.
SIDE, BLOCK_LOAD = 8, 16
#: Rounds of peeling; sizes that are tried, each twice as large as the one before.
ROUNDS, LEVELS = 12, 3
#: Documents in one range of keys, and ranges at most (their bounds are held by the driver).
RANGE_ROWS, MOST_RANGES = 1000, 1 << 16

_CELLS = 3 * SIDE
_SHIFT = 40  # a digest's low bits choose its block, those from here on its cells, eight bits for each third
_LEAST = "cast(-9223372036854775808 as bigint)"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """SQL: the distinct digests of the pieces of a text column."""
    pieces = "regexp_extract_all(%s, '[^\\\\n]{1,%d}', 0)"
    return f"array_distinct(transform(concat({pieces % (text, PIECE)}, if(length({text}) < {SHORT}, {pieces % (text, FINE)}, array())), x -> xxhash64(x)))"


def _check(digest: str) -> str:
    return f"(xxhash64({digest}, 1) & 4294967295L)"


def _with_cells(df: DataFrame, found: str, name: str) -> DataFrame:
    """df with the cells, struct(n, k, c) each, of a column of digests, which goes."""
    kept = [c for c in df.columns if c != found]
    bits = f"cast(greatest(0, ceil(log2(size({found}) / {BLOCK_LOAD}))) as int)"
    # by the lower half of the bits first, then each part by the others: a digest is looked at twice the root of the blocks' number
    now = df.selectExpr("*", f"{bits} as __bits").selectExpr("*", "__bits div 2 as __low", "__bits - __bits div 2 as __high")
    now = now.selectExpr("*", f"transform(sequence(0, shiftleft(1, __low) - 1), q -> filter({found}, d -> (d & (shiftleft(1, __low) - 1)) = q)) as __parts")
    high = "(shiftrightunsigned(d, __low) & (shiftleft(1, __high) - 1))"
    now = now.selectExpr("*", f"flatten(transform(sequence(0, shiftleft(1, __high) - 1), r -> transform(__parts, x -> filter(x, d -> {high} = r)))) as __blocks")
    lists = ", ".join(f"filter(b, d -> (d & {(SIDE - 1) << shift}L) = {cell << shift}L)" for shift in (_SHIFT + 8 * third for third in range(3)) for cell in range(SIDE))
    cell = f"named_struct('n', size(l), 'k', aggregate(l, 0L, (a, d) -> a ^ d), 'c', aggregate(l, 0L, (a, d) -> a ^ {_check('d')}))"
    return now.selectExpr(*kept, f"flatten(transform(__blocks, b -> transform(array({lists}), l -> {cell}))) as {name}")


_ADD = "named_struct('n', x.n + y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c)"
_NONE = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def _folded(cells: str, blocks: str) -> str:
    """SQL: the cells of the same digests in fewer blocks."""
    return f"if(size({cells}) = {_CELLS} * {blocks}, {cells}, transform(sequence(0, {_CELLS} * {blocks} - 1), i -> aggregate(sequence(i, size({cells}) - 1, {_CELLS} * {blocks}), {_NONE}, (x, at) -> {_let(f'{cells}[at]', 'y', _ADD)})))"


def _peeled(cells: str) -> str:
    """SQL: what is left of a block's cells after peeling, and how many digests came out."""
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 and {_check('x.k')} = x.c), x -> x.k))"
    minus = f"transform(filter(s.cells, x -> x.n = -1 and {_check('x.k')} = x.c), x -> x.k)"
    signed = f"transform({pure}, k -> named_struct('n', if(array_contains(m, k), -1, 1), 'k', k, 'c', {_check('k')}))"
    falls = f"(shiftright(y.k, {_SHIFT} + 8 * cast(i div {SIDE} as int)) & {SIDE - 1}) = i % {SIDE}"
    taken = f"transform(s.cells, (v, i) -> aggregate(filter(p, y -> {falls}), v, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c)))"
    step = f"if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'done', true), named_struct('cells', {taken}, 'found', s.found + size(p), 'done', false))"
    start = f"named_struct('cells', {cells}, 'found', 0, 'done', false)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.done, s, {_let(minus, 'm', _let(signed, 'p', step))}))"


def _least(cells: str) -> str:
    """SQL: the least number of digests that a block's cells can hold."""
    return f"greatest({', '.join(f'aggregate(slice({cells}, {third * SIDE + 1}, {SIDE}), 0, (t, x) -> t + if(x.n = 0 and (x.k != 0 or x.c != 0), 2, abs(x.n)))' for third in range(3))})"


def _number(cells: str, block: str = "0", blocks: str = "1") -> str:
    """SQL: the digests in every so-manieth block of cells."""
    return f"aggregate(sequence({block}, cast(size({cells}) / {_CELLS} as int) - 1, {blocks}), 0, (t, q) -> t + aggregate(slice({cells}, {_CELLS} * q + 1, {SIDE}), 0, (u, x) -> u + x.n))"


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of two columns of cells; one select a size that is tried, so that no expression grows with LEVELS."""
    kept = df.columns
    now = df.selectExpr("*", f"cast(least(size({a}), size({b})) / {_CELLS} as int) as __blocks")
    now = now.selectExpr("*", f"zip_with({_folded(a, '__blocks')}, {_folded(b, '__blocks')}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c)) as __difference")
    first = f"greatest(1, __blocks div {1 << (LEVELS - 1)})"
    now = now.selectExpr("*", f"transform(sequence(0, cast({first} as int) - 1), j -> named_struct('at', j, 'size', cast({first} as int))) as __open", "0 as __differing")
    for _ in range(LEVELS):
        block = f"transform(sequence(0, {_CELLS - 1}), i -> aggregate(sequence(o.at, __blocks - 1, o.size), {_NONE}, (x, q) -> {_let(f'__difference[{_CELLS} * q + i]', 'y', _ADD)}))"
        left = "size(filter(s.cells, x -> x.n != 0 or x.k != 0 or x.c != 0))"
        whole = f"if(2 * l <= {_CELLS}, s.found + {_least('s.cells')}, {_number(a, 'o.at', 'o.size')} + {_number(b, 'o.at', 'o.size')})"
        larger = "array(named_struct('at', o.at, 'size', 2 * o.size), named_struct('at', o.at + o.size, 'size', 2 * o.size))"
        nothing = "cast(array() as array<struct<at int, size int>>)"
        outcome = f"if(l = 0, named_struct('d', s.found, 'open', {nothing}), if(o.size < __blocks, named_struct('d', 0, 'open', {larger}), named_struct('d', {whole}, 'open', {nothing})))"
        tried = now.selectExpr(*kept, "__blocks", "__difference", "__differing", f"transform(__open, o -> {_let(_peeled(block), 's', _let(left, 'l', outcome))}) as __tried")
        now = tried.selectExpr(*kept, "__blocks", "__difference", "__differing + aggregate(__tried, 0, (t, x) -> t + x.d) as __differing", "flatten(transform(__tried, x -> x.open)) as __open")
    # all digests of both, and those that both have
    now = now.selectExpr(*kept, f"{_number(a)} + {_number(b)} as __all", "__differing").selectExpr(*kept, "__all", "greatest(0, __all - __differing) / 2 as __common")
    return now.selectExpr(*kept, f"if(__all = 0, 1.0D, __common / (__all - __common)) as {name}")


def fingerprint(cells: str) -> str:
    """SQL: cells as text, 28 hexadecimal digits each: how many (modulo 65536), digests, checks."""
    return f"array_join(transform({cells}, x -> concat(lpad(hex(x.n & 65535), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c), 8, '0'))), '')"


def _bounds(docs: DataFrame) -> list[int]:
    """Bounds of ranges of about RANGE_ROWS rows; a key that fills several ranges stands there several times."""
    n = min(MOST_RANGES, -(-docs.count() // RANGE_ROWS))
    if n < 2:
        return []
    shares = ", ".join(f"{i / n!r}D" for i in range(1, n))
    return [int(b) for b in docs.selectExpr(f"percentile_approx(place, array({shares}), {max(10_000, 4 * n)})").first()[0]]


def _range_of(bounds: list[int]) -> Column:
    """The range of a row: how many bounds do not pass its place; rows of a key that has several are dealt by the hash, in its order."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = "array(" + ", ".join(f"{_long(g[0])}" for g in groups) + ")"
    lists = "array(" + ", ".join("array(" + ", ".join(map(_long, g)) + ")" for g in groups) + ")"

    def passed(sign: str) -> str:  # in two steps: the groups that begin with a passed bound, then within the last of them
        return _let(f"size(filter({heads}, s -> s {sign} place))", "g", f"if(g = 0, 0, (g - 1) * {step} + size(filter(element_at({lists}, g), s -> s {sign} place)))")

    share = "(shiftrightunsigned(hash, 11) / 9007199254740992D)"  # of all hashes those below, as numbers without sign
    return F.expr(_let(passed("<"), "low", _let(passed("<="), "high", f"if(high - low < 2, high, low + 1 + cast((high - low) * {share} as int))")))


def _long(value: int) -> str:
    return _LEAST if value == -(1 << 63) else f"{value}L"


def _ordered(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs(key, text) dealt by ranges of the order of rows, and the window over a range.

    The first row of each range is also sent to the range before it (extra), so no row waits for another range and no task
    sees all rows. The first of all follows the last.
    """
    placed = docs.selectExpr("key", "text", f"coalesce(key, {_LEAST}) as place", "xxhash64(text) as hash")
    bounds = _bounds(placed.select("place"))
    placed = placed.withColumn("range", _range_of(bounds))
    order = "named_struct('place', place, 'high', shiftrightunsigned(hash, 1), 'low', hash & 1)"
    firsts = {r["range"]: r["first"] for r in placed.groupBy("range").agg(F.expr(f"min({order})").alias("first")).collect()}
    used = sorted(firsts)
    ahead = {r: used[i - 1] for i, r in enumerate(used)}
    if used:
        number = {r: i + 1 for i, r in enumerate(used)}
        at = "range + 1" if used == list(range(len(used))) else f"array_position(array({', '.join(map(str, used))}), range)"
        low = "array(" + ", ".join(f"named_struct('place', {_long(firsts[r]['place'])}, 'high', {firsts[r]['high']}L, 'low', {firsts[r]['low']}L)" for r in number) + ")"
        before = "array(" + ", ".join(str(ahead[r]) for r in number) + ")"
        copies = f"if({order} = element_at({low}, cast({at} as int)), array(named_struct('range', range, 'extra', false), named_struct('range', element_at({before}, cast({at} as int)), 'extra', true)), array(named_struct('range', range, 'extra', false)))"
    else:
        copies = "array(named_struct('range', range, 'extra', false))"
    dealt = placed.selectExpr("key", "text", "place", "hash", f"explode({copies}) as to").select("key", "text", "place", "hash", "to.range", "to.extra")
    return dealt, Window.partitionBy("range").orderBy("extra", "place", F.expr("shiftrightunsigned(hash, 1)"), F.expr("hash & 1"), "text")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, window = _ordered(docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text")))
    followed = rows.withColumn("next", F.lead("text").over(window)).withColumn("n", F.length("text"))
    edited = followed.selectExpr("key", "place", "hash", "range", "extra", "text", "n", "concat(substring(text, 1, n - n div 4), substring(coalesce(next, ''), 1, cast(n div 4 as int))) as edited")
    parts = edited.selectExpr("key", "place", "hash", "range", "extra", "text", "cast(n as bigint) as n_chars", "sha2(edited, 256) as edited_sha256", f"{digests('text')} as own", f"{digests('edited')} as other")
    parts = _with_cells(_with_cells(parts, "own", "cells"), "other", "edited_cells")
    parts = parts.withColumn("next_cells", F.lead("cells").over(window)).filter("not extra").drop("text", "place", "hash", "range", "extra")
    parts = with_likeness(with_likeness(parts, "cells", "edited_cells", "near_edited"), "cells", "next_cells", "near_next")
    return parts.selectExpr(f"key as `{key}`", "n_chars", "edited_sha256", f"{fingerprint('cells')} as fingerprint", f"{fingerprint('edited_cells')} as edited_fingerprint", "near_edited", "near_next")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
