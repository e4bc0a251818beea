"""Repeated byte strings across documents: sampled suffixes, range partitions, multikey quicksort.

Every string of LENGTH bytes holds one sampled suffix: the one whose first GRAM bytes (its gram) have the least
hash in the string, so equal strings have equal grams; about one position in fourteen is sampled. Neighbouring
strings with the same sampled suffix are a run, and the bytes that a run covers are its context.

Suffixes are dealt to buckets by their leading bytes: splitters are drawn from a bounded sample of the suffixes
(SAMPLE_BYTES of text; it steers the balance alone, never the result). A leading token so frequent that it takes
several splitters has all their buckets, dealt by the gram's hash. Documents are gathered in groups of bounded
size, and a group folds what it holds twice before it ships anything. Then:

1. Groups ship four bytes a gram; buckets tell which grams other documents have.
2. For these alone, groups ship each distinct context's hash and its smallest document; buckets tell which
   contexts an earlier document has whole (its later holders are covered), and of which grams contexts differ.
3. For these, the first holder of each context ships its bytes. Buckets sort all strings there by multikey
   quicksort over eight-byte characters and tell which of them an earlier document has. A string that reaches over
   the edge of one suffix's share is compared under the next one's. Contexts of a gram with more than HOT different
   ones are cut into single strings, dealt by each string's hash, so no bucket gathers all of them.

Buckets and groups both grow with the input, so what a group asks of them travels in at most LANES rows, one for
all buckets of a lane, and a lane's answers to a group are gathered before they go back: the rows that are shuffled grow with the input,
not with its square.

Strings are compared byte by byte in step 3; whole contexts in step 2 by 96 bits of two hashes, within a bucket.

Defined cases: null text counts as empty; null identifiers rank after all others and do not shadow each other, nor
do rows with the same identifier; texts shorter than LENGTH keep all bytes; repeated rows each get their result;
long texts are hashed in pieces (a text shares its group with others, by a hash, and a group is held whole); an empty table gives an empty result; only the key and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import give_back, tidy

#: Bytes of a string, and of the grams whose hashes choose the sampled suffix.
LENGTH, GRAM = 50, 24
#: Bytes of text in one group of documents on average, in the smallest ones, and positions that are hashed at a time.
GROUP_BYTES, LEAST_GROUP, CHUNK = 4 << 20, 256 << 10, 1 << 18
#: Bytes of text whose suffixes the splitters are drawn from, suffixes taken of one document, splitters at most.
SAMPLE_BYTES, SAMPLE_EACH, SPLITTERS = 8 << 20, 1024, 4096
#: Rows that a group asks with at most, and bytes of answers that a task holds before it hands them on.
LANES, TOLD_BYTES = 1024, 16 << 20
#: Different contexts of one gram from which they are cut into single strings.
HOT = 4096

_WINDOW = LENGTH - GRAM + 1  # grams of a string
_NO_ID = np.iinfo(np.int64).max
_A = 0x9E3779B97F4A7C15
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A55A5A5A5A)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the size bytes from each position."""
    h, span = _BYTE[raw], 1
    out, done = None, 0
    while True:
        if size & span:
            out = h if out is None else out[: len(h) - done] * np.uint64(pow(_A, span, 1 << 64)) + h[done:]
            done += span
        if done == size:
            return _mix(out)
        h = h[:-span] * np.uint64(pow(_A, span, 1 << 64)) + h[span:]
        span *= 2


def leading(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes from each place as a number that orders as they do."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | raw[at + k]
    return out


@dataclass
class Runs:
    """Runs of strings that share a sampled suffix: first start, how many, place of the suffix, gram, context, document."""

    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    document: np.ndarray


def runs_of(raw: np.ndarray, ends: np.ndarray) -> Runs:
    """The runs of all documents that lie one after the other in raw."""
    parts = []
    for at in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK):
        h = gram_hashes(raw[at : at + CHUNK + LENGTH - 1])
        # the place stands in the low bits; equal grams leave it to the position, which costs a comparison in step 3
        v = h & ~np.uint64(63) | np.arange(len(h), dtype=np.uint64) & np.uint64(63)
        span = 1
        while 2 * span <= _WINDOW:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < _WINDOW:
            v = np.minimum(v[: len(v) - (_WINDOW - span)], v[_WINDOW - span :])
        start = np.arange(len(v), dtype=np.int64)
        place = start + ((v.astype(np.int64) - start) & 63)
        document = np.searchsorted(ends, start + at, side="right")
        inside = np.flatnonzero(start + at + LENGTH <= ends[document])
        if not len(inside):
            continue
        start, place, document = start[inside], place[inside], document[inside]
        edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])]))
        count = np.diff(np.append(edge, len(start)))
        start, place, document = start[edge], place[edge], document[edge]
        stop = start + count + LENGTH - 1  # four grams cover a context
        context = count.astype(np.uint64)
        for k in (start, start + GRAM, stop - 2 * GRAM, stop - GRAM):
            context = _mix(context * np.uint64(_A) + h[k])
        parts.append((start + at, count, place + at, h[place], context, document))
    if not parts:
        none = np.zeros(0, np.int64)
        parts = [(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)]
    return Runs(*(np.concatenate(x) for x in zip(*parts)))


@dataclass
class Ranges:
    """Buckets of suffixes: splitters of leading bytes, each range in parts that the gram's hash deals."""

    splitters: np.ndarray
    parts: int

    @property
    def buckets(self) -> int:
        return (len(self.splitters) + 1) * self.parts

    def bucket(self, lead: np.ndarray, gram: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.splitters, lead, side="left")
        width = np.searchsorted(self.splitters, lead, side="right") - low + 1
        share = (gram >> np.uint64(40)).astype(np.int64)
        return (low + share % width) * self.parts + (share >> 8) % self.parts


class Group:
    """The documents of one group, in ascending order of identifier and text, with their runs and buckets."""

    def __init__(self, rows: pa.Table, ranges: Ranges):
        ids = rows.column("id").combine_chunks()
        text = rows.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):  # an empty table
            text = pa.array([], pa.binary())
        number = np.where(ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy(False), _NO_ID)
        order = np.argsort(number, kind="stable")
        same = np.flatnonzero(number[order][1:] == number[order][:-1])
        if len(same):  # rows that share an identifier follow in the order of their texts
            order = np.array(sorted(order.tolist(), key=lambda i: (number[i], text[i].as_py())), np.int64)
        self.given = ids.take(pa.array(order))
        self.ids = number[order]
        text = text.take(pa.array(order))
        offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
        data = text.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.ends = offsets[1:] - offsets[0]
        self.runs = r = runs_of(self.raw, self.ends)
        self.name = rows.column("group")[0].as_py()
        self.bucket = ranges.bucket(leading(self.raw, r.place), r.gram)
        # a gram within its bucket, in 32 bits
        self.key = self.bucket << 32 | (_mix(r.gram * np.uint64(_A)) >> np.uint64(32)).astype(np.int64)

    def grams(self) -> Iterator[tuple]:
        """Step 1. By bucket: the group's grams, and which of them two of its documents have."""
        key, back = np.unique(self.key, return_inverse=True)
        owner = self.ids[self.runs.document]
        low, high = np.full(len(key), _NO_ID), np.full(len(key), -_NO_ID)
        np.minimum.at(low, back, owner)
        np.maximum.at(high, back, owner)
        for b, at in _by_bucket(key >> 32):
            yield b, self.name, (key[at] & 0xFFFFFFFF).astype(np.uint32).tobytes(), np.packbits(low[at] != high[at]).tobytes()

    def contexts(self, answers: pa.Table) -> Contexts:
        """The distinct contexts of grams that other documents have, in the order of bucket, gram and hash."""
        told = _step(answers, 1)
        wanted = [np.int64(b) << 32 | np.frombuffer(t, np.uint32).astype(np.int64) for b, t in zip(told.column("bucket").to_pylist(), told.column("a").to_pylist())]
        wanted = np.sort(np.concatenate([*wanted, [np.iinfo(np.int64).max]]))
        run = np.flatnonzero(wanted[np.searchsorted(wanted, self.key)] == self.key)
        key, context = self.key[run], self.runs.context[run]
        order = np.lexsort((context, key))
        key, context, run = key[order], context[order], run[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])])[: len(key)]
        owner = self.ids[self.runs.document[run]]
        low = np.minimum.reduceat(owner, np.flatnonzero(new)) if len(run) else owner
        return Contexts(run, np.cumsum(new) - 1, key[new], context[new], low)


@dataclass
class Contexts:
    """Of a group: runs and the number of each one's context; by context the gram's key, the hash, the smallest document."""

    run: np.ndarray
    which: np.ndarray
    key: np.ndarray
    hash: np.ndarray
    low: np.ndarray

    def rows(self, name: int) -> Iterator[tuple]:
        """Step 2. By bucket: grams, contexts, smallest documents."""
        for b, at in _by_bucket(self.key >> 32):
            yield b, name, (self.key[at] & 0xFFFFFFFF).astype(np.uint32).tobytes(), self.hash[at].tobytes(), self.low[at].tobytes()

    def verdicts(self, answers: pa.Table) -> np.ndarray:
        """Of each context the bits that its bucket told."""
        out = np.zeros(len(self.key), np.uint8)
        told = _step(answers, 2)
        by = dict(zip(told.column("bucket").to_pylist(), told.column("a").to_pylist()))
        for b, at in _by_bucket(self.key >> 32):
            if b in by:
                out[at] = np.frombuffer(by[b], np.uint8)
        return out


#: What step 2 tells of a context: an earlier document has it; its strings are to be compared; one by one.
EARLIER, COMPARE, SINGLY = 1, 2, 4


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted array and its slice."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), slice(a, b)


def _step(answers: pa.Table, step: int) -> pa.Table:
    return answers.filter(pa.array(answers.column("step").to_numpy() == step))


def _column(rows: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's arrays in one, and how many values each row has."""
    parts = [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def other_documents(rows: pa.Table) -> Iterator[tuple]:
    """Step 1 of one bucket: per group its grams that some other document has."""
    gram, sizes = _column(rows, "a", np.uint32)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(rows.column("b").to_pylist(), sizes.tolist())])
    _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
    hit = ((count > 1) | (np.bincount(back, twice, len(count)) > 0))[back]
    ends = np.cumsum(sizes)
    for group, a, b in zip(rows.column("group").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
        chosen = gram[a:b][hit[a:b]]
        if len(chosen):
            yield group, chosen.tobytes()


def judged(rows: pa.Table, hot: int = HOT) -> Iterator[tuple]:
    """Step 2 of one bucket: per group the bits of its contexts."""
    gram, sizes = _column(rows, "a", np.uint32)
    context, low = _column(rows, "b", np.uint64)[0], _column(rows, "c", np.int64)[0]
    order = np.lexsort((low, context, gram))
    g, c, d = gram[order], context[order], low[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_gram | np.concatenate([[True], c[1:] != c[:-1]])
    first = np.flatnonzero(new)
    which, of = np.cumsum(new) - 1, np.cumsum(new_gram) - 1  # of each row its context, its gram
    earliest = d[first]
    edge = np.flatnonzero(new_gram[first])
    number = np.diff(np.append(edge, len(first)))
    differ = (number > 1) & (np.minimum.reduceat(earliest, edge) < np.maximum.reduceat(earliest, edge))
    bits = np.where(d > earliest[which], EARLIER, np.where(differ[of], np.where(number[of] > hot, COMPARE | SINGLY, COMPARE), 0)).astype(np.uint8)
    out = np.empty(len(bits), np.uint8)
    out[order] = bits
    ends = np.cumsum(sizes)
    for group, a, b in zip(rows.column("group").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
        if out[a:b].any():
            yield group, out[a:b].tobytes()


def multikey_quicksort(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of this length at starts, and which of them differ from the one before.

    Characters are eight bytes. All segments of a level are split at once, each by a pivot of its own (the middle one of
    three), into less, equal and greater; the equal part goes on with the next character, until strings are used up.
    """
    word = raw.astype(np.uint64)
    for span in (1, 2, 4):
        word = word[:-span] << np.uint64(8 * span) | word[span:]
    offsets = np.array([*range(0, length - 8, 8), length - 8])
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    begin, size, depth = np.array([0]), np.array([len(starts)]), np.array([0])
    while True:
        open_ = (size > 1) & (depth < len(offsets))
        begin, size, depth = begin[open_], size[open_], depth[open_]
        if not len(begin):
            return order, new
        ends = np.cumsum(size)
        base = ends - size
        at = np.repeat(begin - base, size) + np.arange(ends[-1])
        held = order[at]
        character = word[starts[held] + np.repeat(offsets[depth], size)]
        three = np.sort(character[np.stack([base, base + size // 2, ends - 1])], axis=0)
        pivot = np.repeat(three[1], size)
        less, greater = character < pivot, character > pivot
        sums = []
        for part in (less, greater):
            running = np.concatenate([[0], np.cumsum(part)])
            sums.append((running[:-1] - np.repeat(running[base], size), running[ends] - running[base]))
        (rank_less, n_less), (rank_greater, n_greater) = sums
        n_equal = size - n_less - n_greater
        inner = np.arange(ends[-1]) - np.repeat(base, size)
        to = np.where(less, rank_less, np.where(greater, np.repeat(n_less + n_equal, size) + rank_greater, np.repeat(n_less, size) + inner - rank_less - rank_greater))
        order[np.repeat(begin, size) + to] = held
        new[(begin + n_less)[n_equal > 0]] = True
        new[(begin + n_less + n_equal)[n_greater > 0]] = True
        begin = np.concatenate([begin, begin + n_less, begin + n_less + n_equal])
        size = np.concatenate([n_less, n_equal, n_greater])
        depth = np.concatenate([depth, depth + 1, depth])


def earlier_strings(rows: pa.Table) -> Iterator[tuple]:
    """Step 3 of one bucket: per group the runs of strings that an earlier document has: context, place in it, how many."""
    number, per_group = _column(rows, "a", np.int64)
    size, low = _column(rows, "b", np.uint8)[0].astype(np.int64), _column(rows, "c", np.int64)[0]
    raw = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8)
    begin = np.cumsum(size) - size
    strings = size - LENGTH + 1
    context = np.repeat(np.arange(len(size)), strings)
    place = np.arange(len(context)) - np.repeat(np.cumsum(strings) - strings, strings)
    order, new = multikey_quicksort(raw, begin[context] + place)
    least = np.minimum.reduceat(low[context[order]], np.flatnonzero(new))
    smallest = np.empty(len(context), np.int64)
    smallest[order] = least[np.cumsum(new) - 1]
    told = smallest < low[context]
    goes_on = told[1:] & told[:-1] & (context[1:] == context[:-1])
    edge = np.flatnonzero(told & ~np.concatenate([[False], goes_on]))
    stop = np.flatnonzero(told & ~np.concatenate([goes_on, [False]]))
    owner = np.repeat(np.arange(rows.num_rows), per_group)[context[edge]]
    groups = rows.column("group").to_pylist()
    for k, at in _by_bucket(owner):
        e = edge[at]
        yield groups[k], number[context[e]].tobytes(), place[e].astype(np.uint8).tobytes(), (stop[at] - e + 1).astype(np.uint8).tobytes()


def _table(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    del columns
    give_back()
    return out


_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


_LISTS = [(k, pa.list_(pa.binary())) for k in "abc"]
#: What groups ask buckets, a row for each group and lane, and what buckets tell groups.
_ASKED = pa.schema([("lane", pa.int32()), ("group", pa.int32()), ("bucket", pa.list_(pa.int32())), *_LISTS, ("data", pa.list_(pa.binary()))])
_TOLD = pa.schema([("group", pa.int32()), ("bucket", pa.list_(pa.int32())), ("step", pa.list_(pa.int32())), *_LISTS])
_DDL |= {pa.list_(pa.int32()): "array<int>", pa.list_(pa.binary()): "array<binary>"}


def _by_lane(rows: Iterator[tuple], lanes: int) -> pa.Table:
    """What a group asks, in a row for each lane."""
    held: dict[tuple, list[list]] = {}
    for bucket, group, *rest in rows:
        lists = held.setdefault((bucket % lanes, group), [[] for _ in range(5)])
        for own, value in zip(lists, (bucket, *rest, *[None] * (4 - len(rest)))):
            own.append(value)
    return _table(((*key, *lists) for key, lists in held.items()), _ASKED)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's answers, rows of _TOLD, in a row for each group; handed on whenever they are many."""
    held: dict[int, list[list]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        table = _table(((group, *lists) for group, lists in held.items()), _TOLD).combine_chunks()
        held.clear()
        return table.to_batches()[0]

    for batch in batches:
        size += batch.nbytes
        for group, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            for own, values in zip(held.setdefault(group, [[] for _ in range(5)]), rest):
                own += values
        if held and size > TOLD_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _apart(rows: pa.Table, *keys: str) -> pa.Table:
    """Rows of lists as single rows again; only inside a task, so Spark never makes a row for each group and bucket."""
    at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("bucket")).to_numpy())
    return pa.table({c: rows.column(c).take(pa.array(at)) if c in keys else pc.list_flatten(rows.column(c)) for c in rows.column_names if c in keys or pa.types.is_list(rows.schema.field(c).type)})


def _ranges(source: DataFrame, size: int, buckets: int) -> Ranges:
    """Splitters from the sampled suffixes of some documents, chosen by a hash."""
    share = max(1, math.ceil(size / SAMPLE_BYTES))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                raw = np.frombuffer(text.as_py()[: SAMPLE_EACH * 2 * LENGTH], np.uint8)
                place = runs_of(raw, np.array([len(raw)])).place[:SAMPLE_EACH]
                out.append(leading(raw, place).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["leads"])

    some = source.filter(F.pmod(F.xxhash64("id", "text"), F.lit(share)) == 0).select("text")
    found = [np.frombuffer(r[0], np.uint64) for r in some.mapInArrow(tidy(leads), "leads binary").collect()]
    found = np.sort(np.concatenate([*found, np.zeros(0, np.uint64)]))
    n = min(buckets, SPLITTERS)
    splitters = found[np.arange(1, n) * len(found) // n] if len(found) else found
    return Ranges(splitters, math.ceil(buckets / n))


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = True, group_bytes: int | None = None, hot: int = HOT, lanes: int = LANES) -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes that stay (kept)."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).cast("binary").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = math.ceil(size / group_bytes) if group_bytes else max(math.ceil(size / GROUP_BYTES), min(2 * spread, math.ceil(size / LEAST_GROUP)))
    groups = max(1, groups)
    ranges = _ranges(source, size, groups)
    # rows without identifier, and those that share one, are dealt by their texts
    grouped = source.withColumn("group", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))

    def grams(rows: pa.Table) -> pa.Table:
        return _by_lane(Group(rows, ranges).grams(), lanes)

    def contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _table(iter(()), _ASKED)
        group, answers = Group(rows, ranges), _apart(answers)
        return _by_lane(group.contexts(answers).rows(group.name), lanes)

    def strings(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _table(iter(()), _ASKED)
        group, answers = Group(rows, ranges), _apart(answers)
        found = group.contexts(answers)
        bits = found.verdicts(answers)
        # the first run of each context to be compared
        held, first = np.unique(found.which, return_index=True)
        held, first = held[bits[held] & COMPARE > 0], found.run[first[bits[held] & COMPARE > 0]]
        start, count, bucket = group.runs.first[first], group.runs.count[first], found.key[held] >> 32
        singly = bits[held] & SINGLY > 0
        if singly.any():  # each string stands alone, dealt by its own hash
            each = np.flatnonzero(singly)
            n = count[each]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(start[each], n) + place
            window = np.stack([group.raw[own + k] for k in range(LENGTH)])
            value = np.zeros(len(own), np.uint64)
            for row in window:
                value = value * np.uint64(_A) + _BYTE[row]
            start, count = np.concatenate([start[~singly], own]), np.concatenate([count[~singly], np.ones(len(own), np.int64)])
            held, bucket = np.concatenate([held[~singly], np.repeat(held[each], n)]), np.concatenate([bucket[~singly], (_mix(value) % np.uint64(ranges.buckets)).astype(np.int64)])
            shift = np.concatenate([np.zeros(int((~singly).sum()), np.int64), place])
        else:
            shift = np.zeros(len(start), np.int64)
        order = np.argsort(bucket, kind="stable")
        start, count, held, bucket, shift = (x[order] for x in (start, count, held, bucket, shift))
        out = []
        for b, at in _by_bucket(bucket):
            length = count[at] + LENGTH - 1
            ends = np.cumsum(length)
            data = group.raw[np.repeat(start[at] - (ends - length), length) + np.arange(ends[-1])]
            # number and place of a context travel together
            out.append((b, group.name, (held[at] << 5 | shift[at]).tobytes(), length.astype(np.uint8).tobytes(), found.low[held[at]].tobytes(), data.tobytes()))
        return _by_lane(iter(out), lanes)

    def tell(step: int, rows: pa.Table, found) -> pa.Table:
        """The answers of a lane's buckets, one after the other, in a row for each group."""
        asked = _apart(rows, "group")
        bucket = asked.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        held: dict[int, list[list]] = {}
        for b, at in _by_bucket(bucket[order]):
            for group, *rest in found(asked.take(pa.array(order[at]))):
                for own, value in zip(held.setdefault(group, [[] for _ in range(5)]), (b, step, *rest, *[None] * (3 - len(rest)))):
                    own.append(value)
        return _table(((group, *lists) for group, lists in held.items()), _TOLD)

    result = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(iter(()), result)
        group = Group(rows, ranges)
        runs = group.runs
        change = np.zeros(len(group.raw) + 1, np.int32)

        def remove(start: np.ndarray, count: np.ndarray) -> None:
            stop = start + count + LENGTH - 1
            np.add.at(change, start, 1)
            np.add.at(change, stop, -1)

        if answers.num_rows:
            answers = _apart(answers)
            found = group.contexts(answers)
            bits = found.verdicts(answers)
            owner = group.ids[runs.document[found.run]]
            whole = found.run[(bits[found.which] & EARLIER > 0) | (owner > found.low[found.which])]
            remove(runs.first[whole], runs.count[whole])
            told = _step(answers, 3)
            if told.num_rows:
                name, place, count = (_column(told, c, k)[0].astype(np.int64) for c, k in (("a", np.int64), ("b", np.uint8), ("c", np.uint8)))
                number, place = name >> 5, place + (name & 31)
                # to all rows of the context's first document
                mine = np.flatnonzero(owner == found.low[found.which])
                times = np.bincount(found.which[mine], minlength=len(found.key))
                begin = np.cumsum(times) - times
                repeat = times[number]
                at = mine[np.repeat(begin[number], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)]
                remove(runs.first[found.run[at]] + np.repeat(place, repeat), np.repeat(count, repeat))
        gone = np.cumsum(change)[:-1] > 0
        out, at = [], 0
        for given, end in zip(group.given.to_pylist(), group.ends.tolist()):
            here = gone[at:end]
            kept = group.raw[at:end][~here].tobytes() if here.any() else group.raw[at:end].tobytes()
            spans = int(here[:1].sum() + (here[1:] & ~here[:-1]).sum())
            row = (given, end - at, int(here.sum()), spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
            at = end
        return _table(iter(out), result)

    by_group = grouped.groupBy("group")

    def told(asked: DataFrame, step: int, found) -> DataFrame:
        """The answers of all buckets, shuffled to their groups by an exchange that all later steps share, so no step runs twice."""
        answers = asked.groupBy("lane").applyInArrow(lambda rows: tell(step, rows, found), _ddl(_TOLD))
        return answers.mapInArrow(_by_group, _ddl(_TOLD)).repartition("group")

    def with_answers(*answers: DataFrame):
        rows = answers[0]
        for more in answers[1:]:
            rows = rows.unionAll(more)
        return by_group.cogroup(rows.groupBy("group"))

    one = told(by_group.applyInArrow(grams, _ddl(_ASKED)), 1, other_documents)
    two = told(with_answers(one).applyInArrow(contexts, _ddl(_ASKED)), 2, partial(judged, hot=hot))
    three = told(with_answers(one, two).applyInArrow(strings, _ddl(_ASKED)), 3, earlier_strings)
    kept = with_answers(one, two, three).applyInArrow(last, _ddl(result))
    return kept.withColumnRenamed("id", key)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False)


#: Every 50-byte string of every document, in hexadecimal digits.
OP6_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, length(h) // 2 AS n, p AS begun, substr(h, 2 * p + 1, 2 * (500 + 49)) AS part FROM (SELECT *, UNNEST(range(0, length(h) // 2, 500)) AS p FROM texts)),
strings AS (SELECT doc_id, begun + i AS i, substr(part, 2 * i + 1, 100) AS s FROM (SELECT *, UNNEST(range(0, LEAST(500, n - 49 - begun))) AS i FROM pieces WHERE n - 49 > begun)),
least AS (SELECT s, MIN(doc_id) AS first FROM strings GROUP BY s HAVING MIN(doc_id) < MAX(doc_id)),
later AS (SELECT doc_id, i, COALESCE(i > 50 + LAG(i) OVER (PARTITION BY doc_id ORDER BY i), TRUE) AS opens FROM strings JOIN least USING (s) WHERE doc_id > first),
numbered AS (SELECT doc_id, i, SUM(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM later),
spans AS (SELECT doc_id, span, MIN(i) AS a, MAX(i) + 50 AS b FROM numbered GROUP BY ALL),
between_ AS (
  SELECT doc_id, span AS turn, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY span), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, MAX(span) + 1, MAX(b), NULL FROM spans GROUP BY doc_id),
rest AS (SELECT t.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (COALESCE(b, length(h) // 2) - a)), '' ORDER BY turn) AS kept FROM between_ JOIN texts t USING (doc_id) GROUP BY t.doc_id),
sums AS (SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept, h))) AS kept_sha256
FROM texts LEFT JOIN sums USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
