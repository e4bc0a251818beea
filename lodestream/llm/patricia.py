"""Exact duplicates through Patricia tries.

Each scan task folds its rows into a trie first (one row per distinct text, so a group of copies that
holds a third of all rows shrinks to one row per task), the texts then go to the owner of their length
and content hash, and the owner's trie compares full byte strings: two texts meet in one terminal node
only if every byte agrees. Terminals keep the smallest or the largest identifier and the group's size.

Defined cases: null text counts as empty; null identifiers lose to any other; of rows that repeat an identifier
with the same text, owners() counts each, and distinct_texts() keeps the one whose other columns come first as
text; very long texts are compared whole, and a trie may hold a single one beyond its bound; an empty table gives an
empty result; columns of the input keep their names and values, whatever they are.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import tidy

#: Bytes of keys that a trie holds before a subtree spills (owners) or the rows so far are passed on (scans).
TRIE_BYTES = 96 << 20
#: Bytes of text in one Arrow batch that leaves a task.
BATCH_BYTES = 4 << 20

_NODE_COST = 200


def common_prefix(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of b agree with a from at on."""
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("children", "edge", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.value, self.children = edge, value, None


class PatriciaTrie:
    """A compressed radix trie over byte strings; values are merged by the given function.

    Beyond max_bytes the largest subtree below the first branching goes to a temporary file of this
    task, together with all later keys of its prefix; items() reads it back into a trie of its own.
    """

    def __init__(self, merge, max_bytes: int = TRIE_BYTES):
        self.merge, self.max_bytes = merge, max_bytes
        self.root, self.held = _Node(b""), 0
        self.spilled: list[tuple[bytes, object]] = []

    def add(self, key: bytes, value) -> None:
        for prefix, out in self.spilled:
            if key.startswith(prefix):
                pickle.dump((key, value), out)
                return
        self._insert(key, value)
        if self.held > self.max_bytes:
            self._spill()

    def _insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                leaf = _Node(key[at:], value)
                node.children = node.children or {}
                node.children[key[at]] = leaf
                self.held += len(leaf.edge) + _NODE_COST
                return
            if key.startswith(child.edge, at):
                at += len(child.edge)
                node = child
                continue
            shared = common_prefix(key, at, child.edge)
            upper = _Node(child.edge[:shared])
            upper.children = {child.edge[shared]: child}
            node.children[key[at]] = upper
            child.edge = child.edge[shared:]
            self.held += _NODE_COST
            node, at = upper, at + shared
        node.value = value if node.value is None else self.merge(node.value, value)

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.value is not None:
                yield prefix, node.value
            for child in (node.children or {}).values():
                stack.append((child, prefix + child.edge))

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + _NODE_COST
            stack += (node.children or {}).values()
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while node.value is None and node.children and len(node.children) == 1:
            node = next(iter(node.children.values()))
            prefix += node.edge
        if not node.children:
            return  # a single key is held, however long
        weights = {first: self._weight(child) for first, child in node.children.items()}
        first = max(weights, key=weights.get)
        child = node.children.pop(first)
        out = tempfile.TemporaryFile(prefix="lodestream-trie-")
        for item in self._walk(child, prefix + child.edge):
            pickle.dump(item, out)
        self.held -= weights[first]
        self.spilled.append((prefix + bytes([first]), out))

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from self._walk(self.root, b"")
        self.root = _Node(b"")
        for _, out in self.spilled:
            size = out.tell()
            out.seek(0)
            below = PatriciaTrie(self.merge, self.max_bytes)
            while out.tell() < size:
                below.add(*pickle.load(out))
            out.close()
            yield from below.items()
        self.spilled = []


def _merger(keep: str):
    better = max if keep == "largest" else min

    def merge(a, b):
        known = [x for x in (a[0], b[0]) if x is not None]
        return (better(known) if known else None, a[1] + b[1], a[2])

    return merge


_FOLDED = pa.schema([("n_bytes", pa.int64()), ("digest", pa.string()), ("text", pa.large_binary()), ("owner", pa.int64()), ("members", pa.int64())])
_OWNED = pa.schema([("n_bytes", pa.int64()), ("digest", pa.string()), ("owner", pa.int64()), ("members", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + (len(row[2]) if isinstance(row[2], bytes) else 0)
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _fold(keep: str, max_bytes: int):
    """Scan side: rows (digest, text, key) to one row per distinct text of the task."""

    def fold(batches):
        merge = _merger(keep)

        def rows():
            trie = PatriciaTrie(merge, 1 << 62)
            for batch in batches:
                for digest, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                    trie.add(text, (key, 1, digest))
                if trie.held > max_bytes:
                    yield from ((len(t), d, t, k, n) for t, (k, n, d) in trie.items())
                    trie = PatriciaTrie(merge, 1 << 62)
            yield from ((len(t), d, t, k, n) for t, (k, n, d) in trie.items())

        yield from _batches(rows(), _FOLDED)

    return fold


def _own(keep: str, max_bytes: int):
    """Owner side: the folded texts of one partition to one row per distinct text."""

    def own(batches):
        merge = _merger(keep)
        trie = PatriciaTrie(lambda a, b: merge(a, b), max_bytes)
        for batch in batches:
            for digest, text, owner, members in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                trie.add(bytes(text), (owner, members, digest))
        yield from _batches(((len(t), d, k, n) for t, (k, n, d) in trie.items()), _OWNED)

    return own


def owners(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "largest", max_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: n_bytes, digest (sha256, hex), owner (the kept identifier), members."""
    whole = whole_text(text)
    hashed = docs.select(F.sha2(whole, 256).alias("digest"), whole.alias("text"), F.col(key).cast("long").alias("key"))
    folded = hashed.mapInArrow(tidy(_fold(keep, max_bytes)), "n_bytes long, digest string, text binary, owner long, members long")
    dealt = folded.repartition("n_bytes", "digest")
    return dealt.mapInArrow(tidy(_own(keep, max_bytes)), "n_bytes long, digest string, owner long, members long")


def _joined(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    found = owners(docs, key=key, text=text, **how).select(*[F.col(c).alias(f"__own_{c}") for c in ("n_bytes", "digest", "owner", "members")])
    whole = whole_text(text)
    named = docs.withColumn("__own_here", F.sha2(whole, 256)).withColumn("__own_length", F.octet_length(whole).cast("long"))
    return named.join(found, (F.col("__own_length") == F.col("__own_n_bytes")) & (F.col("__own_here") == F.col("__own_digest")))


def _whole_rows(keep: str, max_bytes: int, spills: bool):
    """Rows (digest, text, key, rest) to one such row per distinct text of the task: that of the key that is kept."""

    def better(a, b):
        if a[0] == b[0]:
            return min(a, b, key=lambda x: repr(x[1]))
        if a[0] is None or b[0] is None:
            return b if a[0] is None else a
        return (max if keep == "largest" else min)(a, b, key=lambda x: x[0])

    def run(batches):
        trie, schema = PatriciaTrie(better, max_bytes if spills else 1 << 62), None

        def out():
            held, size = [], 0
            for text, (key, rest, digest) in trie.items():
                held.append((digest, text, key, rest))
                size += 500 + len(text)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

        for batch in batches:
            schema = schema or batch.schema
            for digest, text, key, rest in zip(*(batch.column(i).to_pylist() for i in range(4))):
                trie.add(bytes(text), (key, rest, digest))
            if not spills and trie.held > max_bytes:
                yield from out()
                trie = PatriciaTrie(better, 1 << 62)
        if schema is not None:
            yield from out()

    return run


def distinct_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "largest", max_bytes: int = TRIE_BYTES // 4) -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Texts are shuffled once, each with its row's other columns."""
    whole = whole_text(text)
    rest = F.struct(F.col(f"`{text}`").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    rows = docs.select(F.sha2(whole, 256).alias("digest"), whole.cast("binary").alias("text"), F.col(f"`{key}`").cast("long").alias("key"), rest.alias("rest"))
    folded = rows.mapInArrow(tidy(_whole_rows(keep, max_bytes, False)), rows.schema)
    kept = folded.repartition(F.length("text"), "digest").mapInArrow(tidy(_whole_rows(keep, max_bytes, True)), rows.schema)
    kind = docs.schema[text].dataType
    back = F.when(~F.col("rest.none"), F.col("text").cast("string").cast(kind)).alias(text)
    return kept.select(*[back if c == text else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = _joined(docs, "doc_id", "text", keep="largest")
    return joined.select("doc_id", F.col("__own_owner").alias("keep_id"), F.col("__own_members").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("__own_owner")).alias("kept"), F.col("__own_here").alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
       doc_id = MAX(doc_id) OVER same AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))
"""
