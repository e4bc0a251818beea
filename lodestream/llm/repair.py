"""Token ids in files compressed by Re-Pair grammars, written and read back shard by shard.

Documents are dealt by ranges of their key, and of a text hash within it, and sorted, so the files hold them in ascending order. A task cuts
its documents into shards of bounded size. A shard's ids are one sequence: round by round, adjacent pairs that
occur LEAST_COUNT times or more become nonterminals, where two overlap the more frequent one, until no pair is left
whose rule saves bytes. Pairs never cross a document's edge. A file keeps the rules, each rule's expansion length,
and the symbols of every document, so any token range of a document is decoded without the rest.

Ids are those of the tokenizers library. Its pattern, ranks and special tokens are run by tiktoken, which is five times
as fast; tests hold both against each other on every code point and on mixed white space. A text that tiktoken's
pattern engine gives up on (some hundred thousand white space characters in a row) goes to the tokenizers library.

Defined cases: null text counts as empty (only the end id); rows that share a key are separate documents in the
order of a hash of their texts (so that many of them are dealt to several tasks), equal rows are written once each; null keys come first; a very long text is a shard of its own;
an empty table gives no files and an empty result; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import held, tidy
from lodestream.session import cut, scratch

#: Bytes of text in one shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of a symbol in a file, of a rule (two symbols and its length), and the least occurrences with which a rule
#: saves more than it takes.
SYMBOL_BYTES, RULE_BYTES = 3, 10
LEAST_COUNT = RULE_BYTES // SYMBOL_BYTES + 1
#: Bits of the table of pairs in the first rounds and from then on.
TABLE_BITS = (16, 18)

MAGIC = b"RPT2"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass
class Grammar:
    """rules: the two symbols of each nonterminal; nonterminal k is symbol terminals + k; rounds: how many each round added."""

    terminals: int
    rules: np.ndarray
    rounds: np.ndarray

    def _levels(self) -> Iterator[tuple[int, int]]:
        ends = np.cumsum(self.rounds)
        yield from zip((ends - self.rounds).tolist(), ends.tolist())

    def lengths(self) -> np.ndarray:
        """Terminals that each symbol expands to."""
        out = np.ones(self.terminals + len(self.rules), np.int64)
        for a, b in self._levels():
            out[self.terminals + a : self.terminals + b] = out[self.rules[a:b]].sum(axis=1)
        return out

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols' expansions in one array, where each begins, and its length."""
        length = self.lengths()
        start = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.uint32)
        flat[: self.terminals] = np.arange(self.terminals)
        for a, b in self._levels():
            parts = self.rules[a:b].ravel()
            at = int(start[self.terminals + a])
            made = gather(flat, start[parts], length[parts])
            flat[at : at + len(made)] = made
        return flat, start, length

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The terminals of a few symbols, rule by rule from the top."""
        while len(found := np.flatnonzero(symbols >= self.terminals)):
            times = np.ones(len(symbols), np.int64)
            times[found] = 2
            at = (np.cumsum(times) - times)[found]
            rules = self.rules[symbols[found] - self.terminals]
            symbols = np.repeat(symbols, times)
            symbols[at], symbols[at + 1] = rules[:, 0], rules[:, 1]
        return symbols


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]


def learn(symbols: np.ndarray, last: np.ndarray, terminals: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of a sequence, the sequence in it, and which of its symbols end a document, as last tells at first.

    A round counts pairs in a table of hashes, where a pair that meets another one in its slot waits for the next round and
    another hash. Places whose pair is known to be too rare are closed; a new nonterminal opens those beside it.
    """
    rules, rounds, made, turn = [], [], 0, 0
    symbols, last = symbols.astype(np.uint32), last.copy()
    open_ = ~last
    while len(at := np.flatnonzero(open_)):
        bits = TABLE_BITS[min(turn, len(TABLE_BITS) - 1)]
        pair = np.empty((len(at), 2), np.uint32)
        pair[:, 0], pair[:, 1] = symbols[at], symbols[at + 1]
        slot = pair[:, 0] * np.uint32((0x9E3779B1 + 2 * turn) & 0xFFFFFFFF) + pair[:, 1] * np.uint32((0x85EBCA6B + 4 * turn) & 0xFFFFFFFF)
        slot ^= slot >> np.uint32(15)
        slot *= np.uint32(0x2C1B3C6D)
        slot >>= np.uint32(32 - bits)
        turn += 1
        key = pair.view(np.uint64).ravel()
        holder = np.empty(1 << bits, np.uint64)
        holder[slot] = key
        mine = holder[slot] == key
        at, slot = at[mine], slot[mine]
        count = np.bincount(slot, minlength=1 << bits)
        often = count[slot] >= LEAST_COUNT
        open_[at[~often]] = False
        at, slot = at[often], slot[often]
        # of two neighbours the more frequent pair is replaced; equal pairs in a row every other time
        weight = count[slot] << 32 | slot
        beside = at[1:] == at[:-1] + 1
        chosen = np.ones(len(at), bool)
        chosen[1:] &= ~(beside & (weight[1:] < weight[:-1]))
        chosen[:-1] &= ~(beside & (weight[:-1] < weight[1:]))
        judged, at, slot = at, at[chosen], slot[chosen]
        follows = np.concatenate([[False], at[1:] == at[:-1] + 1])[: len(at)]
        if follows.any():
            number = np.arange(len(at))
            even = (number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0
            at, slot = at[even], slot[even]
        used = np.bincount(slot, minlength=1 << bits) >= LEAST_COUNT
        at, slot = at[used[slot]], slot[used[slot]]
        if not len(at):
            open_[judged] = False
            continue
        rules.append(holder[used].view(np.uint32).reshape(-1, 2))
        number = (np.cumsum(used) - 1 + terminals + made).astype(np.uint32)
        rounds.append(len(rules[-1]))
        made += rounds[-1]
        symbols[at] = number[slot]
        last[at] = last[at + 1]
        for beside in (at, (at - 1)[at > 0]):
            open_[beside] = ~last[beside]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, last, open_ = symbols[stays], last[stays], open_[stays]
    return Grammar(terminals, np.concatenate([np.zeros((0, 2), np.uint32), *rules]), np.array(rounds, np.int64)), symbols, last


def symbol_bytes(symbols: int) -> int:
    """Bytes of a symbol in the file of a shard that has so many different ones: terminals and rules, which its head gives."""
    return SYMBOL_BYTES if symbols <= 1 << 8 * SYMBOL_BYTES else 4


def _narrow(symbols: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _wide(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<u4").ravel()


def pack(grammar: Grammar, keys: list, symbols: np.ndarray, per_doc: np.ndarray, tokens: np.ndarray) -> bytes:
    """A shard's file: sizes, rules by round, their lengths, keys, symbols and tokens of each document, symbols."""
    head = MAGIC + struct.pack("<IIIIQ", grammar.terminals, len(grammar.rules), len(grammar.rounds), len(keys), len(symbols))
    width = symbol_bytes(grammar.terminals + len(grammar.rules))
    known = np.array([k is not None for k in keys], np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    return b"".join([head, grammar.rounds.astype("<u4").tobytes(), _narrow(grammar.rules.ravel(), width), grammar.lengths()[grammar.terminals :].astype("<u4").tobytes(), known.tobytes(), numbers.tobytes(), per_doc.astype("<u8").tobytes(), tokens.astype("<u8").tobytes(), _narrow(symbols, width)])


class Shard:
    """A file read back; documents are decoded one by one or by token range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        terminals, n_rules, n_rounds, n_docs, n_symbols = struct.unpack_from("<IIIIQ", data, 4)
        at = 4 + struct.calcsize("<IIIIQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        rounds = take("<u4", n_rounds).astype(np.int64)
        width = symbol_bytes(terminals + n_rules)
        rules = _wide(take("u1", 2 * n_rules * width), width).reshape(-1, 2)
        self.grammar = Grammar(terminals, rules, rounds)
        self.length = np.concatenate([np.ones(terminals, np.int64), take("<u4", n_rules)])
        known, numbers = take("u1", n_docs), take("<i8", n_docs)
        self.keys = [int(k) if ok else None for k, ok in zip(numbers, known)]
        self.per_doc, self.tokens = take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        self.symbols = _wide(take("u1", n_symbols * width), width)
        self.first = np.cumsum(self.per_doc) - self.per_doc

    def ids(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of a document, or those from start to stop, from the symbols that cover them alone."""
        own = self.symbols[self.first[document] : self.first[document] + self.per_doc[document]]
        ends = np.cumsum(self.length[own])
        stop = int(self.tokens[document]) if stop is None else stop
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.grammar.expand(own[a:b])[start - before : stop - before]

    def all_ids(self) -> np.ndarray:
        flat, begin, length = self.grammar.expansions()
        return gather(flat, begin[self.symbols], length[self.symbols])


class Tokens:
    """The ids of texts, as the tokenizers library gives them."""

    def __init__(self, spec: str, ranks: str, pattern: str):
        import tiktoken

        self.spec = spec
        wanted = json.loads(spec)
        special = {t["content"]: t["id"] for t in wanted["added_tokens"]}
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(k) for t, k in pairs}, special_tokens=special)
        self.terminals = max(self.fast.max_token_value, *wanted["model"]["vocab"].values()) + 1
        self._library = None

    @property
    def library(self):
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except ValueError:  # its pattern engine has no room left
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def shard(self, keys: list, texts: list[str], end_id: int) -> tuple[bytes, int]:
        """The file of these documents, and the tokens in it."""
        parts = [self.ids(t) if t else np.zeros(0, np.uint32) for t in texts]
        tokens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(tokens) - 1
        symbols, last = np.empty(int(tokens.sum()), np.uint32), np.zeros(int(tokens.sum()), bool)
        inner = ~last
        inner[ends] = False
        symbols[inner], symbols[ends], last[ends] = np.concatenate(parts), end_id, True
        del parts, inner
        grammar, symbols, last = learn(symbols, last, self.terminals)
        per_doc = np.diff(np.flatnonzero(last), prepend=-1)
        return pack(grammar, keys, symbols, per_doc, tokens), int(tokens.sum())


def _writer(files, end_id: int, shard_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        coder = held(("tokens", *map(zlib.crc32, map(str.encode, files.value))), lambda: Tokens(*files.value))
        part, at = TaskContext.get().partitionId(), 0
        keys: list = []
        texts: list[str] = []
        size = 0

        def flush():
            nonlocal keys, texts, size, at
            data, tokens = coder.shard(keys, texts, end_id)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([tokens], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "tokens", "data"])
            keys, texts, size, at = [], [], 0, at + 1
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                if size and size + len(raw) > shard_bytes:
                    yield flush()
                keys.append(key)
                texts.append(raw.decode("utf-8", "replace"))
                size += len(raw) + 1
        if keys:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, vocabulary: str | None = None, ranks: str | None = None, pattern: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the documents' ids into folder: one row per shard, its file in the column data.

    vocabulary is the tokenizers library's file; ranks and pattern are the same in tiktoken's form.
    """
    files = []
    for path in (vocabulary or default_vocabulary(), ranks or default_ranks()):
        with open(path, encoding="utf-8") as f:
            files.append(f.read())
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    spec = docs.sparkSession.sparkContext.broadcast((*files, pattern))
    source = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    # the hash parts a key that holds very many rows
    ranged = source.repartitionByRange("key", "hash").sortWithinPartitions("key", "hash", "text").drop("hash")
    ranged.mapInArrow(tidy(_writer(spec, end_id, shard_bytes), keep_cache=True), "part int, shard int, tokens long, data binary").write.parquet(folder)


def read(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """Per document of the files: key, start (ids before it in all files), n_tokens, ids_crc32 and, if asked, ids."""
    files = spark.read.parquet(folder)
    totals = cut(files.select("part", "shard", "tokens"))
    running = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the write had partitions
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = totals.withColumn("inner", F.coalesce(F.sum("tokens").over(running), F.lit(0))).join(before, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("offset"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = Shard(data)
                ids = shard.all_ids().astype("<u4")
                ends = np.cumsum(shard.tokens)
                starts = ends - shard.tokens
                spans = list(zip(starts.tolist(), ends.tolist()))
                columns = [pa.array([part] * len(spans), pa.int32()), pa.array([number] * len(spans), pa.int32()), pa.array(shard.keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.tokens, pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64())]
                names = ["part", "shard", "key", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, shard int, key long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = files.select("part", "shard", "data").mapInArrow(tidy(run), schema)
    return found.join(offsets, ["part", "shard"]).select("key", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder, with_ids=False).withColumnRenamed("key", "doc_id")
