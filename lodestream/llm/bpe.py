"""Encoding and decoding with a word-level byte-pair vocabulary, in batched numpy merge rounds.

A text is normalised and cut into the chunks between white space, which no token crosses. Chunks that
a task has met before come from a bounded cache; the others are split into words, and all words of a
batch lie in one flat array of symbols. In each round every word merges its lowest-ranked adjacent pair;
ranks are found by binary search over the sorted pair keys, and only next to the last round's merges.

Defined cases: null text counts as empty (no ids, empty decoded text); the vocabulary's special strings
in a text become their ids, as in the tokenizers library; repeated rows are encoded alike; an empty table
gives an empty result; only the key and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import held, tidy

#: Chunks that a worker remembers; at about 400 bytes each this bounds the cache by some 160 MB.
CACHE_CHUNKS = 250_000
#: Characters of text that one round of batching takes.
BATCH_CHARS = 1 << 20
#: New words that share one flat symbol array.
WORDS_AT_ONCE = 250_000

#: Unicode White_Space, as the vocabulary's patterns understand it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class WordBpe:
    """A vocabulary file read into sorted pair keys, ranks and merged ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        self.token = [""] * self.size
        for token, i in vocab.items():
            self.token[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.arange(len(merges), dtype=np.int32)[order], _NONE)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (non-empty) words one after the other, and where each word's begin."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ids[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        rank = np.full(len(ids), _NONE, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        done_ids, done_word = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            open_word = least < _NONE
            if not open_word.all():
                closed = np.repeat(~open_word, count)
                done_ids.append(ids[closed])
                done_word.append(word[closed])
                ids, word, rank = ids[~closed], word[~closed], rank[~closed]
                count, least = count[open_word], least[open_word]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            follows = np.append(False, at[1:] == at[:-1] + 1)
            if follows.any():  # of overlapping pairs (aaa) every second one merges, from the left
                run_start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            fresh = np.zeros(len(ids), bool)
            fresh[at] = True
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            ids, word, rank, fresh = ids[~gone], word[~gone], rank[~gone], fresh[~gone]
            look = np.flatnonzero(fresh | np.append(fresh[1:], False))
            rank[look] = _NONE
            look = look[look + 1 < len(ids)]
            look = look[word[look] == word[look + 1]]
            rank[look] = self._rank(ids[look], ids[look + 1])
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.append(0, np.cumsum(np.bincount(all_words, minlength=len(words))))


class Encoder:
    """Texts to ids and back, with the cache of one Python worker."""

    def __init__(self, spec_text: str, cache_chunks: int = CACHE_CHUNKS):
        spec = json.loads(spec_text)
        self.bpe, self.cache_chunks = WordBpe(spec), cache_chunks
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.space = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.specials = re.compile("|".join(map(re.escape, self.bpe.special))) if self.bpe.special else None
        self.numbers = np.array([str(i) for i in range(self.bpe.size)], object)
        self.names = np.array(self.bpe.token, object)
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # each character is lowered on its own
        text = text.lower()
        if self.odd.search(text):
            return [x for x in self.space.split(text) if x]
        return text.split()

    def chunks(self, text: str) -> list[str]:
        """What lies between white space, normalised; special strings stay as they are, behind a NUL-free mark."""
        if self.specials is None or not self.specials.search(text):
            return self._chunks(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self._chunks(text[at : found.start()])
            out.append(f"\n{found[0]}")  # no other chunk holds white space
            at = found.end()
        return out + self._chunks(text[at:])

    def learn(self, chunks: Iterable[str]) -> None:
        """Put the chunks that the cache lacks into it."""
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.cache_chunks:
            self.ids.clear()
            self.tokens.clear()
            new = list(chunks)
        split = [(c,) if c.isalpha() else self.words.findall(c) if c[0] != "\n" else () for c in new]
        unique = list({w for words in split for w in words})
        ids_of: dict[str, str] = {}
        tokens_of: dict[str, str] = {}
        for at in range(0, len(unique), WORDS_AT_ONCE):
            part = unique[at : at + WORDS_AT_ONCE]
            flat, starts = self.bpe.encode_words([w.encode() for w in part])
            numbers, tokens, starts = self.numbers[flat].tolist(), self.names[flat].tolist(), starts.tolist()
            for word, a, b in zip(part, starts, starts[1:]):
                if b - a == 1:
                    ids_of[word], tokens_of[word] = numbers[a], tokens[a]
                else:
                    ids_of[word], tokens_of[word] = " ".join(numbers[a:b]), " ".join(tokens[a:b])
        for chunk, words in zip(new, split):
            if chunk[0] == "\n":
                self.ids[chunk], self.tokens[chunk] = str(self.bpe.special[chunk[1:]]), chunk[1:]
            elif len(words) == 1:
                self.ids[chunk], self.tokens[chunk] = ids_of[words[0]], tokens_of[words[0]]
            else:
                self.ids[chunk] = " ".join([ids_of[w] for w in words])
                self.tokens[chunk] = " ".join([tokens_of[w] for w in words])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text its decimal ids and its decoded text, each joined by one space."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set().union(*cut) if cut else ())
        ids, tokens = self.ids, self.tokens
        for chunks in cut:
            yield " ".join([ids[c] for c in chunks]), " ".join([tokens[c] for c in chunks])


def encoder(spec_text: str) -> Encoder:
    """The worker's encoder for this vocabulary; it outlives the task, and so does its cache."""
    return held(("encoder", hashlib.sha256(spec_text.encode()).hexdigest()), lambda: Encoder(spec_text))


def slices(texts: list[str], most: int = BATCH_CHARS) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


_OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), vocabulary: str | None = None) -> DataFrame:
    """Per row of docs the key and the outputs asked for: n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    vocabulary is the driver's path of the vocabulary file; executors get its contents by broadcast (under 2 MB).
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    wanted = list(outputs)
    schema = pa.schema([(o, _ARROW[o]) for o in wanted])
    make = {
        "n_tokens": lambda ids, decoded: ids.count(" ") + 1 if ids else 0,
        "ids": lambda ids, decoded: np.fromstring(ids, np.int32, sep=" "),
        "decoded": lambda ids, decoded: decoded,
        "ids_sha256": lambda ids, decoded: hashlib.sha256(ids.encode()).hexdigest(),
        "decoded_sha256": lambda ids, decoded: hashlib.sha256(decoded.encode()).hexdigest(),
    }

    def run(batches):
        own = encoder(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                columns = {o: [] for o in wanted}
                for ids, decoded in own.encode(texts[part]):
                    for o in wanted:
                        columns[o].append(make[o](ids, decoded))
                keys = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(columns[f.name], f.type) for f in schema)], names=["key", *wanted])

    source = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(tidy(run, keep_cache=True), f"key {kind}, " + ", ".join(f"{o} {_OUTPUTS[o]}" for o in wanted)).withColumnRenamed("key", key)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
