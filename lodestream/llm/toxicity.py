"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its character n-grams (with < and > at its ends), a document
the average of its words, and a linear softmax reads the document vector. Embeddings and softmax are fitted
together by full-batch gradient steps on a bounded sample of labelled documents. Every n-gram of the sample has an
embedding. The many rare ones would be learnt by heart, so an n-gram's embedding is scaled by the evidence for it, a
number between 0 and 1 that grows with how far its share of documents differs between the classes beyond
chance, and the number of steps is the one that is best on a part of the sample that the first fit leaves out.
Since the softmax is linear, a word enters a document's logits by one number per class, which scoring caches per
worker. Misspelt or unseen words share n-grams with known ones and so get their vectors.

Defined cases: a row with a null identifier is held out, as no label is its own; null and empty texts (and texts without a letter or digit) have no words and score the
model's prior; labels of unknown documents and null labels are ignored; without labels of both classes the
score is 0 everywhere; repeated rows score alike, and each counts in the fit; very long texts are scored whole, and
left out of the fit; an empty table gives an empty result; only the key and the text column are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.bpe import slices
from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import held, tidy

#: Labelled documents that the fit uses of each class at most, characters of one of them and of all of a class at most.
FIT_PER_CLASS = 3000
FIT_CHARS, FIT_TOTAL = 100_000, 6_000_000
#: Embedding rows; n-grams share them by hash.
BUCKETS = 1 << 20
NGRAMS = (3, 4, 5, 6)
#: Words whose score a worker remembers (about 120 bytes each).
CACHE_WORDS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The chunks between white space in lower case."""
    return text.lower().split()


def core(chunk: str) -> str:
    """A chunk without what stands around its first and last letter or digit."""
    if chunk.isalnum():
        return chunk
    at = [i for i, c in enumerate(chunk) if c.isalnum()]
    return chunk[at[0] : at[-1] + 1] if at else ""


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's n-grams (flat) and the word that each belongs to."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    rolling = np.zeros(len(codes), np.uint64)
    found, owner = [], []
    for n in range(1, max(NGRAMS) + 1):
        part = codes[n - 1 :] if n > 1 else codes
        rolling = rolling[: len(part)] * np.uint64(0x100000001B3) + part + np.uint64(1)
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(part)] >= n)
            mixed = (rolling[at] + np.uint64(n)) * _MIX
            found.append(((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(44)).astype(np.int64) % BUCKETS)
            owner.append(word[at])
    return np.concatenate(found), np.concatenate(owner)


@dataclass
class Model:
    """gain: per bucket the logit of class 1 less that of class 0; bias: what a document without words has."""

    gain: np.ndarray
    bias: float
    scale: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, owner = ngram_buckets(words)
        total = np.bincount(owner, self.gain[bucket], len(words))
        return total / np.maximum(np.bincount(owner, minlength=len(words)), 1)


class Sample:
    """Labelled texts as two sparse matrices: documents by words, words by n-gram buckets."""

    def __init__(self, texts: list[str], labels: list[int]):
        number: dict[str, int] = {}
        row, col, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, text in enumerate(texts):
            ids = np.array([number.setdefault(c, len(number)) for c in map(core, words_of(text)) if c], np.int64)
            if len(ids):
                word, count = np.unique(ids, return_counts=True)
                row.append(np.full(len(word), i, np.int32))
                col.append(word.astype(np.int32))
                value.append(count / len(ids))
        self.y = np.asarray(labels)
        self.row, self.col, self.value = (np.concatenate(x) for x in (row, col, value))
        self.words = len(number)
        listed, bucket, owner = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        number.clear()
        for at in range(0, len(listed), 20_000):
            part, of = ngram_buckets(listed[at : at + 20_000])
            order = np.argsort(of, kind="stable")
            bucket.append(part[order].astype(np.int32))
            owner.append((of[order] + at).astype(np.int32))
        bucket, owner = np.concatenate(bucket), np.concatenate(owner)
        self.used = np.unique(bucket)
        place = np.zeros(BUCKETS, np.int32)
        place[self.used] = np.arange(len(self.used))
        self.bucket = bucket = place[bucket]
        self.per_word = np.bincount(owner, minlength=self.words)
        self.first = np.cumsum(self.per_word) - self.per_word
        by_bucket = np.argsort(bucket, kind="stable")
        self.word_of = owner[by_bucket]
        times = np.bincount(bucket, minlength=len(self.used))
        self.first_of = np.cumsum(times) - times

    def logits(self, gain: np.ndarray) -> np.ndarray:
        """The average over words of the average over n-grams."""
        word = np.add.reduceat(gain[self.bucket], self.first) / self.per_word
        return np.bincount(self.row, self.value * word[self.col], len(self.y))

    def slope(self, error: np.ndarray) -> np.ndarray:
        """What the errors of the logits are for each bucket's gain."""
        word = np.bincount(self.col, self.value * error[self.row], self.words) / self.per_word
        return np.add.reduceat(word[self.word_of], self.first_of)

    def evidence(self, strength: float) -> np.ndarray:
        """Per bucket x**6 / (x**6 + strength**6): x is by how many standard errors its share of documents differs between classes."""
        share = np.zeros((2, len(self.used)))
        ends = np.searchsorted(self.row, np.arange(len(self.y) + 1))
        for i in range(len(self.y)):
            word = self.col[ends[i] : ends[i + 1]]
            if len(word):
                n = self.per_word[word]
                last = np.cumsum(n)
                share[self.y[i], np.unique(self.bucket[np.repeat(self.first[word] - (last - n), n) + np.arange(last[-1])])] += 1
        each = np.bincount(self.y, minlength=2)
        both = share.sum(0) / len(self.y)
        error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / each).sum())
        x = np.where(share.sum(0) > 1, np.abs(share[1] / each[1] - share[0] / each[0]) / error, 0) ** 6
        return x / (x + strength**6)


def _descend(sample: Sample, evidence: np.ndarray, out: np.ndarray, steps: int, patience: int, width: int, rate: float, scale: float, seed: int) -> tuple[int, np.ndarray, float]:
    """Adam on the weighted log loss of the documents that are not out; the step that was best on those, its gains and bias.

    Without documents out, all steps are made and the last one counts.
    """
    y, n = sample.y, len(sample.used)
    random = np.random.default_rng(seed)
    params = {"embed": np.zeros((n, width), np.float32), "soft": random.normal(0, width**-0.5, (width, 2)).astype(np.float32), "bias": np.zeros(2)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.sqrt(1 / (np.bincount(y[~out], minlength=2) / (~out).sum()))[y]
    inner, outer = np.where(out, 0, weight), np.where(out, weight, 0)
    inner /= inner.sum()
    best = (0, np.zeros(n), 0.0, np.inf)
    for step in range(1, steps + 1):
        logit = evidence * (params["embed"] @ (params["soft"][:, 1] - params["soft"][:, 0]))
        bias = float(params["bias"][1] - params["bias"][0])
        p = 1 / (1 + np.exp(-np.clip(scale * sample.logits(logit) + bias, -50, 50)))
        loss = float((-np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12)) * outer).sum())
        if not out.any() or loss < best[3] - 1e-4:
            best = (step, logit, bias, loss)
        elif step - best[0] > patience:
            break
        error = (p - y) * inner
        back = (evidence * sample.slope(error) * scale).astype(np.float32)
        both = np.stack([-back, back], 1)
        slope = {"embed": both @ params["soft"].T, "soft": params["embed"].T @ both, "bias": np.array([-error.sum(), error.sum()])}
        for k, g in slope.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return best[:3]


def fit(texts: list[str], labels: list[int], *, width: int = 4, steps: int = 120, patience: int = 15, rate: float = 0.1, scale: float = 40.0, strength: float = 5.0, seed: int = 7) -> Model:
    """Embeddings (width numbers a bucket) and softmax (width x 2) together; see the module's text."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), -50.0, scale)
    sample = Sample(texts, labels)
    gain = np.zeros(BUCKETS)
    if not sample.words:
        share = float(np.mean(sample.y))
        return Model(gain, float(np.log(share / (1 - share))), scale)
    evidence, none = sample.evidence(strength), np.zeros(len(labels), bool)
    out = np.zeros(len(labels), bool)  # every fifth document of each class
    for k in (0, 1):
        out[np.flatnonzero(sample.y == k)[4::5]] = True
    how = (width, rate, scale, seed)
    if out[sample.y == 0].any() and out[sample.y == 1].any():
        steps = max(1, _descend(sample, evidence, out, steps, patience, *how)[0])
    else:
        steps = min(steps, 40)
    _, gain[sample.used], bias = _descend(sample, evidence, none, steps, patience, *how)
    return Model(gain, bias, scale)


def _name(model: bytes) -> tuple:
    return ("scores", hashlib.sha256(model).digest())


class Scorer:
    """Scores texts with the words' cache of one Python worker."""

    def __init__(self, model: Model, name):
        self.model = model
        self.known: dict[str, float | None] = held(name, dict)

    def scores(self, texts: list[str]) -> np.ndarray:
        cut = [words_of(t) for t in texts]
        new = [c for c in set().union(*cut) if c not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set().union(*cut))
        for at in range(0, len(new), 200_000):
            part = new[at : at + 200_000]
            cores = [core(c) for c in part]
            real = [i for i, c in enumerate(cores) if c]
            # a chunk without a word stands out by None, and does not count in the average
            self.known.update(dict.fromkeys(part))
            if real:
                self.known.update(zip([part[i] for i in real], self.model.word_scores([cores[i] for i in real]).tolist()))
        logit = np.empty(len(texts))
        known = self.known
        for i, chunks in enumerate(cut):
            got = [x for x in map(known.__getitem__, chunks) if x is not None]
            logit[i] = self.model.bias + self.model.scale * (sum(got) / len(got) if got else 0.0)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = FIT_PER_CLASS, **how) -> Model:
    """Fit on at most per_class labelled documents of each class and FIT_TOTAL characters, the first by a hash of their key."""
    known = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)")
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(per_class) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])  # at most 2 x per_class rows of two numbers: safe to broadcast
    texts = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"), F.xxhash64(F.col(key).cast("long")).alias("order")).filter(F.length("text") <= FIT_CHARS)
    # of each class as many, in the order of the hash, as the total takes; equal keys count once each
    listed = texts.join(F.broadcast(chosen), "key").select("key", "label", "order", F.length("text").alias("size"), F.xxhash64("text").alias("at"))
    sizes = listed.orderBy("order", "key", "at").limit(4 * per_class).toPandas()
    taken = sizes[sizes.groupby("label")["size"].cumsum() <= FIT_TOTAL]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(pa.table({"key": pa.array(taken["key"], pa.int64()), "label": pa.array(taken["label"], pa.int32()), "at": pa.array(taken["at"], pa.int64())})).distinct()
    rows = texts.withColumn("at", F.xxhash64("text")).join(F.broadcast(wanted), ["key", "at"]).select("key", "label", "text", "order").limit(4 * per_class).toArrow().to_pydict()
    order = sorted(range(len(rows["key"])), key=lambda i: (rows["order"][i], rows["key"][i], rows["label"][i], rows["text"][i]))
    return fit([rows["text"][i] for i in order], [rows["label"][i] for i in order], **how)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps((model.gain.astype(np.float32), model.bias, model.scale)))  # 4 MB, fixed

    def run(batches) -> Iterator[pa.RecordBatch]:
        gain, bias, scale = pickle.loads(sent.value)
        scorer = Scorer(Model(gain.astype(np.float64), bias, scale), _name(sent.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                keys = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([keys, pa.array(scorer.scores(texts[part]), pa.float64())], names=["key", "score"])

    source = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return source.mapInArrow(tidy(run, keep_cache=True), f"key {source.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps((model.gain.astype(np.float32), model.bias, model.scale)))
    at = docs.columns.index(text)

    def run(batches) -> Iterator[pa.RecordBatch]:
        gain, bias, scale = pickle.loads(sent.value)
        scorer = Scorer(Model(gain.astype(np.float64), bias, scale), _name(sent.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for part in slices(texts):
                clean = scorer.scores(texts[part]) < threshold
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(clean))

    return docs.mapInArrow(tidy(run, keep_cache=True), docs.schema)


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from; those without an identifier are among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
