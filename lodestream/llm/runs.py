"""Periodic runs of words by Crochemore's partition refinement.

Two positions are in one class of length l if the l words from them on are equal. The classes of length l + 1 come from
those of length l: positions part where the classes of their right neighbours part. Neighbouring members of a class of
length l that stand l apart are a square of primitive period l; squares at consecutive positions merge into a run. Of
a class that splits, its largest part keeps the old name and only the smaller ones are looked at for the next length,
so a position is looked at a logarithmic number of times however long its repeats are.

A run of at least TIMES = 4 periods has three or more members in every class that its squares need, so classes of
fewer members are dropped, and with them whatever stands to their left in longer classes. The first HEAD lengths, where
every class is new, are refined by sorting, for all documents of a batch at once; hardly any word outlives them but in
texts that do repeat themselves, which then go on one by one, up to a quarter of their words.

A run is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, TIMES * q) that no
neighbouring word extends. Runs may overlap. Collapsing drops each word that any run contains after the run's first q words,
and joins the rest by one space.

Defined cases: a null or empty text and one without words have no run and collapse to the empty string; texts of fewer
than LEAST words have no run. Words are told apart byte by byte. Repeated rows and null or repeated keys are documents of
their own; a null doc_id is never rewritten by op12's planting. Very long texts are read whole; a text is worked on by one task, at some 250 bytes
for a word that repeats and 80 for others. An empty table gives an empty result; only key and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.bpe import slices
from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import tidy

LEAST, TIMES = 6, 4
#: Factor lengths that are refined by sorting; no more than 2 periods of the shortest runs, so that every run outlives them: see heads().
HEAD = 4
#: Members without which a class holds no square of a run.
MEMBERS = 3
SPANS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def merged(squares: np.ndarray, period: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of the ascending positions of squares of one period."""
    if not len(squares):
        return
    ends = np.flatnonzero(np.diff(squares, append=-2) != 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = squares[ends] - squares[starts] + 2 * period
    kept = lengths >= max(LEAST, TIMES * period)
    for start, length in zip(squares[starts[kept]].tolist(), lengths[kept].tolist()):
        yield start, length, period


def heads(classes: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The runs of periods up to HEAD, and the classes of length HEAD (-1: none) of every position.

    classes has for each position a number that equal words of one document share, and -1 behind each document.
    A run of period q has classes of MEMBERS up to the length 2 q, and those of 6 words or more of period 1 up to 4.
    """
    found: list[tuple[int, int, int]] = []
    for length in range(1, HEAD + 1):
        at = np.flatnonzero(classes >= 0)
        if length > 1:
            at = at[classes[at + 1] >= 0]
            pairs = classes[at] * len(classes) + classes[at + 1]
        else:
            pairs = classes[at]
        order = np.argsort(pairs, kind="stable")
        at, pairs = at[order], pairs[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        members = np.diff(first, append=len(pairs))
        names, large = np.repeat(at[first], members), np.repeat(members >= MEMBERS, members)
        at, names = at[large], names[large]
        classes = np.full(len(classes), -1, np.int64)
        classes[at] = names
        square = (np.diff(at) == length) & (np.diff(names) == 0)
        found += merged(np.sort(at[:-1][square]), length)
    return found, classes


class Refinement:
    """The classes of one document, by length; smaller parts only are looked at again."""

    def __init__(self, classes: np.ndarray, length: int):
        """classes of positions at this length, -1 where none; the last entry stands behind the last word and is -1."""
        self.length, self.most = length, (len(classes) - 1) // TIMES
        self.name = classes.tolist()
        self.after, self.before = [-1] * len(classes), [-1] * len(classes)
        self.members: dict[int, set[int]] = {}
        self.due: dict[int, list[int]] = {}
        live = np.flatnonzero(classes >= 0)
        order = live[np.argsort(classes[live], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(classes[order])) + 1) if len(order) else []:
            self._found(int(classes[part[0]]), part.tolist())
        self.fresh = len(classes)
        self.split = live.tolist()
        self.dead = np.flatnonzero(classes < 0).tolist()

    def _gap(self, at: int) -> None:
        """Squares are looked for only at the length that a gap has reached."""
        gap = self.after[at] - at
        if self.length < gap <= self.most:
            self.due.setdefault(gap, []).append(at)

    def _found(self, name: int, part: list[int]) -> None:
        """A class of ascending positions."""
        self.members[name] = set(part)
        before = -1
        for at in part:
            self.name[at], self.before[at] = name, before
            if before >= 0:
                self.after[before] = at
                self._gap(before)
            before = at
        self.after[before] = -1

    def _unlink(self, at: int) -> None:
        before, after = self.before[at], self.after[at]
        if after >= 0:
            self.before[after] = before
        if before >= 0:
            self.after[before] = after
            if after >= 0:
                self._gap(before)

    def _drop(self, part: list[int] | set[int], dead: list[int]) -> None:
        for at in part:
            self.name[at] = -1
        dead.extend(part)

    def longer(self) -> None:
        """From the classes of one length to those of the next."""
        name, members = self.name, self.members
        leaving: dict[int, list[int]] = {}
        parts: dict[int, dict[int, list[int]]] = {}
        for j in self.dead:
            if j and name[j - 1] >= 0:
                leaving.setdefault(name[j - 1], []).append(j - 1)
        for j in self.split:
            if j and name[j - 1] >= 0:
                parts.setdefault(name[j - 1], {}).setdefault(name[j], []).append(j - 1)
        self.length += 1
        split: list[int] = []
        dead: list[int] = []
        for own, gone in leaving.items():
            for at in gone:
                self._unlink(at)
            members[own].difference_update(gone)
            self._drop(gone, dead)
            parts.setdefault(own, {})
        for own, by_right in parts.items():
            found = list(by_right.values())
            rest = len(members[own]) - sum(map(len, found))
            if found and rest < (largest := max(map(len, found))):
                keep = next(i for i, part in enumerate(found) if len(part) == largest)
                kept = found.pop(keep)
                if rest:
                    found.append(list(members[own].difference(kept, *found)))
            for part in found:
                for at in part:
                    self._unlink(at)
                members[own].difference_update(part)
                if len(part) < MEMBERS:
                    self._drop(part, dead)
                else:
                    self._found(self.fresh, sorted(part))
                    self.fresh += 1
                    split.extend(part)
            if len(members[own]) < MEMBERS:
                self._drop(members.pop(own), dead)
        self.split, self.dead = split, dead

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """Runs of periods above the length that the classes have at first."""
        while self.members and self.length < self.most:
            self.longer()
            due = self.due.pop(self.length, None)
            if due:
                squares = {at for at in due if self.name[at] >= 0 and self.after[at] - at == self.length}
                yield from merged(np.array(sorted(squares), np.int64), self.length)


def periodic_runs(texts: list[str]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Per text its words and its runs (start, length, period), by start and period."""
    # Python splits bytes at space and the controls tab to carriage return, and at nothing else
    words = [text.encode("utf-8", "surrogatepass").split() for text in texts]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    classes = np.full(starts[-1], -1, np.int64)
    for w, start in zip(words, starts.tolist()):
        first_at = {}.setdefault  # a word's number is its first position
        classes[start : start + len(w)] = np.fromiter(map(first_at, w, count(start)), np.int64, len(w))
    short, classes = heads(classes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    owners = np.searchsorted(starts, [s for s, _, _ in short], "right") - 1
    for owner, (start, length, period) in zip(owners.tolist(), short):
        found[owner].append((start - int(starts[owner]), length, period))
    for owner in np.unique(np.searchsorted(starts, np.flatnonzero(classes >= 0), "right") - 1).tolist():
        own = classes[starts[owner] : starts[owner + 1]]
        found[owner] += Refinement(np.where(own < 0, own, own - starts[owner]), HEAD).runs()
    return [(w, sorted(f, key=lambda run: (run[0], run[2]))) for w, f in zip(words, found)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by one space."""
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def detect(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: the key, runs (start, length, period by start and period) and the collapsed text."""
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                found = periodic_runs(texts[part])
                spans = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs in found], pa.list_(span))
                kept = pa.array([collapsed(*f) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), spans, kept], names=["key", "runs", "collapsed"])

    source = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"key {kind}, runs {SPANS}, collapsed string").withColumnRenamed("key", key)


def planted(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text; a tenth of the documents, by a hash of the key, repeat some of their words periodically to the end.

    With h = crc32(key), g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, word i >= a = g % n becomes word
    a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)).
    """
    hashed = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn("h", F.crc32(F.col("key").cast("string").cast("binary")))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    g, n = F.floor(F.col("h") / 10), F.size("words")
    numbered = hashed.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    numbered = numbered.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))

    def periodic(word: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), word).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    return numbered.select(F.col("key").alias(key), F.coalesce(F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", periodic), " ")), F.col("text")).alias(text))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    greatest = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", greatest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH numbers AS (
  SELECT ROW_NUMBER() OVER () AS k, doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
hashed AS (SELECT k, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS rewritten, (h // 10) % CASE WHEN len(w) = 0 THEN 1 ELSE len(w) END AS a, (h // 10) % 8 AS turn FROM numbers),
planted AS (
  SELECT k, doc_id, n, CASE WHEN rewritten THEN list_transform(w, lambda word, i: CASE WHEN i - 1 < a THEN word ELSE w[1 + a + (i - 1 - a) % (1 + (n - a) // (3 + turn))] END) ELSE w END AS w FROM hashed),
words AS (SELECT k, n, UNNEST(range(0, n)) AS i, UNNEST(w) AS word FROM planted),
triples AS (SELECT k, n, i, word, LEAD(word) OVER line AS next, LEAD(word, 2) OVER line AS third FROM words WINDOW line AS (PARTITION BY k ORDER BY i)),
equals AS (
  SELECT x.k, y.i - x.i AS q, x.i FROM triples x JOIN triples y ON x.k = y.k AND x.word = y.word AND x.next = y.next AND x.third = y.third
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT k, q, i, i - ROW_NUMBER() OVER (PARTITION BY k, q ORDER BY i) AS island FROM equals),
stretches AS (SELECT k, q, MIN(i) AS s, COUNT(*) + 2 + q AS length FROM islands GROUP BY k, q, island HAVING COUNT(*) + 2 + q >= GREATEST(6, 4 * q)),
runs AS (
  SELECT k, q, s, length FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.k = x.k AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.length >= x.s + x.length)),
kept AS (SELECT w.k, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN runs r ON w.k = r.k AND w.i >= r.s + r.q AND w.i < r.s + r.length GROUP BY w.k),
listed AS (SELECT k, COUNT(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY k),
best AS (SELECT k, s, length, q FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / q DESC, s, q) = 1)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli,
       sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(text, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""
