"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import time
import zlib

import pyarrow.parquet as pq
import pytest

from lodestream.llm import runs
from lodestream.llm.registry import queries


def brute_runs(words):
    """Every maximal stretch whose smallest period is q, by definition."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                least = next(p for p in range(1, q + 1) if all(words[x] == words[x + p] for x in range(i, i + length - p)))
                if least == q:
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_text(random_, letters):
    out = []
    for _ in range(random_.randint(1, 4)):
        out += [random_.choice(letters) for _ in range(random_.randint(0, 12))]
        unit = [random_.choice(letters) for _ in range(random_.choice([1, 1, 2, 3, 4, 5, 6, 7, 9, 13, 20]))]
        out += (unit * 9)[: random_.randint(0, 9 * len(unit))]
        if out and random_.random() < 0.3:
            out = (out * random_.randint(2, 5))[:400]
    return " ".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_search_of_all_periods(seed):
    random_ = random.Random(seed)
    letters = ["a", "b", "é", "c\x1cd", "A", "d"][: 2 + seed]
    texts = ["", " \t", "a", "a " * 6, "a " * 5, "a b " * 4, "a b a b a b a", *(random_text(random_, letters) for _ in range(150))]
    found = runs.periodic_runs(texts)
    assert [[w.decode() for w in words] for words, _ in found] == [words_of(t) for t in texts]
    for text, (words, got) in zip(texts, found):
        expected = brute_runs(words_of(text))
        assert got == expected, text
        assert runs.collapsed(words, got) == brute_collapsed(words_of(text), expected)


def test_fibonacci_words_and_nested_runs():
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, a
    nested = ("x y " * 5 + "z ") * 7 + "q " + ("x y " * 5 + "z ") * 5
    for text in (" ".join(a), nested, " ".join("ab" * 4 + "abc" * 5 + "aabaabaabaab" * 4)):
        assert runs.periodic_runs([text])[0][1] == brute_runs(text.split())


@pytest.mark.parametrize("make", [lambda n: "w " * n, lambda n: " ".join(str(i % (n // 5)) for i in range(n)), lambda n: " ".join(str(i % 997) if i % 5003 else "x" for i in range(n)), lambda n: " ".join(format(i, "b") for i in range(n // 2)) * 2])
def test_long_texts_take_little_more_than_linear_time(make):
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        runs.periodic_runs([make(n)])
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * max(took[0], 0.05)


def plant(key, text):
    words, h = words_of(text), zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected_row(key, text):
    words = plant(key, text)
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(brute_collapsed(words, found)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_the_smallest_table(spark):
    frame = queries()["op12_runs"](spark, "/root/testdata/sf0.001")
    assert [c for c, _ in frame.dtypes] == COLUMNS and [t for _, t in frame.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = sorted(expected_row(r["doc_id"], r["text"]) for r in rows)
    assert sorted(map(tuple, frame.collect())) == expected
    assert sum(r[1] > 0 for r in expected) > 8


def test_nulls_repeats_clashes_and_nothing(spark):
    random_ = random.Random(3)
    rows = [(None, "a " * 9), (None, None), (3, "\x0b\n"), *((random_.randint(0, 400), random_text(random_, "abcd")) for _ in range(300))]
    rows += rows[-3:] + [(1, "a b c d e f g h " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    found = runs.detect(runs.planted(frame))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    expected = []
    for key, text in rows[:-1]:
        words = plant(key, text)
        expected.append((key, brute_runs(words), brute_collapsed(words, brute_runs(words))))
    expected.append((1, [(0, 160_000, 8)], "a b c d e f g h"))
    assert got == sorted(expected, key=repr)
    assert runs.detect(runs.planted(frame.limit(0))).count() == 0
