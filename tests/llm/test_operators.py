"""Each operator against a brute-force version on small fixtures, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import bpe, chat, html_extract, iblt, mixing, patricia, repair, suffixes, superminhash, toxicity
from lodestream.llm.components import components

random.seed(11)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi"]


def prose(n):
    return " ".join(random.choice(WORDS) + str(random.randint(0, 40)) for _ in range(n))


BASE = prose(120)
EDITED = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [BASE, EDITED, BASE, None, "", " \t", "One", "one two", "Été déjà <|endoftext|> x  y", prose(300), prose(300) + ". " + BASE[:200] + "!", "a" * 400, "\n".join([prose(9)] * 3), "x\x1cy z<|startoftext|>"]
ROWS = [(i * 3 + 1, t, "en", ["b", "a", None, "c"][i % 4], 7, "clash") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- exact duplicates --------------------------------------------------------


@pytest.mark.parametrize("most", [300, 5000, 1 << 40])
def test_trie_with_and_without_spilling(most):
    trie, count = patricia.PatriciaTrie(lambda a, b: a + b, most), {}
    for _ in range(3000):
        key = bytes(random.choices(b"ab", k=random.randint(0, 12)))
        trie.add(key, 1)
        count[key] = count.get(key, 0) + 1
    found = list(trie.items())
    assert dict(found) == count and len(found) == len(count)


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
def test_exact_dedup(docs, empty, keep, best):
    kept = {r.doc_id for r in patricia.distinct_texts(docs, keep=keep, max_bytes=500).collect()}
    groups = {}
    for r in ROWS:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert kept == {best(g) for g in groups.values()}
    assert patricia.distinct_texts(docs).schema == docs.schema
    assert patricia.distinct_texts(empty).count() == 0


def test_exact_dedup_of_null_and_repeated_ids_and_a_very_long_text(spark):
    long = prose(200_000)
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (9, None), (8, ""), (None, "b"), (None, "b"), (5, long), (6, long), (7, long + "x")]
    docs = spark.createDataFrame([(k, t, "en", f"s{i}", i, "") for i, (k, t) in enumerate(rows)], SCHEMA).repartition(4)
    kept = sorted((r.source, r.doc_id, r.text) for r in patricia.distinct_texts(docs).collect())
    assert kept == sorted([("s2", 3, "a"), ("s4", 9, None), ("s6", None, "b"), ("s9", 6, long), ("s10", 7, long + "x")])
    found = {(r.n_bytes, r.owner, r.members) for r in patricia.owners(docs).collect()}
    assert found == {(1, 3, 4), (0, 9, 2), (1, None, 2), (len(long), 6, 2), (len(long) + 1, 7, 1)}


# -- near duplicates ---------------------------------------------------------


def brute_components(rows, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in sets}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_groups(docs, width, percent):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_groups(docs, width=width, percent=percent).collect()}
    assert found == brute_components(ROWS, width, percent)


def test_large_near_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 8)
    base = prose(80).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(random.randint(0, 6)):
            words[random.randrange(len(words))] = f"edit{random.random()}"
        rows.append((i, " ".join(words), "en", "a", 1, ""))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_groups(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect()}
    assert found == brute_components(rows, 3, 85)


def test_texts_that_share_a_template(spark, monkeypatch):
    """More rows than a block takes, most of a text common to all: the rare shingles decide who meets."""
    monkeypatch.setattr(superminhash, "BLOCK", 8)
    monkeypatch.setattr(superminhash, "BANDS", 40)
    monkeypatch.setattr(superminhash, "ROWS", 2)
    frame = prose(70)
    rows = []
    for i in range(90):
        own = prose(25) if i % 3 else f"{rows[-1][1].rsplit(' # ', 1)[1]} more" if i else prose(25)
        rows.append((i, f"{frame} # {own}", "en", "a", 1, ""))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_groups(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect()}
    assert found == brute_components(rows, 3, 85)
    assert len({c for _, c in found.values()}) > 20


def test_a_bucket_of_very_many_different_classes(spark):
    """5000 sets that share 60 of 100 hashes with all others, and 40 pairs that are similar: no pair is lost, and the work is linear."""
    random_ = np.random.default_rng(8)
    common = random_.integers(-(2**62), 2**62, 60)
    sets = [np.unique(np.concatenate([common, random_.integers(-(2**62), 2**62, 40)])) for _ in range(5000)]
    for k in range(40):
        sets[2 * k + 1] = np.unique(np.concatenate([sets[2 * k][:-7], random_.integers(-(2**62), 2**62, 7)]))
    near = {(2 * k, 2 * k + 1) for k in range(40) if 100 * len(np.intersect1d(sets[2 * k], sets[2 * k + 1])) >= 85 * len(np.union1d(sets[2 * k], sets[2 * k + 1]))}
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "id long, hashes array<long>").repartition(4)
    met = frame.select("id", F.size("hashes").cast("long").alias("n")).withColumn("bucket", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "node long, component long")
    dealt = superminhash._open_blocks(met, none, frame, 85)
    assert dealt.count() < 3 * 5000
    links = {(r.a, r.b) for r in dealt.mapInArrow(superminhash._linked(85), "a long, b long").collect()}
    assert links == near and len(near) > 30


def test_near_groups_of_null_and_repeated_ids_and_a_very_long_text(spark):
    long, other = prose(60_000), prose(40)
    rows = [(7, long), (3, long + " more"), (None, other), (None, other), (9, other), (9, other), (5, None), (None, None), (4, " ")]
    out = superminhash.near_groups(spark.createDataFrame([(k, t, "en", "a", 1, "") for k, t in rows], SCHEMA), width=3, percent=85).collect()
    assert sorted(((r.doc_id or -1, r.component_id) for r in out), key=repr) == sorted([(7, 3), (3, 3), (-1, 9), (-1, 9), (9, 9), (9, 9), (5, 5), (-1, None), (4, 4)], key=repr)


def test_one_of_each_and_empty(docs, empty):
    kept = superminhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {root for _, root in brute_components(ROWS, 5, 80).values()}
    assert superminhash.near_groups(empty).count() == 0


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], np.unique(np.random.default_rng(2).integers(0, 2**63, 100).astype(np.uint64))])
    one, two = superminhash.superminhash([a, b], 512)
    assert abs((one == two).mean() - 900 / 1100) < 0.06


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}}


# -- toxicity ----------------------------------------------------------------


def test_toxicity_learns_subwords_and_leaves_clean_texts(spark):
    bad = ["vilify", "vilified", "vilifying"]
    rows, labels = [], []
    for i in range(240):
        words = prose(40).split()
        if i % 4 == 0:
            for _ in range(3):
                words[random.randrange(40)] = random.choice(bad)
        rows.append((i, " ".join(words), "en", "a", 1, ""))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = [(1, prose(30) + " vilifies vilifier", "", "", 1, ""), (2, prose(32), "", "", 1, ""), (3, None, "", "", 1, ""), (4, "", "", "", 1, ""), (5, "*** !!!", "", "", 1, "")]
    frame = spark.createDataFrame(probe, SCHEMA)
    score = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert score[1] > 0.5 > score[2] and score[3] == score[4] == score[5] < 0.5
    clean = toxicity.without_toxic(frame, model)
    assert {r.doc_id for r in clean.collect()} == {2, 3, 4, 5} and clean.columns == frame.columns
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_toxicity_scores_misspellings_by_shared_ngrams():
    """Every n-gram of the sample has an embedding; words never seen score by those that they share with seen ones."""
    bad, texts, labels = ["vermin", "scumbag", "loathsome"], [], []
    for i in range(300):
        words = prose(30).split()
        if i % 3 == 0:
            words[random.randrange(30)] = random.choice(bad)
            words[random.randrange(30)] = random.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    seen = {b for t in texts for b in toxicity.ngram_buckets(t.split())[0].tolist()}
    assert np.count_nonzero(model.gain) >= 0.9 * len(seen)
    misspelt = ["verminn", "vermins", "scumbagg", "sscumbag", "loathsomee", "loathsme", "scumbags"]
    assert not set(misspelt) & {w for t in texts for w in t.split()}
    clean = model.word_scores([w for w in prose(200).split()])
    assert model.word_scores(misspelt).min() > np.quantile(clean, 0.99)


def test_toxicity_without_both_classes():
    assert toxicity.fit(["a b"], [0]).bias < 0
    assert toxicity.fit(["", "!"], [0, 1]).gain.any() == False  # noqa: E712


def test_toxicity_of_repeated_rows_ties_and_very_long_texts(spark):
    """Repeated rows and labels count each; a very long text is left out of the fit and scored whole."""
    rows = [(i // 2, ("good " if i // 2 % 2 else "vile ") * 5 + prose(5), "en", "a", 1, "") for i in range(80)]
    long = (prose(30_000) + " ") + "vile " * 30_000
    rows += [(900, long, "en", "a", 1, ""), (901, prose(30), "en", "a", 1, ""), (901, prose(30), "en", "a", 1, ""), (None, "vile vile", "en", "a", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] * 2 + [(900, 0), (77, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows)
    by = {r.doc_id: r.score for r in scored}
    assert by[900] > 0.5 and by[None] > 0.5 and by[0] > 0.5 > by[1]


# -- tokens ------------------------------------------------------------------


def odd_texts():
    alphabet = "ab<|>' \t\nétΣσsS19²٣́\x1f ǅßIİı"
    return [t or "" for t in TEXTS] + ["ΑΣ ΟΔΟΣ", "don't I'LL 's", "日本 123４ ½", "a\x85b\xa0c​d　e"] + ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(500)]


def test_bpe_equals_the_library():
    path = bpe.default_vocabulary()
    library, own, texts = Tokenizer.from_file(path), bpe.Encoder(open(path, encoding="utf-8").read(), cache_chunks=300), odd_texts()
    for at in range(0, len(texts), 40):
        for text, (ids, decoded) in zip(texts[at : at + 40], own.encode(texts[at : at + 40])):
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, expected)) and decoded == library.decode(expected, skip_special_tokens=False)


def test_bpe_outputs(docs, empty):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.encode(docs, outputs=("n_tokens", "ids", "ids_sha256")).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode(empty).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    library = Tokenizer.from_file(repair.default_vocabulary())
    repair.write(docs, str(tmp_path / "files"), shard_bytes=900)
    found = {r.key: r for r in repair.read(spark, str(tmp_path / "files")).collect()}
    at = 0
    for key, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = found[key]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def coder():
    from public_tokenizers import PATTERN

    return repair.Tokens(*(open(p, encoding="utf-8").read() for p in (repair.default_vocabulary(), repair.default_ranks())), PATTERN)


def spaces():
    return [chr(i) for i in range(0x110000) if chr(i).isspace()] + list("\x00\x1b\u180e\u200b\u2060\ufeff")


def test_ids_equal_the_library_on_every_code_point():
    library, own = Tokenizer.from_file(repair.default_vocabulary()), coder()
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for around in ("a{0}b {0}1", " {0}  {0}'s{0}"):
        for at in range(0, len(points), 20000):
            texts = [around.format(p) for p in points[at : at + 20000]]
            for text, told in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
                assert own.ids(text).tolist() == told.ids, repr(text)


def test_ids_equal_the_library_on_mixed_white_space():
    library, own = Tokenizer.from_file(repair.default_vocabulary()), coder()
    alphabet = [*spaces(), *"ab1'é中_", " ", " ", "\n", "<|endoftext|>", "'ll", "'S"]
    texts = ["".join(random.choices(alphabet, k=random.randint(1, 14))) for _ in range(20000)] + ["b\na \xa0 \xa0"]
    for text, told in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert own.ids(text).tolist() == told.ids, repr(text)
    for text in (" " * 400_000 + "x", "\n" * 400_000, "ab" * 300_000, ""):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_shard_has_rules_and_random_access():
    texts = [(prose(50) + " ") * 8 for _ in range(20)] + odd_texts()
    data, tokens = coder().shard([*range(len(texts) - 1), None], texts, 2)
    shard, library = repair.Shard(data), Tokenizer.from_file(repair.default_vocabulary())
    assert len(shard.grammar.rules) and len(shard.symbols) < 0.5 * tokens and shard.keys[-1] is None
    assert shard.length.tolist() == shard.grammar.lengths().tolist()
    ends = np.cumsum(shard.tokens)
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        a = random.randint(0, len(ids))
        b = random.randint(a, len(ids))
        assert shard.ids(i).tolist() == ids and shard.ids(i, a, b).tolist() == ids[a:b]
        assert shard.all_ids()[ends[i] - len(ids) : ends[i]].tolist() == ids


@pytest.mark.parametrize("n, kinds", [(0, 3), (1, 3), (9, 1), (4000, 2), (4000, 60)])
def test_repair_rules_run_to_the_end(n, kinds):
    """No pair is left that could be replaced often enough to save bytes, and the grammar gives the sequence back."""
    sequence = np.array(random.choices(range(kinds), k=n) if kinds > 1 else [0] * n, np.uint32)
    last = np.array([random.random() < 0.02 for _ in range(n)], bool)
    last[-1:] = True
    grammar, symbols, ends = repair.learn(sequence, last, kinds)
    assert grammar.expand(symbols).tolist() == sequence.tolist()
    assert np.cumsum(grammar.lengths()[symbols])[ends].tolist() == (np.flatnonzero(last) + 1).tolist()
    count, skip = {}, -1
    for i in range(len(symbols) - 1):
        pair = (int(symbols[i]), int(symbols[i + 1]))
        if not ends[i] and not (pair[0] == pair[1] and skip == i):  # equal symbols in a row: every other pair
            count[pair] = count.get(pair, 0) + 1
            skip = i + 1
    assert not count or max(count.values()) < repair.LEAST_COUNT


def test_token_files_of_null_and_repeated_keys_long_texts_and_an_empty_table(spark, empty, tmp_path):
    library = Tokenizer.from_file(repair.default_vocabulary())
    long = prose(120_000)
    rows = [(5, long), (5, "b"), (5, "a"), (None, "null key"), (5, "a"), (7, None), (None, None), (9, "")]
    repair.write(spark.createDataFrame([(k, t, "en", "a", 1, "") for k, t in rows], SCHEMA), str(tmp_path / "files"), shard_bytes=1000)
    found = sorted((r.start, r.key, r.n_tokens, r.ids) for r in repair.read(spark, str(tmp_path / "files")).collect())
    at, told = 0, []
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(cast(t as binary)) as h").collect()}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        told.append((at, key, len(ids), ids))
        at += len(ids)
    assert found == told
    repair.write(empty, str(tmp_path / "none"))
    assert repair.read(spark, str(tmp_path / "none")).count() == 0


# -- repeated strings --------------------------------------------------------


def brute_repeats(rows):
    """Per row (id, bytes, removed, runs removed, what stays); a null id ranks after all others."""
    rank, seen, out = lambda key: (key is None, key or 0), {}, []
    for key, text, *_ in sorted(rows, key=lambda r: rank(r[0])):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            seen.setdefault(data[i : i + 50], key)
    for key, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if rank(seen[data[i : i + 50]]) < rank(key):
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((key, len(data), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out, key=repr)


def found_repeats(docs, **options):
    rows = suffixes.without_repeats(docs, **options).collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=repr)


@pytest.mark.parametrize("group_bytes", [1 << 20, 700])
def test_suffix_dedup(docs, empty, group_bytes):
    assert found_repeats(docs, group_bytes=group_bytes) == brute_repeats(ROWS)
    assert suffixes.without_repeats(empty).count() == 0


@pytest.mark.parametrize("group_bytes, hot", [(1 << 20, 4096), (600, 4096), (600, 2)])
def test_suffix_dedup_of_null_and_repeated_ids_and_common_passages(spark, group_bytes, hot):
    passage = prose(20)
    rows = [(i, prose(random.randint(0, 9)) + passage[random.randint(0, 40) :] + prose(random.randint(0, 9)), "en", "a", 1, "") for i in range(60)]
    rows += [(i, "ab" * random.randint(10, 90), "en", "a", 1, "") for i in range(60, 70)]
    rows += [(r[0], *rows[(7 * i) % 70][1:]) for i, r in enumerate(rows[:20])]  # identifiers twice, with other texts
    rows += [(None, *r[1:]) for r in rows[::9]] + rows[::13] + [(None, None, "en", "a", 1, "")] * 2
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found_repeats(docs, group_bytes=group_bytes, hot=hot) == brute_repeats(rows)


def test_suffix_dedup_of_a_very_long_text(spark):
    long = prose(400_000)  # some 3.6 MB
    rows = [(1, long, "en", "a", 1, ""), (2, long[:2_000_000] + "#" + long[2_000_000:], "en", "a", 1, ""), (3, "x" + long[-70:], "en", "a", 1, "")]
    found = {r.doc_id: r for r in suffixes.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bytes(found[2].kept) == b"#" and found[2].n_spans == 2
    assert bytes(found[3].kept) == b"x" and found[1].n_removed == sum(x[2] for x in brute_repeats(rows[:1]))


def test_multikey_quicksort_is_exact():
    raw = np.frombuffer(bytes(random.choices(b"ab", k=400)) * 2 + bytes(120), np.uint8)
    starts = np.array(random.sample(range(len(raw) - 49), len(raw) - 49))
    order, new = suffixes.multikey_quicksort(raw, starts)
    strings = [raw[s : s + 50].tobytes() for s in starts[order].tolist()]
    assert strings == sorted(strings)
    assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


# -- mixing ------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def test_mixing(spark):
    rows = [(i, prose(random.randint(1, 60)), "en", random.choice(["a", "b", "ü", "Z", None]), 1, "") for i in range(400)] + [(1000, None, "en", "null", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target, taken = brute_targets(sizes), {}
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    for r in plan:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.25 * target[s] + 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, mixing.plan(docs.repartition(5)).collect()), key=repr)


def test_mixing_of_repeated_rows_ties_and_very_long_texts(spark):
    """Repeated rows are documents of their own that share one draw; sources of equal size and weight have equal targets."""
    long = "w " * 200_000
    rows = [(1, "a b c", "s0")] * 4 + [(None, "x", "s1")] * 2 + [(5, long, "s2"), (6, None, "s3"), (7, "", "s3"), (8, long, "s5")]
    docs = spark.createDataFrame([(k, t, "en", s, 1, "") for k, t, s in rows], SCHEMA)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows) and len({r.copies for r in plan if r.key == 1}) == 1
    by = {r.source: r for r in plan}
    assert by["s2"]["size"] == 200_000 and by["s3"].target == 0 and by["s3"].copies == 0
    assert all(r.copies <= 2 for r in plan)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)


def test_bpe_of_null_and_repeated_ids_and_a_very_long_text(spark, empty):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    long = prose(60_000)
    rows = [(None, "Ab c"), (None, None), (3, "x"), (3, "x"), (3, "y"), (4, long)]
    out = bpe.encode(spark.createDataFrame([(k, t, "en", "a", 1, "") for k, t in rows], SCHEMA), outputs=("n_tokens", "ids")).collect()
    told = sorted(((k is not None, k or 0, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in out) == told and all(r.n_tokens == len(r.ids) for r in out)


def test_mixing_empty(empty):
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


# -- pages -------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><a href='/x'>Home</a></nav><div class=\"ad\">Buy this now please everyone.</div><article><h1>Big &amp; bold</h1><p><b>First  line<br><p>Second &#233; line.</p><p>Short.</p></article><footer>&copy; us</footer>", "Big & bold\nFirst line\nSecond é line.\nShort."),
    ("<main><h1>T</h1><p>One two three four five six.</p><aside>x y z</aside><form>Mail <input></form></main><section class='comments'><article><p>I liked it a lot and will be back for more of this.</p></article></section>", "T\nOne two three four five six."),
    ("<article><header><h1>Title here</h1></header><p>Body one.</p><div class='cookie-notice'>We use cookies</div><ul><li>a<li>b</ul></article>", "Title here\nBody one.\na\nb"),
    (None, ""),
    ("", ""),
    ("<p", ""),
    ("<!-- <p>no</p> --><script>x", ""),
    ("plain text with a < b and c", "plain text with a < b and c"),
]


def test_main_text(spark):
    frame = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    found = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(frame).collect()}
    assert found == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_extract.extract(frame.limit(0)).count() == 0


LONG = "This paragraph has quite a number of plain words that tell a story about the town, its river and the people who live there every day."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body class="right-sidebar"><div class="sidebar"><p>Buy it now</p></div><p>{LONG}</p><p>{LONG}</p>', f"{LONG}\n{LONG}"),
        (f'<body class="no-sidebar"><article><p>{LONG}</p></article><footer>us</footer>', LONG),
        (f'<div id="page" class="has-header"><div class="header">Site name</div><article><p>{LONG}</p></article></div>', LONG),
        (f'<main class="with-toc"><div class="toc"><a href="#a">A</a></div><p>{LONG}</p></main>', LONG),
        (f'<form action="/"><div class="comments"><article><p>I liked it a lot.</p></article></div><article><p>{LONG}</p></article></form>', LONG),
        (f'<article><p>{LONG}</p></article><div class="comments"><article><p>{LONG} {LONG}</p></article></div><footer><p>{LONG} {LONG}</p></footer>', LONG),
        (f'<article><p>{LONG}</p><p>So <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds in every case here.</p></article>', f"{LONG}\nSo x=2 holds in every case here."),
    ],
)
def test_names_on_what_holds_the_article_do_not_lose_it(page, text):
    assert html_extract.main_text(page) == text


# -- fingerprints ------------------------------------------------------------


BLOCK = 3 * iblt.SIDE


def cells_of(fingerprint):
    parts = [fingerprint[i : i + 28] for i in range(0, len(fingerprint), 28)]
    return [(int(p[:4], 16), int(p[4:20], 16), int(p[20:], 16)) for p in parts]


def fold(cells, blocks):
    out = [(0, 0, 0)] * (BLOCK * blocks)
    for i, (n, k, c) in enumerate(cells):
        o = out[i % len(out)]
        out[i % len(out)] = (o[0] + n, o[1] ^ k, o[2] ^ c)
    return out


def peel(cells, check):
    """The cells of a block after peeling, and how many digests came out."""
    cells, found = list(cells), 0
    for _ in range(iblt.ROUNDS):
        pure = {k: n for n, k, c in cells if abs(n) == 1 and check(k) == c}
        if not pure:
            break
        found += len(pure)
        for k, n in pure.items():
            for third in range(3):
                i = third * iblt.SIDE + (k >> iblt._SHIFT + 8 * third & iblt.SIDE - 1)
                cells[i] = (cells[i][0] - n, cells[i][1] ^ k, cells[i][2] ^ check(k))
    return cells, found


def likeness_of(a, b, check):
    """What two returned fingerprints say of each other, in plain Python."""
    number = lambda cells, j=0, size=1: sum(cells[BLOCK * q + i][0] for q in range(j, len(cells) // BLOCK, size) for i in range(iblt.SIDE))
    a, b = cells_of(a), cells_of(b)
    blocks = min(len(a), len(b)) // BLOCK
    difference = [(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]) for x, y in zip(fold(a, blocks), fold(b, blocks))]
    first, differing = max(1, blocks >> iblt.LEVELS - 1), 0
    open_ = [(j, first) for j in range(first)]
    while open_:
        j, size = open_.pop()
        left, found = peel(fold(difference, size)[BLOCK * j : BLOCK * j + BLOCK], check)
        filled = sum(x != (0, 0, 0) for x in left)
        if not filled:
            differing += found
        elif size < blocks:
            open_ += [(j, 2 * size), (j + size, 2 * size)]
        elif 2 * filled <= BLOCK:
            differing += found + max(sum(2 if n == 0 and (k or c) else abs(n) for n, k, c in left[t * iblt.SIDE : (t + 1) * iblt.SIDE]) for t in range(3))
        else:
            differing += number(a, j, size) + number(b, j, size)
    total = number(a) + number(b)
    common = max(0, total - differing) / 2
    return common / (total - common) if total else 1.0


def checks_of(spark, fingerprints, texts):
    """The check hash of a digest: Spark's xxhash64 over all digests that peeling can find."""
    pieces = {p for t in texts for p in [*re.findall(r"[^\n]{1,%d}" % iblt.PIECE, t), *re.findall(r"[^\n]{1,%d}" % iblt.FINE, t)]}
    rows = spark.createDataFrame([(p,) for p in pieces], "p string").selectExpr("xxhash64(p) as d").selectExpr("d", "xxhash64(d, 1) & 4294967295L as c").collect()
    known = {r.d & (1 << 64) - 1: r.c for r in rows}
    return lambda k: known.get(k & (1 << 64) - 1)


@pytest.mark.parametrize("range_rows", [1000, 2])
def test_fingerprints(spark, empty, monkeypatch, range_rows):
    monkeypatch.setattr(iblt, "RANGE_ROWS", range_rows)
    lines = [prose(random.randint(3, 30)) for _ in range(900)]
    shuffled = lambda k: "\n".join(random.sample(lines, k))
    texts = TEXTS + [shuffled(k) for k in (5, 30, 30, 200, 700, 1)]
    texts += [texts[-3], texts[-3].replace("1", "2", 40), texts[-3] + "\nmore", "short", "a longer text, though still a short one, of some eighty code points or so, yes", "\n\n"]
    rows = [(i * 3 - 9, t, "en", "a", 1, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA).repartition(3)
    found = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    edits = []
    for i, (key, text, *_) in enumerate(rows):
        own, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(own) // 4
        edits.append(own[: len(own) - cut] + following[:cut])
    check = checks_of(spark, found, [t or "" for t in texts] + edits)
    pieces = lambda t: set(re.findall(r"[^\n]{1,%d}" % iblt.PIECE, t)) | (set(re.findall(r"[^\n]{1,%d}" % iblt.FINE, t)) if len(t) < iblt.SHORT else set())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by_text, exact, near = {}, 0, 0
    for i, (key, text, *_) in enumerate(rows):
        own, following, edited, r = text or "", rows[(i + 1) % len(rows)][1] or "", edits[i], found[key]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness_of(r.fingerprint, r.edited_fingerprint, check))
        assert r.near_next == pytest.approx(likeness_of(r.fingerprint, found[rows[(i + 1) % len(rows)][0]].fingerprint, check))
        assert sum(n for n, *_ in cells_of(r.fingerprint)) == 3 * len(pieces(own))
        for told, other in ((r.near_edited, edited), (r.near_next, following)):
            exact += told == pytest.approx(like(pieces(own), pieces(other)))
            near += abs(told - like(pieces(own), pieces(other))) < 0.1
        assert by_text.setdefault(own, r.fingerprint) == r.fingerprint and (edited != own or r.edited_fingerprint == r.fingerprint)
    assert exact >= 0.8 * 2 * len(rows) and near >= 0.95 * 2 * len(rows)
    assert iblt.fingerprints(empty).count() == 0


@pytest.mark.parametrize("range_rows", [1000, 3])
def test_fingerprints_of_null_and_repeated_ids_and_a_very_long_text(spark, monkeypatch, range_rows):
    monkeypatch.setattr(iblt, "RANGE_ROWS", range_rows)
    long = "\n".join(prose(20) for _ in range(6000))  # about a million code points
    rows = [(None, prose(4)) for _ in range(12)] + [(4, prose(5)) for _ in range(12)] + [(9, long), (10, long), (7, "x"), (7, "x"), (7, None)]
    out = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in out) == sorted((k is not None, k or 0, len(t or "")) for k, t in rows)
    # each row has one successor: the edited texts are those of a ring in the order of keys
    ring = sorted(((r.doc_id is not None, r.doc_id or 0) for r in out))
    assert len(ring) == len(rows)
    nine = next(r for r in out if r.doc_id == 9)
    assert nine.near_next == 1.0 and nine.n_chars == len(long)
    shared = {p: 1 for p in re.findall(r"[^\n]{1,%d}" % iblt.PIECE, long)}
    edited = set(re.findall(r"[^\n]{1,%d}" % iblt.PIECE, long[: len(long) - len(long) // 4] + long[: len(long) // 4]))
    assert nine.near_edited == pytest.approx(len(edited & set(shared)) / len(edited | set(shared)), abs=0.02)


# -- chats -------------------------------------------------------------------


def test_chats(spark):
    tools = {"tools": [{"name": "add", "parameters": {"required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "additionalProperties": False}}]}
    calls = [
        {"id": "c2", "name": "add", "arguments": {"b": 2.5, "a": 1}, "after": ["c1"]},
        {"id": "c1", "name": "add", "arguments": '{"b": 1, "a": "x", "z": {"q": 1, "b": [1, 2]}}'},
        {"id": "c1", "name": "add", "arguments": {"a": 1}},
        {"id": "c9", "name": "sub", "arguments": "no json"},
        {"id": "d1", "name": "add", "arguments": {"a": 1, "b": 2}, "after": ["d2"]},
        {"id": "d2", "name": "add", "arguments": [1], "after": ["d1"]},
    ]
    rows = [(1, 0, "system", json.dumps(tools)), (1, 1, "user", 'say "é"\n'), (1, 2, "assistant", json.dumps({"content": "ok", "tool_calls": calls})), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "one"})), (1, 4, "tool", json.dumps({"tool_call_id": "c2", "content": "two"})), (1, 5, "tool", json.dumps({"tool_call_id": "zz"})), (2, 0, None, None), (None, None, "user", '{"broken')]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = chat.format_chats(frame).collect()
    call = {(r.call_id, r.slot): (r.level, r.linked_turn, r.problems, r.line) for r in out if r.kind == "call"}
    assert call["c2", 1] == (1, 4, [], '{"arguments":{"a":1,"b":2.5},"call":{"id":"c2","name":"add"}}')
    assert call["c1", 2] == (0, 3, ["type:a", "unexpected:z"], '{"arguments":{"a":"x","b":1,"z":{"b":[1,2],"q":1}},"call":{"id":"c1","name":"add"}}')
    assert call["c1", 3][1:3] == (None, ["missing:b", "duplicate_id"])
    assert call["c9", 4][2:] == (["unknown_tool"], '{"arguments":"no json","call":{"id":"c9","name":"sub"}}')
    assert call["d1", 5][0] == call["d2", 6][0] == -1 and "cycle" in call["d1", 5][2]
    results = [(r.kind, r.call_id, r.turn, r.slot, r.linked_turn) for r in out if r.role == "tool"]
    assert sorted(results) == [("orphan", "zz", 5, 0, 5), ("result", "c1", 2, 2, 3), ("result", "c2", 2, 1, 4)]
    said = {(r.conv_id, r.turn): r.line for r in out if r.kind == "message"}
    assert said[1, 1] == json.dumps({"content": 'say "é"\n', "role": "user"}, separators=(",", ":"), ensure_ascii=False)
    assert said[2, 0] == '{"content":"","role":null}' and len(said) == 5
    for r in out:
        json.loads(r.line)
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_arguments_against_nested_schemas(spark):
    place = {"type": "object", "required": ["city"], "properties": {"city": {"type": "string", "minLength": 2}}, "additionalProperties": False}
    schema = {"properties": {"unit": {"type": ["string", "null"]}, "mode": {"enum": ["a", 1]}, "v": {"const": 2}, "at": place, "xs": {"items": {"type": "integer", "maximum": 5}, "maxItems": 3}}, "additionalProperties": {"type": "boolean"}}
    tools = {"tools": [{"type": "function", "function": {"name": "f", "parameters": schema}}, {"name": "bare"}]}
    cases = [
        ("f", {"unit": None, "mode": "a", "v": 2, "at": {"city": "Rome"}, "xs": [1, 5], "more": True}, []),
        ("f", {"unit": 3, "mode": "b", "v": 3, "more": 1}, ["const:v", "enum:mode", "type:more", "type:unit"]),
        ("f", {"at": {"city": "R", "z": 1}, "xs": [1, 6, "x"]}, ["range:xs[1]", "size:at.city", "type:xs[2]", "unexpected:at.z"]),
        ("f", {"at": {}, "xs": [1, 2, 3, 4], "mode": 1}, ["missing:at.city", "size:xs"]),
        ("bare", {"any": 1}, []),
        ("none", {}, ["unknown_tool"]),
    ]
    calls = [{"id": f"c{i}", "type": "function", "function": {"name": n, "arguments": json.dumps(a)}} for i, (n, a, _) in enumerate(cases)]
    rows = [(1, 0, "system", json.dumps(tools)), (1, 1, "assistant", json.dumps({"tool_calls": calls}))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("kind = 'call'").collect()
    assert {r.call_id: r.problems for r in out} == {f"c{i}": p for i, (_, _, p) in enumerate(cases)}


def test_rows_without_identifier_draw_one_by_one(spark):
    rows = [(None, " ".join(["w"] * 50), "en", "abc"[i % 3], 1, "") for i in range(300)] + [(None, f"{i} " * 50, "en", "abc"[i % 3], 1, "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).persist()
    found = mixing.plan(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(found) == 3 and all(abs(r.taken - r.target) < 0.15 * r.target for r in found)
    mixed = mixing.mix(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] * 50 for r in mixed} == {r.source: r.taken for r in found}
    docs.unpersist()


def test_no_step_of_the_suffix_search_runs_twice(spark):
    frame = suffixes.without_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), with_text=False)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert [plan.count(x) for x in ("FileScan parquet", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow")] == [1, 4, 3]


def brute_toxicity(text, model):
    """The score of a text by loops over its words' n-grams, each hashed with Python's integers."""
    mask, logits = (1 << 64) - 1, []
    for chunk in text.lower().split():
        letters = [i for i, c in enumerate(chunk) if c.isalnum()]
        if not letters:
            continue
        word, gains = f"<{chunk[letters[0] : letters[-1] + 1]}>", []
        for n in (3, 4, 5, 6):
            for i in range(len(word) - n + 1):
                h = 0
                for c in word[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) & mask
                h = (h + n) * 0x9E3779B97F4A7C15 & mask
                h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 & mask
                gains.append(float(np.float32(model.gain[(h >> 44) % toxicity.BUCKETS])))
        logits.append(sum(gains) / len(gains) if gains else 0.0)
    mean = sum(logits) / len(logits) if logits else 0.0
    return 1 / (1 + np.exp(-(model.bias + model.scale * mean)))


def test_toxicity_scores_equal_loops_over_ngrams(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    odd = spark.createDataFrame([(None, "une Fête!! x"), (None, None), (-1, "... -- !"), (-2, "a")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(every, model).collect()), key=repr)
    expected = sorted(((r.doc_id, brute_toxicity(r.text or "", model)) for r in every.collect()), key=repr)
    assert [k for k, _ in got] == [k for k, _ in expected] and [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-9)
    marks = {r.doc_id: r.h for r in odd.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert marks[None] is True and marks[-1] == (zlib.crc32(b"-1") % 5 == 0)


def test_messages_of_the_suffix_search_grow_with_the_input(spark):
    """Groups and buckets both double with the input; the rows that are shuffled don't grow with their product."""
    random_ = random.Random(2)

    def shuffled(n):
        rows = [(i, " ".join(random_.choice(WORDS) + str(random_.randint(0, 400)) for _ in range(60))) for i in range(n)]
        frame = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False, group_bytes=1000, lanes=4)
        frame.collect()
        plan, total = [frame._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                plan.append(node.executedPlan())
                continue
            if "QueryStage" in name:
                plan.append(node.plan())
                continue
            if name == "Exchange":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            if name != "ReusedExchange":
                children = node.children()
                plan += [children.apply(i) for i in range(children.size())]
        return total

    small, large = shuffled(60), shuffled(240)
    assert 0 < small and large < 6 * small  # 4 times the input; with a message for each group and bucket it would be nearly 16 times


def test_a_shard_with_more_symbols_than_the_usual_width_holds(monkeypatch):
    texts = [(prose(50) + " ") * 8 for _ in range(6)]
    usual, _ = coder().shard(list(range(6)), texts, 2)
    monkeypatch.setattr(repair, "SYMBOL_BYTES", 1)  # 256 symbols are too many for it
    wide, _ = coder().shard(list(range(6)), texts, 2)
    assert len(wide) > len(usual) and repair.symbol_bytes(257) == 4
    shard, library = repair.Shard(wide), Tokenizer.from_file(repair.default_vocabulary())
    for i, text in enumerate(texts):
        assert shard.ids(i).tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_the_suffix_search_makes_no_row_for_each_group_and_bucket(spark):
    """58 groups and as many buckets: what they tell each other stays in rows for a group and lane, or a group and task."""
    random_ = random.Random(3)
    rows = [(i, " ".join(random_.choice(WORDS) + str(random_.randint(0, 400)) for _ in range(60))) for i in range(120)]
    frame = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False, group_bytes=1000, lanes=4)
    frame.collect()
    assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
