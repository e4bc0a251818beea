"""All queries against their SQL; the filter audit and the url rules against brute force."""

import itertools
import random
import re

import duckdb
import pytest

from lodestream.llm import filter_audit, url_filters
from lodestream.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, key long, mask int, part string, n long"
LABELS = "doc_id long, quality int, toxic int, good int"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


# -- filter audit --------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    fails = []
    for key, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows):
            found.add("E")
        fails.append((source or "", found, key is not None and key in good, key is not None and key in toxic))
    out, removals = [], {}
    for part in {f[0] for f in fails}:
        for order in itertools.permutations("ABCDE"):
            alive, gone = [f for f in fails if f[0] == part], []
            for step, name in enumerate(order, 1):
                lost = [f for f in alive if name in f[1]]
                redundant = sum(name in f[1] for f in gone)
                alive, gone = [f for f in alive if name not in f[1]], gone + lost
                only = sum(f[1] == {name} for f in fails if f[0] == part)
                removals[part, name] = removals.get((part, name), 0) + len(lost)
                out.append((part, "".join(order), step, len(alive), len(lost), redundant, only, sum(f[2] for f in lost), sum(f[3] for f in lost), name))
    return sorted((*r[:-1], removals[r[0], r[-1]]) for r in out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 5, 3, "clash", 7) for r in rows], DOCS).repartition(3)
    docs = docs.withColumn("words", filter_audit.words(filter_audit.whole_text()))
    filters = filter_audit.text_filters(filter_audit.whole_text(), docs["words"])
    counts = filter_audit.mask_counts(docs, spark.createDataFrame([(*x, 9) for x in labels], LABELS), filters)
    frame = filter_audit.audit(counts, "ABCDE")
    return sorted(tuple(r) for r in frame.collect())


def test_audit_equals_all_orders_applied_one_by_one(spark):
    random.seed(4)
    texts = ["", None, " \t", "LOUD", "a b # c", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i % 40}" for i in range(300)), "A B C " * 90, "x " * 100_000 + "|"]
    texts += [" ".join(random.choice(["one", "Two", "3%", "four", "FIVE"]) for _ in range(random.choice([3, 210]))) for _ in range(12)]
    rows = [(random.choice([None, *range(25)]), random.choice(texts), random.choice([None, "", "s", "t"])) for _ in range(120)]
    rows += [(7, "same", "s"), (7, "same", "s"), (7, "same", "t"), (8, "same", "t"), (None, "same", "t")]
    labels = [(random.choice([None, *range(30)]), random.choice([0, 1, None]), random.choice([0, 1, None])) for _ in range(40)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == []


def test_survivors_of_every_subset(spark):
    counts = {m: random.Random(m).randint(0, 9) for m in range(8)}
    frame = spark.createDataFrame([("p", m, n, 1, 0) for m, n in counts.items() if n], "part string, mask int, n long, good long, toxic long")
    found = filter_audit.survivors(frame, 3).first()
    assert found.n == [sum(n for m, n in counts.items() if not m & s) for s in range(8)]


# -- url rules -----------------------------------------------------------------


def brute_verdict(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


PAGES = "page_id long, url string, host string, domain string, sweep int"


def judged(spark, urls, rules, **how):
    pages = spark.createDataFrame([(i % 5 if i % 7 else None, u, "h", "d", 1) for i, u in enumerate(urls)], PAGES).repartition(3)
    frame = url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **how)
    assert frame.columns == ["page_id", "url", "domain", "sweep", "host", "path", "rule", "verdict"]
    return sorted(((r.url, r.host, r.path, r["rule"], r.verdict) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("sweep", [1, 256])
def test_urls_against_all_rules(spark, sweep):
    random.seed(6)
    labels, pieces = ["com", "net", "a", "b", "ab", "www", ""], ["/", "a", "ab", "é", "%20", "\U0010ffff", "b/"]
    host = lambda: ".".join(random.choice(labels) for _ in range(random.randint(1, 4)))
    path = lambda: "/" + "".join(random.choice(pieces) for _ in range(random.randint(0, 5)))
    rules = {(host(), random.choice(["", path()])): random.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{random.choice(['http', 'HTTPS', ''])}://{host().upper() if random.random() < 0.3 else host()}{random.choice(['', path(), path()])}{random.choice(['', '?q=/', '#x', '/x://y'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "http://com", "http://com\n/a", "x://a.com/" + "b/" * 50_000, *urls[:40], *["http://a.b.com/a"] * 200]
    assert judged(spark, urls, rules, sweep=sweep) == sorted(((u, *brute_verdict(u, rules)) for u in urls), key=repr)


def test_rules_that_are_equal_null_or_absent(spark):
    rules = [("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("b.com", None, "block"), ("b.com", "/", None)]
    assert judged(spark, ["x://a.com/", "x://b.com/"], rules) == [("x://a.com/", "a.com", "/", "a.com/", "block"), ("x://b.com/", "b.com", "/", None, "allow")]
    assert judged(spark, ["x://a.com/"], [], default="block") == [("x://a.com/", "a.com", "/", None, "block")]
    assert judged(spark, [], rules) == []
