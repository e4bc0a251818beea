"""Allow and block rules for urls by a sort-merge range join, with DataFrame functions only.

A rule names a host and a path prefix. It fits its host and all subdomains of it where the url's path starts with the
rule's path; of all rules that fit, the one with the most characters decides. A url has one canonical key for each domain
above it that has rules: the domain's labels in reverse, each ended by a dot, then the path. On these keys every rule is
an interval, from its own key to the key followed by a byte that UTF-8 never has, and two intervals nest or are disjoint.
Interval starts, ends and urls are sorted together and swept once: the running sum of +1 and -1 is the height of the
stack of open rules, and the top of the stack is the last start seen at the height at hand. The url then takes the
longest among the tops of its domains.

Equal pairs of host and path are swept once. A domain's urls are dealt out to as many sweeps as they need, each with all
of the domain's rules; sweeps are never smaller than the domain's rules, so the dealt rules are at most as many as urls and rules together.

Defined cases: a null url or one without "://" has an empty host and path; only rules of an empty host fit those. A rule
with an empty host also fits hosts that end in a dot, whose last label is empty. Rules with a null host, path or verdict
don't count. Of equal rules, "block" wins over other verdicts, else the least verdict in order of code points. Rules of equal length that fit the same url (different
domains): the longer host wins. Case matters in paths; in hosts A-Z are lower-cased, in rules too. Repeated rows and
repeated or null keys are rows of their own; extra columns pass through, and "host", "path", "rule" and "verdict" of the
input are replaced. No rules: every url has the default verdict. An empty table gives an empty result. Texts of any length pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.tables import table
from lodestream.session import cut

#: Urls of a domain that one sweep takes, unless the domain has more rules than that.
SWEEP = 256

#: Domains with rules up to this many are joined to the urls by broadcast (some 60 bytes each); beyond, by a shuffle join.
BROADCAST_DOMAINS = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, URL = 0, 1
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first "://" and "/", "?", "#" or the end; what follows up to "?", "#" or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def _canonical(domain: Column, path: Column) -> Column:
    """Reversed labels, each ended by a dot, then the path, as bytes: they sort as unsigned numbers."""
    labels = F.reverse(F.split(domain, r"\."))
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("."), path), "UTF-8")


def _domains(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."))


def _cleaned(rules: DataFrame) -> DataFrame:
    """One row per host and path of the rules: domain, prefix, verdict."""
    kept = rules.select(F.translate("host", UPPER, LOWER).alias("domain"), F.col("path").alias("prefix"), F.col("verdict").cast("string").alias("verdict"))
    first = F.min(F.struct((F.col("verdict") != "block").alias("other"), "verdict"))
    return kept.dropna().groupBy("domain", "prefix").agg(first["verdict"].alias("verdict"))


def _innermost(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row of asked(domain, path, host, sweep): the longest rule of that domain, as a struct; rows without one are left out.

    rules(domain, prefix, verdict, sweep) holds each rule once for every sweep of its domain.
    """
    nothing, found = F.lit(None).cast("string"), F.struct(F.length("prefix").alias("length"), F.col("prefix"), F.col("verdict"))
    key = _canonical(F.col("domain"), F.col("prefix"))
    starts = rules.select("domain", "sweep", key.alias("key"), F.lit(START).alias("kind"), F.lit(1).alias("change"), nothing.alias("host"), nothing.alias("path"), found.alias("found"))
    ends = rules.select("domain", "sweep", F.concat(key, F.lit(b"\xff")).alias("key"), F.lit(START).alias("kind"), F.lit(-1).alias("change"), nothing.alias("host"), nothing.alias("path"), F.when(F.lit(False), found).alias("found"))
    urls = asked.select("domain", "sweep", _canonical(F.col("domain"), F.col("path")).alias("key"), F.lit(URL).alias("kind"), F.lit(0).alias("change"), "host", "path", F.lit(None).alias("found"))
    line = Window.partitionBy("domain", "sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(ends).unionByName(urls).withColumn("height", F.sum("change").over(line))
    level = Window.partitionBy("domain", "sweep", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = swept.withColumn("top", F.last("found", ignorenulls=True).over(level))
    return top.filter((F.col("kind") == URL) & (F.col("height") > 0)).select("host", "path", "domain", F.col("top").alias("found"))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", sweep: int = SWEEP) -> DataFrame:
    """pages with host, path, rule (its host and path, or null) and verdict, by rules(host, path, verdict)."""
    host, path = host_and_path(F.col(f"`{url}`"))
    own = [c for c in pages.columns if c not in RESULTS]
    whole = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    rules = _cleaned(rules)
    asked = whole.select("host", "path").distinct().withColumn("domain", F.explode(_domains(F.col("host"))))
    listed = rules.groupBy("domain").agg(F.count("*").alias("rules"))
    counts = asked.groupBy("domain").agg(F.count("*").alias("urls")).join(listed, "domain")
    dealt = cut(counts.select("domain", F.ceil(F.col("urls") / F.greatest(F.lit(sweep), F.col("rules"))).cast("int").alias("sweeps")))
    if dealt.count() <= BROADCAST_DOMAINS:
        dealt = F.broadcast(dealt)
    asked = asked.join(dealt, "domain").withColumn("sweep", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int"))
    held = rules.join(dealt, "domain").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)))
    tops = _innermost(asked.select("domain", "host", "path", "sweep"), held.select("domain", "prefix", "verdict", "sweep"))
    order = F.struct((F.length("domain") + F.col("found.length")).alias("characters"), F.length("domain").alias("of_host"))
    rule = F.struct(F.concat("domain", "found.prefix").alias("rule"), F.col("found.verdict").alias("verdict"))
    best = tops.groupBy("host", "path").agg(F.max_by(rule, order).alias("__best"))
    judged = whole.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(f"`{c}`") for c in own], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


#: The rules of op13_urls: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", *RESULTS)


OP13_SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
split AS (
  SELECT ROW_NUMBER() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
best AS (
  SELECT k, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (k)
"""
