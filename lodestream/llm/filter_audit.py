"""What each filter of a chain removes, for every order of the filters, from one pass over the texts.

Every document gets a mask with one bit per filter that it fails. Documents are counted per part and mask, in all, with
label quality = 1 and with label toxic = 1. A subset-zeta transform turns the 2^k counts of a part into the survivors of
every subset of filters: survivors(S) is the sum over the masks that avoid S. The step of an order that applies
filter f after the set S then removes survivors(S) - survivors(S + f); nothing is read again for the k! orders. The same
differences over the labelled counts give what good or toxic documents a step loses.

Duplicates are the one filter that looks at other rows. Which filters a text fails otherwise is a function of the text, so
rows first shrink to one per text digest, part and mask, with their counts and those of their least doc_id; a window over
a digest's parts then tells the first rows from the later ones. Hot texts, parts and ids thus meet as partial sums.

Defined cases: a null text is empty. A null source is the part "", as an empty source is. A row with a null doc_id is neither earlier nor later than any other, so it never
fails the duplicate filter; rows that repeat the least doc_id of a text with that text are all first. Labels of one
doc_id in several rows count once: quality or toxic is 1 if any row says 1; null doc_ids have no label. Texts of any length are
read whole. Shares of 0 words or characters fail neither B nor C. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.tables import table, whole_text

#: What separates words, as a set of characters of a regular expression.
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
#: The filter that the operator works out itself, from digests and identifiers.
DUPLICATE = "E"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on a text alone: too short, too repetitive, too loud, marked up."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _labelled(labels: DataFrame, key: str) -> DataFrame:
    """One row per known key: good and toxic, 0 or 1."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long"))
    return labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("labelled")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail; bit i is the i-th filter, the next one that of duplicates."""
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    late = 1 << len(bits)
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole_text(text), 256)).alias("digest"),
        sum(bits[1:], bits[0]).alias("mask"),
    )
    same = rows.groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = same.join(_labelled(labels, key), F.col("key") == F.col("labelled"), "left")
    known = known.select("key", "digest", "part", "mask", "n", *[(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in COUNTS[1:]])
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", *COUNTS))).alias("first")
    unknown = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("unknown")
    by_part = known.groupBy("digest", "mask", "part").agg(*[F.sum(c).alias(c) for c in COUNTS], first, unknown)
    is_first = F.col("first.key") == F.min("first.key").over(Window.partitionBy("digest"))
    early = {c: F.when(is_first, F.col(f"first.{c}")).otherwise(0) for c in COUNTS} | {"n": F.when(is_first, F.col("first.n")).otherwise(0) + F.col("unknown")}
    told = by_part.select("part", "mask", *COUNTS, *[early[c].alias(f"early_{c}") for c in COUNTS])
    summed = told.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in told.columns[2:]])
    halves = F.array(
        F.struct(F.col("mask"), *[F.col(f"early_{c}").alias(c) for c in COUNTS]),
        F.struct((F.col("mask") + late).alias("mask"), *[(F.col(c) - F.col(f"early_{c}")).alias(c) for c in COUNTS]),
    )
    return summed.select("part", F.inline(halves))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """Per part, under each name of COUNTS, an array whose S-th entry is what avoids the filters of S; counts has a part and mask once.

    The zeta transform takes one round per filter, in which the entry of a mask with that bit takes up that of the mask
    without it; the survivors of S are the sums over the subsets of its complement.
    """
    full = (1 << filters) - 1
    every = F.sequence(F.lit(0), F.lit(full))

    def listed(c: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.col("by_mask")[m].getField(c), F.lit(0))).alias(c)

    def with_bit(c: str, bit: int) -> Column:
        return F.transform(c, lambda v, m: v + F.when(m.bitwiseAND(bit) != 0, F.get(F.col(c), m - bit)).otherwise(0))

    def complements(c: str) -> Column:
        return F.transform(every, lambda s: F.get(F.col(c), F.lit(full) - s)).alias(c)

    arrays = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("by_mask"))
    arrays = arrays.select("part", *map(listed, COUNTS))
    for i in range(filters):
        arrays = arrays.withColumns({c: with_bit(c, 1 << i) for c in COUNTS})
    return arrays.select("part", *map(complements, COUNTS))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    names has a letter per filter, in order of the bits of counts(part, mask, n, good, toxic). Rows grow with the factorial of its length.
    """
    k = len(names)
    full = (1 << k) - 1
    alive = survivors(counts, k)
    lost = lambda c, s, bit: F.get(F.col(c), s) - F.get(F.col(c), s + bit)
    orders_with = F.array(*[F.lit(factorial(size) * factorial(k - 1 - size)) for size in range(k)])  # orders in which a set of that size, and then the filter, come first
    bits = F.array(*[F.lit(1 << i) for i in range(k)])
    bit_of = lambda letter: F.element_at(bits, F.position(letter, F.lit(names)))
    rows = alive.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(order)) for order in permutations(names)])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    rows = rows.withColumn("bit", bit_of(F.substring("filter_order", F.col("step"), F.lit(1))))
    applied = F.sequence(F.lit(1), F.lit(k))
    rows = rows.withColumn("before", F.aggregate(applied, F.lit(0), lambda s, at: s + F.when(at < F.col("step"), bit_of(F.substring(F.col("filter_order"), at, F.lit(1)))).otherwise(0)))
    removed = lost("n", F.col("before"), F.col("bit"))

    def over_orders(total: Column, s: Column) -> Column:
        return total + F.when(s.bitwiseAND(F.col("bit")) == 0, lost("n", s, F.col("bit")) * F.get(orders_with, F.bit_count(s))).otherwise(0)

    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.col("before") + F.col("bit")).alias("kept"),
        removed.alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - removed).alias("redundant"),
        lost("n", full - F.col("bit"), F.col("bit")).alias("unique_fails"),
        lost("good", F.col("before"), F.col("bit")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("bit")).alias("toxic_lost"),
        F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), over_orders).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", words(whole_text()).alias("words"))
    filters = text_filters(whole_text(), F.col("words"))
    return audit(mask_counts(docs, table(spark, sf_dir, "labels"), filters), "".join([*filters, DUPLICATE]))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text,
         COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
first AS (SELECT text AS t, MIN(doc_id) AS least FROM texts GROUP BY 1),
known AS (SELECT doc_id AS labelled, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
masks AS (
  SELECT part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS b,
         CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d,
         CAST(COALESCE(doc_id > least, FALSE) AS INT) AS e, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic
  FROM texts JOIN first ON t = text LEFT JOIN known ON labelled = doc_id),
counts AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (
  SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order, [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] AS bits
  FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE l1.bit + l2.bit + l3.bit + l4.bit + l5.bit = 31 AND len(list_distinct([l1.bit, l2.bit, l3.bit, l4.bit, l5.bit])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, COALESCE(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT UNNEST(range(1, 6)) AS step)),
rows AS (
  SELECT part, filter_order, step, s.bit,
         SUM(CASE WHEN mask & (before | s.bit) = 0 THEN n ELSE 0 END) AS kept,
         SUM(CASE WHEN mask & before = 0 AND mask & s.bit <> 0 THEN n ELSE 0 END) AS removed,
         SUM(CASE WHEN mask & before <> 0 AND mask & s.bit <> 0 THEN n ELSE 0 END) AS redundant,
         SUM(CASE WHEN mask = s.bit THEN n ELSE 0 END) AS unique_fails,
         SUM(CASE WHEN mask & before = 0 AND mask & s.bit <> 0 THEN good ELSE 0 END) AS good_lost,
         SUM(CASE WHEN mask & before = 0 AND mask & s.bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(SUM(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM rows
"""
