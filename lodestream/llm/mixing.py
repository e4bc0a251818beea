"""Mixing sources to target weights with DataFrame functions only.

Per source the words are summed (map-side partial sums, so a hot source costs one row per task),
targets are shared out by weight under a cap, and every document is emitted floor(rate) times plus
one more copy with probability equal to the fraction, decided by a hash of its identifier.

Defined cases: null text has size 0; the null source is a source of its own, ordered last; a source
without words has target 0 and rate 0; sources of equal ratio of cap to weight stand in order of their names; an empty
table gives an empty mix; repeated rows are separate documents that share one draw, but those without an identifier
draw one by one, by their text and place in the table, so that a source of such rows comes near its target, too (the
same for the same files); very long texts are counted whole; extra columns pass through whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.tables import WORD, table
from lodestream.session import cut

#: Sources up to this many are joined by broadcast (about 100 bytes each); beyond, by a shuffle that adaptive execution splits.
BROADCAST_SOURCES = 20_000


def draw(key: str, text: str, seed: str) -> Column:
    """A number in [0, 1) fixed by the key and the seed: 52 bits of an md5. Without a key, by the text and the row's place."""
    place = F.concat_ws("/", F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.monotonically_increasing_id().cast("string"))
    known = F.col(key).cast("string")
    digest = F.md5(F.concat(F.when(known.isNull(), place).otherwise(known), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: Fraction, cap: int) -> DataFrame:
    """One row per source of sizes(source, size): source_size, target.

    Targets that pass the cap stop at it and the excess is reshared by weight until none is above:
    the level x with sum(min(cap_i, x * weight_i)) = total. With sources sorted by cap_i / weight_i,
    x is (total - caps before) / (weights from here on) at the first source whose ratio is not below it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    listed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    listed = listed.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(every) * share.numerator / F.lit(share.denominator)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = listed.withColumn("level", left / weight_left)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(every)
    at = F.max(F.when(F.col("ratio") == found, F.col("level"))).over(every)
    return level.select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(at * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def plan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, seed: str = "mix") -> DataFrame:
    """Per row of docs: key, source, size, source_size, target, copies."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words.alias("size"), draw(key, text, seed).alias("draw")))
    targets = cut(source_targets(sizes, weights, share, cap))
    right = targets.select(F.col("source").alias("of"), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    joined = sizes.join(right, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    copies = (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return joined.select("key", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, *, key: str = "doc_id", **how) -> DataFrame:
    """The mixed documents: every row of docs as often as the plan says, with its own columns."""
    seed = how.pop("seed", "mix")
    chosen = plan(docs, key=key, seed=seed, **how)
    source, text = how.get("source", "source"), how.get("text", "text")
    cap = how.get("cap", 2)
    rates = chosen.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    rates = cut(rates.select(F.col("source").alias("__mix_source"), F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0).alias("__mix_rate")))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = docs.withColumn("__mix_draw", draw(key, text, seed)).join(rates, F.col(source).cast("string").eqNullSafe(F.col("__mix_source")))
    rate = F.col("__mix_rate")
    copies = (F.floor(rate) + (F.col("__mix_draw") < rate - F.floor(rate)).cast("long")).cast("int")
    return rated.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = plan(table(spark, sf_dir, "documents"))
    return chosen.select(F.col("key").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
listed AS (
  SELECT source, source_size, 2 * source_size AS most,
         CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM by_source),
ratios AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM listed),
levels AS (
  SELECT *, (CAST(SUM(source_size) OVER () * 3 AS DOUBLE) / 2 - CAST(COALESCE(SUM(most) OVER before, 0) AS DOUBLE))
            / CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0) AS DOUBLE) AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT MIN(ratio) AS ratio FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, LEAST(CAST(most AS DOUBLE), COALESCE((SELECT MAX(level) FROM levels WHERE ratio = (SELECT ratio FROM found)) * weight, CAST(most AS DOUBLE))) AS target
  FROM levels),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN LEAST(t.target / t.source_size, 2.0) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR) || '/mix'), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, ROUND(target, 6) AS target,
       CAST((FLOOR(rate) + CASE WHEN u < rate - FLOOR(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken
FROM rated
"""
