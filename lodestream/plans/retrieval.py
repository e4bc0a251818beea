"""Retrieval queries over the test tables, each with the SQL that its rows are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.vectors import cosine, dot, from_half, norm, normalized, relevance, to_half
from lodestream.operators import chunking, hybrid, matching, text_search, vector_search
from lodestream.registry import register

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(vectors: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100 is a query."""
    return vectors.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_SIMILAR = "ROUND(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 6)"
_SCORED = f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS wanted FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id AS id, {_SIMILAR.format("embedding", "wanted")} AS score FROM embeddings, q)
"""


@register("cosine_topk", f"SELECT vec_id AS id, {_SIMILAR.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    wanted = vectors.filter("id = 0").select(F.col("vector").alias("wanted")).limit(1)
    return vectors.crossJoin(F.broadcast(wanted)).select("id", F.round(cosine(F.col("vector"), F.col("wanted")), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(10)


@register("cosine_topk_batch", _SCORED + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10")
def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return vector_search.top_k(vectors, _queries(vectors), 10, DIM)


@register("ivf_topk")
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells from the table's size, probes from recall measured against the exact result: at least 0.9."""
    vectors = _vectors(spark, sf_dir)
    cells = vector_search.train_cells(vectors, vector_search.cells_for(vectors.count()))
    celled, queries = vector_search.assign_cells(vectors, cells), _queries(vectors)
    return vector_search.probe(celled, queries, cells, 10, vector_search.probes_for(celled, queries, cells, 10))


@register(
    "vector_functions",
    f"""SELECT a.vec_id AS id, ROUND(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS product,
    ROUND(({_SIMILAR.format("a.embedding", "b.embedding")} + 1) / 2, 7) AS relevance,
    ROUND(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS length,
    ROUND(CAST(a.embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS first_of_unit,
    ROUND(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) < 0.00006103515625 THEN round_even(x * 16777216, 0) / 16777216
      ELSE round_even(x / pow(2, floor(log2(abs(x))) - 10), 0) * pow(2, floor(log2(abs(x))) - 10) END)), 6) AS half_sum
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""",
)
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the one before: product, relevance, length, the first number after normalising, and the sum of its half-precision numbers."""
    vectors = _vectors(spark, sf_dir)
    before = vectors.select((F.col("id") + 1).alias("id"), F.col("vector").alias("before"))
    both = vectors.join(before, "id").withColumn("again", from_half(to_half("vector")))
    halves = F.aggregate("again", F.lit(0.0), lambda total, x: total + x.cast("double"))
    return both.select(
        "id",
        F.round(dot(F.col("vector"), F.col("before")), 6).alias("product"),
        F.round(relevance(F.round(cosine(F.col("vector"), F.col("before")), 6)), 7).alias("relevance"),
        F.round(norm(F.col("vector")), 6).alias("length"),
        F.round(F.get(normalized(F.col("vector")), F.lit(0)), 6).alias("first_of_unit"),
        F.round(halves, 6).alias("half_sum"),
    )


_FOLDED = "lower(strip_accents(COALESCE(text, '')))"
_TOKENS = f"regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+')"
_BM25 = f"""
WITH tokens AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents),
counts AS (SELECT id, term, COUNT(*) AS f FROM tokens GROUP BY ALL),
lengths AS (SELECT id, SUM(f) AS length FROM counts GROUP BY id),
sizes AS (SELECT (SELECT COUNT(*) FROM documents) AS n_all, (SELECT SUM(length) FROM lengths) AS words),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) WHERE length(term) > 1),
df AS (SELECT term, COUNT(*) AS n FROM counts GROUP BY term),
scored AS (
  SELECT query_id, c.id, ROUND(SUM(GREATEST(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length * n_all / words))), 6) AS score
  FROM asked JOIN counts c USING (term) JOIN df USING (term) JOIN lengths l ON l.id = c.id, sizes GROUP BY ALL)
"""


@register("bm25_topk", _BM25 + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS place FROM scored QUALIFY place < 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.bm25_top(_docs(spark, sf_dir), _benchmark(spark, sf_dir), 20)


@register(
    "rank_fusion",
    _BM25
    + """, lexical AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM scored),
shared AS (SELECT query_id, c.id, COUNT(*) AS score FROM asked JOIN counts c USING (term) GROUP BY ALL),
overlap AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM shared),
fused AS (SELECT query_id, id, ROUND(SUM(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM lexical UNION ALL SELECT * FROM overlap) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS place FROM fused QUALIFY place < 10""",
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with the number of shared terms, both rankings whole."""
    return text_search.fused_top(_docs(spark, sf_dir), _benchmark(spark, sf_dir), 10)


_HYBRID = (
    _BM25
    + f""", vectors AS (SELECT d.doc_id AS id, d.source AS grp, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
wanted AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 <> 9 THEN e.embedding END AS wanted FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id * 7),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS place FROM scored QUALIFY place < 100),
grouped AS (SELECT h.*, v.grp FROM hits h JOIN vectors v USING (id)),
turns AS (SELECT query_id, grp, row_number() OVER (PARTITION BY query_id ORDER BY MIN(place)) AS turn FROM grouped GROUP BY query_id, grp),
lexical AS (SELECT g.query_id, g.id, g.score FROM grouped g JOIN turns t ON t.query_id = g.query_id AND t.grp IS NOT DISTINCT FROM g.grp WHERE turn <= 8),
every AS (SELECT query_id, id, grp, {_SIMILAR.format("embedding", "wanted")} AS similarity FROM wanted, vectors WHERE wanted IS NOT NULL AND embedding IS NOT NULL),
near AS (SELECT query_id, id FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 100),
cand AS (SELECT query_id, id FROM lexical UNION SELECT query_id, id FROM near),
found AS (SELECT c.query_id, c.id, v.grp, e.similarity, l.score AS keyword FROM cand c JOIN vectors v USING (id)
          LEFT JOIN every e ON e.query_id = c.query_id AND e.id = c.id LEFT JOIN lexical l ON l.query_id = c.query_id AND l.id = c.id),
kept AS (SELECT * FROM found WHERE keyword IS NOT NULL OR similarity >= 0.2),
ranked AS (SELECT *, CASE WHEN similarity IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) - 1 END AS m,
           CASE WHEN keyword IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC NULLS LAST, id) - 1 END AS w FROM kept),
fused AS (SELECT query_id, id, grp, similarity, ROUND(COALESCE(1.0::DOUBLE / (60 + m), 0) + COALESCE(1.0::DOUBLE / (60 + w), 0), 9) AS score FROM ranked),
hybrid AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS place, id, grp AS "group", similarity, score FROM fused QUALIFY place < 10)
"""
)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors of the same number; every tenth query has none and falls back to words."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "text").join(vectors, "id", "left")
    wanted = vectors.filter("id % 7 = 0").select((F.col("id") / 7).cast("long").alias("query_id"), "vector").filter("query_id % 10 <> 9")
    return hybrid.retrieve(passages, _benchmark(spark, sf_dir).join(wanted, "query_id", "left"), groups=8, dim=DIM)


@register("hybrid_retrieval", _HYBRID + "SELECT * FROM hybrid")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


@register("hybrid_sources", _HYBRID + """SELECT query_id, "group", id, score FROM hybrid QUALIFY row_number() OVER (PARTITION BY query_id, "group" ORDER BY place) = 1""")
def hybrid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each source that a query found."""
    return hybrid.first_of_group(_hybrid(spark, sf_dir)).select("query_id", "group", "id", "score")


@register(
    "multi_query_merge",
    f"""WITH q AS (SELECT vec_id // 100 % 2 AS query_id, vec_id AS variant, embedding AS wanted FROM embeddings WHERE vec_id % 100 = 0),
    scored AS (SELECT query_id, variant, vec_id AS id, {_SIMILAR.format("embedding", "wanted")} AS score FROM embeddings, q),
    firsts AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY variant ORDER BY score DESC, id) <= 10),
    best AS (SELECT query_id, id, MAX(score) AS score FROM firsts GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= 10""",
)
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of two queries, each searched alone, merged by the best score of each row."""
    vectors = _vectors(spark, sf_dir)
    found = vector_search.top_k(vectors, _queries(vectors), 10, DIM).withColumnRenamed("query_id", "variant")
    return hybrid.merged(found.withColumn("query_id", F.expr("variant div 100 % 2")), 10)


@register(
    "neighbour_context",
    """WITH hits AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn % 3 = 0)
    SELECT h.conv_id AS id, CAST(h.turn AS INT) AS ordinal, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn, c.text) AS context
    FROM hits h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 GROUP BY ALL""",
)
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some turns with the turns around them."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("ordinal"), "role", "text")
    hits = turns.filter("role = 'user' and ordinal % 3 = 0").select("id", "ordinal")
    return chunking.with_neighbours(hits, turns.select("id", "ordinal", "text"))


@register(
    "history_queries",
    """SELECT conv_id, turn, array_to_string(list(COALESCE(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), chr(10)) AS asked
    FROM conversations WHERE role = 'user'""",
)
def history_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the two before it."""
    return hybrid.recent_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "asked")


@register(
    "chunk_documents",
    """WITH lines AS (SELECT doc_id, COALESCE(text, '') AS text, unnest(string_split(COALESCE(text, ''), chr(10))) AS line, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS n FROM documents),
    placed AS (SELECT *, COALESCE(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM lines),
    units AS (SELECT doc_id, text, CAST(begun AS BIGINT) + unnest(range(0, GREATEST(length(line), 1), 1600)) AS start FROM placed),
    ended AS (SELECT *, LEAD(start, 1, length(text)) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM units),
    own AS (SELECT DISTINCT doc_id, start // 1600 AS w FROM units),
    cuts AS (SELECT o.doc_id, o.w, MIN(e.start) AS a, MAX(e.stop) AS b, ANY_VALUE(e.text) AS text
             FROM own o JOIN ended e ON e.doc_id = o.doc_id AND e.start >= o.w * 1600 - 200 AND e.start < (o.w + 1) * 1600 GROUP BY o.doc_id, o.w),
    chunks AS (SELECT doc_id AS id, w, trim(substr(text, CAST(a AS INT) + 1, CAST(b - a AS INT)), ' ' || chr(9) || chr(10)) AS text FROM cuts)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY w) - 1 AS INT) AS ordinal, '' AS headings, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM chunks WHERE text <> ''""",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no headings, so their chunks are those of one section; sections are tested on fixtures."""
    return chunking.chunks(_docs(spark, sf_dir))


@register(
    "pattern_matches",
    """WITH patterns AS (SELECT regexp_extract(text, '^[^ ]+ [^ ]+') AS pattern, MIN(item_id) AS place FROM benchmark WHERE text IS NOT NULL GROUP BY 1)
    SELECT doc_id AS id, MIN(place) AS first, COUNT(*) AS matches FROM documents JOIN patterns ON contains(text, pattern) GROUP BY doc_id""",
)
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain the first two words of an item, which item comes first, and of how many."""
    patterns = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0).alias("pattern"), F.col("item_id").alias("place"))
    return matching.contained(_docs(spark, sf_dir), patterns)
