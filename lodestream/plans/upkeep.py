"""Queries of an index's upkeep over the test tables: changes, states, pending vectors, issues, scalars, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import citations, incremental, rollups, text_search
from lodestream.plans.retrieval import _TOKENS, table
from lodestream.registry import register


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: most of them are still there."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0")
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id").alias("path"), F.col("n_chars").alias("size"), "lang")


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run stored: other sizes of some, and not all."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0")
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id").alias("path"), F.expr("n_chars + if(doc_id % 5 = 0, 1, 0)").alias("size"), "lang")


_CHANGES = """
WITH scanned AS (SELECT COALESCE(source, 'none') || '/' || doc_id AS path, n_chars AS size, lang FROM documents WHERE doc_id % 11 <> 0),
prior AS (SELECT COALESCE(source, 'none') || '/' || doc_id AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, lang FROM documents WHERE doc_id % 7 <> 0),
changes AS (SELECT COALESCE(s.path, p.path) AS path, CASE WHEN s.path IS NULL THEN 'gone' WHEN p.path IS NULL THEN 'new'
            WHEN s.size IS NOT DISTINCT FROM p.size AND s.lang IS NOT DISTINCT FROM p.lang THEN 'same' ELSE 'changed' END AS status
            FROM scanned s FULL JOIN prior p ON s.path = p.path)
"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(_scanned(spark, sf_dir), _prior(spark, sf_dir), keys=["path"], version=["size", "lang"])


@register("file_changes", _CHANGES + "SELECT * FROM changes")
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@register("file_states", _CHANGES + "SELECT path, size, lang FROM scanned WHERE path IN (SELECT path FROM changes WHERE status IN ('new', 'changed')) UNION ALL SELECT path, size, lang FROM prior WHERE path IN (SELECT path FROM changes WHERE status = 'same')")
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored states brought up to date: changed and gone files replaced as a whole."""
    found = _changes(spark, sf_dir)
    touched = found.filter(F.col("status") != incremental.SAME)
    fresh = _scanned(spark, sf_dir).join(touched.select("path"), "path", "left_semi")
    return incremental.replaced(_prior(spark, sf_dir), fresh, touched, ["path"])


@register(
    "postings_upkeep",
    f"WITH tokens AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents WHERE doc_id % 6 <> 5) SELECT id, COUNT(DISTINCT term) AS terms, COUNT(*) AS tokens FROM tokens GROUP BY id",
)
def postings_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored postings, of which some documents have gone and others were written anew: those of the present texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = text_search.postings(docs.withColumn("text", F.when(F.col("id") % 6 == 4, F.concat("text", F.lit(" outdated"))).otherwise(F.col("text"))))
    touched = docs.filter("id % 6 >= 4").select("id")
    fresh = text_search.postings(docs.filter("id % 6 = 4"))
    return incremental.replaced(stored, fresh, touched, ["id"]).groupBy("id").agg(F.count("*").alias("terms"), F.sum("count").alias("tokens"))


@register(
    "pending_vectors",
    """SELECT d.source, COUNT(*) AS passages, COUNT(*) FILTER (e.vec_id IS NULL) AS pending, COUNT(e.vec_id) AS embedded
    FROM documents d LEFT JOIN (SELECT * FROM embeddings WHERE label % 3 <> 0) e ON e.vec_id = d.doc_id GROUP BY d.source""",
)
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its passages and those that the present model has no vector of (labels stand for models)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 3 == 0, "old").otherwise("new").alias("model"))
    waiting = incremental.pending(docs, vectors, "new").groupBy("source").agg(F.count("*").alias("pending"))
    counted = docs.groupBy("source").agg(F.count("*").alias("passages")).withColumnRenamed("source", "of")
    both = counted.join(waiting, F.col("of").eqNullSafe(F.col("source")), "left").select(F.col("of").alias("source"), "passages", F.coalesce("pending", F.lit(0)).alias("pending"))
    return both.withColumn("embedded", F.col("passages") - F.col("pending"))


@register("index_counts", "SELECT source, COUNT(*) AS files, CAST(SUM(n_chars) AS BIGINT) AS chars, COUNT(text) AS readable, CAST(SUM(CAST(ceil(length(COALESCE(text, '')) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY GROUPING SETS ((source), ())")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, and over all (null), files, characters, readable texts and estimated tokens."""
    docs = table(spark, sf_dir, "documents").withColumn("tokens", text.estimated_tokens(F.col("text")))
    return docs.rollup("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count("text").alias("readable"), F.sum("tokens").alias("tokens"))


_FILES = "SELECT d.doc_id, d.source, d.lang, CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'error' WHEN l.doc_id IS NULL THEN 'unread' ELSE 'synced' END AS status, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN ' ' ELSE '' END AS message FROM documents d LEFT JOIN labels l USING (doc_id)"


@register("file_issues", f"WITH files AS ({_FILES}) SELECT source, COUNT(*) AS issues, string_agg(doc_id || ': ' || status || CASE WHEN trim(message) <> '' THEN ' (' || message || ')' ELSE '' END, '; ' ORDER BY doc_id) AS summary FROM files WHERE status = 'error' OR trim(message) <> '' GROUP BY source")
def file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its files with an error or a warning, in one line."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.expr("case when quality = 0 and toxic = 1 then 'error' when quality is null and toxic is null and not known then 'unread' else 'synced' end")
    message = F.expr("case when toxic = 1 then 'toxic' when quality = 0 then ' ' else '' end")
    files = docs.select("doc_id", "source").join(labels.withColumn("known", F.lit(True)), "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("status", status).withColumn("message", message)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.col("status"), F.when(F.trim("message") != "", F.concat(F.lit(" ("), F.col("message"), F.lit(")"))).otherwise(""))
    return incremental.issues(files).groupBy("source").agg(F.count("*").alias("issues"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"]), "; ").alias("summary"))


@register(
    "scalar_functions",
    r"""WITH u AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS name, octet_length(encode(html)) AS size FROM pages)
    SELECT page_id, name, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN lower(regexp_extract(name, '\.([^.]+)$', 1)) ELSE '' END AS kind,
      CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END AS stem,
      CASE WHEN length(url) <= 20 THEN url ELSE rtrim(substr(url, 1, 19)) || '…' END AS short,
      [trim(x) FOR x IN regexp_split_to_array(url, '[,\n]') IF trim(x) <> ''] AS entries,
      CASE WHEN regexp_matches(url, '-?\d+') THEN GREATEST(0.0, LEAST(1.0, CAST(regexp_extract(url, '-?\d+(?:\.\d+)?') AS DOUBLE) / 100)) END AS share,
      CASE WHEN size >= 1000000 THEN (size // 1000000) || '.' || (size % 1000000 // 100000) || ' MB' WHEN size >= 1000 THEN (size // 1000) || '.' || (size % 1000 // 100) || ' kB' ELSE size || ' B' END AS bytes,
      CASE WHEN page_id <> 0 THEN make_timestamp(page_id * 86400 * 1000000) END AS seen,
      starts_with(url, 'https://') AND contains(lower(html), 'article') AS secure_article,
      CASE WHEN starts_with(url, 'http://ththre.example.com/') THEN substr(url, 27) ELSE url END AS below FROM u JOIN (SELECT page_id, html FROM pages) USING (page_id)""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, snippets, lists, shares, sizes and times of the pages' addresses."""
    pages = table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", "[?#].*$", "")).withColumn("size", F.octet_length("html").cast("long"))
    url, path = F.col("url"), F.col("path")
    return pages.select(
        "page_id",
        text.file_name(path).alias("name"),
        text.extension(path).alias("kind"),
        text.stem(text.file_name(path)).alias("stem"),
        text.snippet(url, 20).alias("short"),
        text.listed(url).alias("entries"),
        text.share_of(url).alias("share"),
        text.byte_size(F.col("size")).alias("bytes"),
        text.from_epoch(F.col("page_id") * 86400).cast("timestamp_ntz").alias("seen"),
        (url.startswith("https://") & text.mentions(F.col("html"), F.lit("Article"), 3)).alias("secure_article"),
        text.relative_path(url, "http://ththre.example.com").alias("below"),
    )


@register(
    "cited_sources",
    """WITH names AS (SELECT conv_id, turn, regexp_extract(trim(text), '^[^ \t\n]+') AS name, length(text) AS score FROM conversations WHERE role <> 'system' AND text IS NOT NULL),
    sources AS (SELECT a.conv_id, a.turn, n.name, a.text AS answer, n.score FROM conversations a JOIN names n ON n.conv_id = a.conv_id AND n.turn <> a.turn WHERE a.role = 'assistant'),
    marked AS (SELECT *, COALESCE(length(name) >= 3 AND contains(lower(answer), lower(name)), FALSE) AS cited FROM sources),
    once AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY conv_id, turn, name ORDER BY cited DESC, score DESC) = 1)
    SELECT conv_id, turn, name, score, cited, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY cited DESC, score DESC, name) AS INT) AS place FROM once""",
)
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which first words of a conversation's other turns an answer names, those first."""
    turns = table(spark, sf_dir, "conversations")
    names = turns.filter("role <> 'system' and text is not null").select("conv_id", F.col("turn").alias("of"), F.regexp_extract(F.trim("text"), "^[^ \t\n]+", 0).alias("name"), F.length("text").alias("score"))
    sources = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(names, "conv_id").filter("of <> turn")
    return citations.ordered(citations.cited(sources), key=["conv_id", "turn"]).select("conv_id", "turn", "name", F.col("score").cast("long").alias("score"), "cited", "place")


@register("assembled_contexts", "SELECT conv_id, string_agg('[' || n || '] ' || role || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT conv_id, role, COALESCE(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system' AND turn < 4) GROUP BY conv_id")
def assembled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turns as one numbered context."""
    turns = table(spark, sf_dir, "conversations").filter("role <> 'system' and turn < 4").withColumn("text", F.coalesce("text", F.lit("")))
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("parts"))
    return parts.select("conv_id", text.numbered_context(F.col("parts")).alias("context"))


@register("storage_footprint", "WITH f AS (SELECT CASE WHEN regexp_matches(url, '^https://m\\.') THEN 'mobile' WHEN regexp_matches(url, '/en/') THEN 'english' ELSE 'other' END AS kind, octet_length(encode(html)) AS size FROM pages) SELECT kind, CAST(SUM(size) AS BIGINT) AS bytes, COUNT(*) AS files, ROUND(SUM(size) / SUM(SUM(size)) OVER (), 6) AS share FROM f GROUP BY kind")
def storage_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", F.octet_length("html").cast("long").alias("size"))
    return rollups.footprint(pages, {"mobile": r"^https://m\.", "english": "/en/"}, path="url")


@register("change_filter", "SELECT url, (list_contains(string_split(p, '/'), 'fr') OR NOT list_contains(['', '25'], CASE WHEN regexp_matches(n, '^.+\\.[^.]+$') THEN lower(regexp_extract(n, '\\.([^.]+)$', 1)) ELSE '' END) OR ends_with(n, '~') OR starts_with(n, '.') OR contains(n, '.tmp')) AS ignored FROM (SELECT url, regexp_replace(url, '[?#].*$', '') AS p, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS n FROM pages)")
def change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changed paths an index would not look at."""
    return table(spark, sf_dir, "pages").select("url", incremental.ignored(F.regexp_replace("url", "[?#].*$", ""), ["fr"], ["", "25"]).alias("ignored"))
