"""The registered queries over the test tables, with their SQL for DuckDB."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import classify, embed, refine, text
from corvane.operators import fulltext, pending, retrieval, segment, stats, store
from corvane.plans import sqltext as q
from corvane.sources import archive
from corvane.sources.tables import balanced, conversation_messages, embedding_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-06-01 00:00:00"


def query(sql: str | None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(q.DECORATED).alias("t"))


DECORATED = f"(SELECT doc_id, {q.DECORATED} AS t FROM documents)"


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on one machine alone, where none is set, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
    return folder


def rounded(c: Column | str) -> Column:
    return F.round(c, 6)


# Text ------------------------------------------------------------------------


def _text_query(name: str, expression: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decorated(spark, sf_dir).select("doc_id", expression(F.col("t")).alias("x")).select("doc_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n"))

    run.__name__ = name
    query(f"SELECT doc_id, md5(x) AS digest, CAST(length(x) AS BIGINT) AS n FROM (SELECT doc_id, {sql('t')} AS x FROM {DECORATED})")(run)


_text_query("normalize_documents", text.normalize, q.normalize)
_text_query("vectorizable_documents", text.vectorizable, q.vectorizable)
_text_query("invisible_removal", text.remove_invisible, q.remove_invisible)
_text_query("code_tokens", text.replace_code, q.replace_code)
_text_query("strip_separators", text.strip_separators, lambda e: q.replaced(e, text.SEPARATORS, " "))
_text_query("strip_urls", text.replace_urls, lambda e: q.replaced(e, text.URL, "[URL]"))
_text_query("strip_logs", text.remove_logs, lambda e: q.chained(e, text.LOG_STEPS))
_text_query("strip_markdown", text.strip_markdown, lambda e: q.chained(e, text.MARKDOWN_STEPS))
_text_query("injection_removal", text.remove_injections, lambda e: q.chained(e, text.INJECTION_STEPS))
_text_query("whitespace_collapse", text.collapse, lambda e: f"regexp_replace({e}, {q.quoted(q.WHITE + '+')}, ' ', 'g')")


@query(f"SELECT page_id, {q.html_to_markdown('html')} AS markdown FROM pages")
def html_to_markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", text.html_to_markdown(F.col("html")).alias("markdown"))


@query(
    f"""SELECT doc_id, CAST(len(m) AS BIGINT) AS blocks, coalesce(regexp_extract(m[1], '```(\\w+)?\\n(.*?)```', 1, 's'), '') AS language,
    coalesce(trim(regexp_extract(m[1], '```(\\w+)?\\n(.*?)```', 2, 's'), chr(10) || ' '), '') AS code
    FROM (SELECT doc_id, regexp_extract_all(t, '```(?:\\w+)?\\n(?:.*?)```', 0, 's') AS m FROM {DECORATED}) WHERE len(m) > 0"""
)
def code_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decorated(spark, sf_dir).select("doc_id", text.code_blocks(F.col("t")).alias("m")).filter(F.size("m") > 0)
    return found.select("doc_id", F.size("m").cast("long").alias("blocks"), F.col("m")[0]["language"].alias("language"), F.col("m")[0]["code"].alias("code"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS window_no, sha256(substr(text, i * 512 + 1, 512)) AS chunk_hash FROM (SELECT doc_id, text, unnest(range((length(text) + 511) // 512)) AS i FROM documents)")
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunk_hashes(F.col("text"))).alias("i", "chunk_hash")).select("doc_id", F.col("i").cast("long").alias("window_no"), "chunk_hash")


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(
    """SELECT CAST(doc_id AS VARCHAR) || '_chunk' || CAST(i + 1 AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS message_id, CAST(i + 1 AS INTEGER) AS sequence, substr(text, i * 3800 + 1, 3800) AS chunk_text
    FROM (SELECT doc_id, text, unnest(range((length(text) + 3799) // 3800)) AS i FROM documents WHERE length(text) > 4000)"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return store.chunk_rows(rows, NOW, "text", None).select("chunk_id", "message_id", "sequence", "chunk_text")


@query(f"SELECT doc_id, {q.title_case('text')} AS title FROM documents")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.title_case(F.col("text")).alias("title"))


_FLAT = q.strip(f"regexp_replace(text, {q.quoted(q.WHITE + '+')}, ' ', 'g')")


@query(
    f"""SELECT doc_id, CASE WHEN length(f) > 200 THEN left(f, 197) || '...' ELSE f END AS line, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS list,
    replace(left(text, 100), chr(10), ' ') || '...' AS cell FROM (SELECT doc_id, text, {_FLAT} AS f FROM documents)"""
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[text.snippet(F.col("text"), s).alias(s) for s in ("line", "list", "cell")])


@query("SELECT doc_id, md5(CASE WHEN length(text) > 6000 THEN left(text, 6000) || '...' ELSE text END) AS cut, md5(CASE WHEN length(text) > 1500 THEN regexp_replace(left(text, 1500), ' [^ ]*$', '') || '...' ELSE text END) AS words FROM documents")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate(c, refine.REFINE_CHARS, "...")).alias("cut"), F.md5(text.truncate_words(c, 1500)).alias("words"))


# Classification ---------------------------------------------------------------

_LOW = q.strip("lower(t)")
_match = lambda patterns: f"regexp_matches({_LOW}, {q.quoted('|'.join(patterns))})"
_INTENT = f"""CASE WHEN t IS NULL OR NOT regexp_matches(t, '\\S') THEN 'social|0.5' WHEN {_match(classify.QUESTION)} THEN 'question_explicit|0.85' WHEN {_match(classify.COMMAND)} THEN 'command|0.8'
 WHEN {_match(classify.SOCIAL)} THEN 'social|0.75' WHEN len(regexp_split_to_array({q.strip("t")}, '\\s+')) < 5 THEN 'social|0.6' ELSE 'knowledge_share|0.7' END"""
_RULED = f"(SELECT doc_id, split_part(r, '|', 1) AS intent, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence FROM (SELECT doc_id, {_INTENT} AS r FROM {DECORATED}))"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", classify.rule_intent(F.col("t")).alias("r")).select("doc_id", "r.intent", "r.confidence")


@query(f"SELECT * FROM {_RULED}")
def rule_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir)


@query(f"SELECT doc_id, intent, starts_with(intent, 'question_') AS is_question, intent = 'command' AS is_command FROM {_RULED}")
def intent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.schema import with_flags

    return with_flags(_ruled(spark, sf_dir)).drop("confidence")


@query(f"SELECT intent, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percent FROM {_RULED} GROUP BY intent")
def intent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_ruled(spark, sf_dir), "intent").withColumn("percent", rounded("percent"))


def _topics_sql(stopwords: tuple[str, ...]) -> str:
    return f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents)),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN ({", ".join(map(q.quoted, stopwords))}) GROUP BY doc_id, word),
    r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c)
    SELECT d.doc_id, coalesce(string_agg(word, ',' ORDER BY k) FILTER (k <= 5), '') AS topics FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""


@query(_topics_sql(classify.STOPWORDS))
def topics_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.topics_of(balanced(table(spark, sf_dir, "documents")), "doc_id", "text").select("doc_id", F.array_join("topics", ",").alias("topics"))


@query(_topics_sql(classify.SHORT_STOPWORDS))
def topics_top5_short_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.topics_of(balanced(table(spark, sf_dir, "documents")), "doc_id", "text", classify.SHORT_STOPWORDS).select("doc_id", F.array_join("topics", ",").alias("topics"))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM conversations),
    h AS (SELECT conv_id, turn, CAST(('0x' || left(md5(word), 8))::BIGINT % {width} AS INTEGER) AS i, CASE WHEN ('0x' || substr(md5(word), 9, 1))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM w),
    v AS (SELECT conv_id, turn, i, sum(s) AS x FROM h GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL)
    SELECT v.conv_id, v.turn, v.i, round(x / norm, 6) AS x FROM v JOIN n USING (conv_id, turn) WHERE x <> 0"""
)
def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.posexplode(embed.hashing_embedding(F.col("text"), 64)).alias("i", "x"))
    return rows.filter("x != 0").withColumn("x", rounded("x"))


# Statistics -------------------------------------------------------------------


@query("SELECT count(*) AS total_messages, count(DISTINCT conv_id) AS total_conversations FROM conversations")
def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(conversation_messages(spark, sf_dir))


@query("SELECT author_role, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM conversations), 6) AS percent FROM (SELECT CASE WHEN lower(role) IN ('user', 'assistant', 'system', 'tool') THEN lower(role) ELSE 'system' END AS author_role FROM conversations) GROUP BY author_role")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(conversation_messages(spark, sf_dir), "author_role").withColumn("percent", rounded("percent"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || '_' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def conversation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conversation_id").orderBy("timestamp", "id")
    return conversation_messages(spark, sf_dir).select("conversation_id", "id", F.row_number().over(order).cast("long").alias("place"))


_ROLLUP = """SELECT event_type, count(*) AS messages, count(DISTINCT user_id) AS conversations, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day,
 CASE WHEN strftime(min(ts), '%Y-%m-%d') = strftime(max(ts), '%Y-%m-%d') THEN strftime(min(ts), '%Y-%m-%d') ELSE strftime(min(ts), '%Y-%m-%d') || ' - ' || strftime(max(ts), '%Y-%m-%d') END AS span FROM events GROUP BY event_type"""


@query(_ROLLUP)
def topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    found = stats.topic_rollup(table(spark, sf_dir, "events"), "event_type", "user_id", "ts")
    return found.select("event_type", "messages", "conversations", day("first").alias("first_day"), day("last").alias("last_day"), "span")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_topics(table(spark, sf_dir, "events"), "event_type", 3)


@query("SELECT count(DISTINCT event_type) AS topics, count(*) AS messages FROM events")
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.topic_totals(table(spark, sf_dir, "events"), "event_type")


# Vector search ----------------------------------------------------------------

_PROBE = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_SCORES = f"SELECT vec_id, label, list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])) AS score FROM embeddings WHERE len(embedding) = len({_PROBE})"


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


def _found(df: DataFrame) -> DataFrame:
    return df.select("vec_id", rounded("score").alias("score"), "rank")


_TOP = "SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({}) ORDER BY score DESC, vec_id LIMIT {}"


@query(_TOP.format(_SCORES, 10))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(retrieval.vector_search(embedding_vectors(spark, sf_dir), _probe(spark, sf_dir), 10, key="vec_id"))


@query(_TOP.format(_SCORES + " AND label = 3", 10))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(retrieval.vector_search(embedding_vectors(spark, sf_dir).filter("label = 3"), _probe(spark, sf_dir), 10, key="vec_id"))


@query(_TOP.format(f"SELECT * FROM ({_SCORES}) WHERE score > 0.3", 3))
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(retrieval.vector_search(embedding_vectors(spark, sf_dir), _probe(spark, sf_dir), 3, threshold=retrieval.SCORE_THRESHOLD, key="vec_id"))


@query(
    """SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embedding_vectors(spark, sf_dir)
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))  # the queries asked, against all rows
    return retrieval.batch_search(vectors, asked, 5, "vec_id").withColumn("score", rounded("score"))


@query(
    """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
    n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label) SELECT m.label, CAST(i - 1 AS INTEGER) AS i, round(x / norm, 6) AS x FROM m JOIN n ON m.label = n.label"""
)
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.centroids(embedding_vectors(spark, sf_dir), ["label"], "vector")
    return found.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", rounded("x"))


_HYBRID = f"""WITH v AS ({_TOP.format(_SCORES, 20)}), l AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id DESC) AS INTEGER) AS rank FROM embeddings WHERE label = 3 ORDER BY vec_id DESC LIMIT 20)
SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT vec_id, rank FROM v UNION ALL SELECT vec_id, rank FROM l) GROUP BY vec_id ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, vec_id LIMIT 10"""


@query(_HYBRID)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    vectors = embedding_vectors(spark, sf_dir)
    near = retrieval.vector_search(vectors, _probe(spark, sf_dir), 20, key="vec_id").select("vec_id", "rank")
    other = vectors.filter("label = 3").orderBy(F.desc("vec_id")).limit(20).select("vec_id", F.row_number().over(Window.orderBy(F.desc("vec_id"))).alias("rank"))
    return retrieval.reciprocal_fusion([near, other], 10, key="vec_id").select("vec_id", rounded("score").alias("score"))


# Full-text search -------------------------------------------------------------

_TOKENS = """t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS ws FROM documents)),
 l AS (SELECT doc_id, CAST(len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS DOUBLE) AS length FROM documents), s AS (SELECT count(*) AS n_docs, avg(length) AS mean FROM l)"""


def _bm25_sql(hits: list[str], docs: str, limit: int = 20) -> str:
    """hits: per phrase SQL of (doc_id) per occurrence in t; docs: SQL of the fitting doc_ids."""
    parts = " UNION ALL ".join(f"SELECT {k} AS phrase, doc_id, count(*) AS tf FROM ({h}) GROUP BY doc_id" for k, h in enumerate(hits))
    return f"""WITH {_TOKENS}, h AS ({parts}), f AS (SELECT phrase, count(*) AS n_hits FROM h GROUP BY phrase), d AS ({docs}),
    x AS (SELECT h.doc_id, sum(CASE WHEN ln((n_docs - n_hits + 0.5) / (n_hits + 0.5)) > 0 THEN ln((n_docs - n_hits + 0.5) / (n_hits + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS bm25
    FROM h JOIN f ON h.phrase = f.phrase JOIN l ON h.doc_id = l.doc_id, s WHERE h.doc_id IN (SELECT doc_id FROM d) GROUP BY h.doc_id)
    SELECT doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (ORDER BY bm25 DESC, doc_id) AS INTEGER) AS rank, round(1.0::DOUBLE / (row_number() OVER (ORDER BY bm25 DESC, doc_id) + 1), 6) AS score
    FROM x ORDER BY x.bm25 DESC, doc_id LIMIT {limit}"""


_term = lambda w: f"SELECT doc_id FROM t WHERE term = '{w}'"
_pair = lambda a, b, d=1: f"SELECT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + {d} WHERE a.term = '{a}' AND b.term = '{b}'"


def _searched(spark: SparkSession, sf_dir: str, words: str, limit: int = 20) -> DataFrame:
    rows = balanced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = fulltext.text_search(fulltext.postings(rows, "doc_id", ("text",)), fulltext.lengths(rows, "doc_id", ("text",)), words, limit, fields=("text",))
    return found.select(F.col("doc").alias("doc_id"), rounded("bm25").alias("bm25"), "rank", rounded("score").alias("score"))


@query(_bm25_sql([_term("wher"), _term("thon")], f"({_term('wher')}) INTERSECT ({_term('thon')})"))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "wher thon")


@query(_bm25_sql([_pair("of", "the")], _pair("of", "the")))
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '"of the"')


@query(_bm25_sql([_term("thon"), _term("und")], f"(({_term('thon')}) UNION ({_term('und')})) EXCEPT ({_term('the')})"))
def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "(thon OR und) NOT the")


@query(_bm25_sql(["SELECT doc_id FROM t WHERE starts_with(term, 'wher')"], "SELECT doc_id FROM t WHERE starts_with(term, 'wher')"))
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "wher*")


@query(_bm25_sql(["SELECT doc_id FROM t WHERE term = 'the' AND pos = 0"], "SELECT doc_id FROM t WHERE term = 'the' AND pos = 0"))
def first_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "text:^the")


@query(_bm25_sql([_term("of"), _term("thon")], "SELECT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.pos <> b.pos WHERE a.term = 'of' AND b.term = 'thon' AND greatest(a.pos, b.pos) - least(a.pos, b.pos) - 1 <= 3"))
def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "NEAR(of thon, 3)")


@query(_bm25_sql([_term("thon")], f"({_term('thon')}) EXCEPT (({_term('wher')}) INTERSECT ({_term('und')}))"))
def not_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words side by side bind tighter than NOT."""
    return _searched(spark, sf_dir, "thon NOT wher und")


@query(_bm25_sql([_pair("of", "the")], f"({_pair('of', 'the')}) EXCEPT ({_term('und')})"))
def plus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase by a plus sign, in a set of columns."""
    return _searched(spark, sf_dir, "{text}: of + the NOT und")


def _changed_sql(sql: str) -> str:
    """SQL over documents after a change: one of a hundred has more words, one of a hundred is gone."""
    return sql.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN text || ' thon wher' ELSE text END AS text FROM documents WHERE doc_id % 100 <> 9)")


def _indexed_search(spark: SparkSession, sf_dir: str, words: str) -> DataFrame:
    """A search of an index of all documents after that change; keys have leading zeros, so that they sort as numbers."""
    from corvane.operators.textindex import TextIndex

    rows = table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"), "text")
    index = TextIndex(spark, f"{_shared_folder(spark)}/corvane-indexes/{uuid.uuid4().hex}", ("text",))
    index.add(rows)
    index.add(rows.filter("doc_id % 100 = 7").withColumn("text", F.concat("text", F.lit(" thon wher"))), removed=rows.filter("doc_id % 100 = 9").select(F.col("id").alias("doc")))
    found = index.search(words, 20)
    return found.select(F.col("doc").cast("long").alias("doc_id"), rounded("bm25").alias("bm25"), "rank", rounded("score").alias("score"))


@query(_changed_sql(_bm25_sql([_term("wher"), _term("thon")], f"({_term('wher')}) UNION ({_term('thon')})")))
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hits by the blocks whose bounds reach them."""
    return _indexed_search(spark, sf_dir, "wher OR thon")


@query(_changed_sql(_bm25_sql([_pair("thon", "wher"), _term("of")], f"({_pair('thon', 'wher')}) INTERSECT ({_term('of')})")))
def index_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_search(spark, sf_dir, '"thon wher" of')


#: Queries made from whole texts: a hint in front, behind, alone, two of them, none.
_RAW = """CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN '..' || role || '.. ' || text WHEN 1 THEN text || ' ..' || role || '..' WHEN 2 THEN '..' || role || '..' WHEN 3 THEN 'x ..' || role || '.. y ..b ' || turn || '.. ' || text ELSE text END"""
_SPACED = "regexp_replace({}, '^ +| +$', '', 'g')"


@query(
    f"""WITH r AS (SELECT conv_id, turn, {_RAW} AS raw FROM conversations), h AS (SELECT *, regexp_extract_all(raw, '\\.\\.([^\\n]+?)\\.\\.', 1) AS hints FROM r),
    s AS (SELECT *, {_SPACED.format("raw")} AS whole, CASE len(hints) WHEN 0 THEN raw WHEN 1 THEN {_SPACED.format("replace(raw, '..' || hints[1] || '..', '')")}
     ELSE {_SPACED.format("replace(" + _SPACED.format("replace(raw, '..' || hints[1] || '..', '')") + ", '..' || hints[2] || '..', '')")} END AS rest FROM h),
    j AS (SELECT *, {_SPACED.format("concat_ws(' ', nullif(rest, ''), nullif(array_to_string(hints, ' '), ''))")} AS joined FROM s)
    SELECT conv_id, turn, md5(CASE WHEN joined = '' THEN whole ELSE joined END) AS query, array_to_string(hints, ',') AS hints FROM j"""
)
def query_hint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_RAW).alias("raw"))
    return rows.select("conv_id", "turn", retrieval.hints_column(F.col("raw")).alias("h")).select("conv_id", "turn", F.md5("h.query").alias("query"), F.array_join("h.hints", ",").alias("hints"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN toxic IS NOT NULL THEN 't' || toxic ELSE '-' END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    topic = F.when(F.col("quality") == 1, "good").otherwise("")
    return rows.select("doc_id", text.first_topic(topic, F.when(F.col("toxic").isNotNull(), F.array(F.concat(F.lit("t"), "toxic")))).alias("label"))


@query("SELECT m.conv_id || '_' || m.turn AS id, m.turn = 0 AS is_target FROM conversations m WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND lower(text) LIKE '%thon%')")
def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = conversation_messages(spark, sf_dir)
    hits = messages.filter(F.col("id").endswith("_0") & F.lower("content").contains("thon"))
    return retrieval.context(messages, hits).select("id", "is_target")


# Pending sets and mutations ---------------------------------------------------

_VECTORS = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'old' WHEN quality = 0 THEN NULL ELSE 'new' END AS version, CASE WHEN toxic = 1 THEN 384 WHEN quality = 0 THEN NULL ELSE 768 END AS dim FROM labels)"


def _side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a vectors table: some of an old version, some of none."""
    kind = lambda a, b: F.when(F.col("toxic") == 1, a).when(F.col("quality") == 0, None).otherwise(b)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id"), F.lit("message").alias("entity_type"), F.lit(1).alias("vector"), kind("old", "new").alias("model_version"), kind(384, 768).alias("vector_dim"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id")


@query(f"SELECT doc_id FROM {_VECTORS} WHERE version <> 'new' OR version IS NULL")
def pending_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.outdated(_side(spark, sf_dir), "new", "model_version").select(F.col("entity_id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.without_vector(_ids(spark, sf_dir), "doc_id", _side(spark, sf_dir), "message")


@query(f"SELECT d.doc_id FROM documents d LEFT JOIN {_VECTORS} v ON d.doc_id = v.doc_id WHERE v.doc_id IS NULL OR version <> 'new' OR version IS NULL")
def pending_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.stale_vectors(_ids(spark, sf_dir), "doc_id", _side(spark, sf_dir), "message", "new")


@query(f"SELECT doc_id FROM {_VECTORS} WHERE dim <> 768 OR dim IS NULL")
def wrong_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.wrong_dimension(_side(spark, sf_dir)).select(F.col("entity_id").alias("doc_id"))


_REFINED = """CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Intención: a | Términos: b' WHEN 1 THEN 'intención: ' || text WHEN 2 THEN '' WHEN 3 THEN 'INTENCIóN: x | términos: y' ELSE NULL END"""


@query(f"SELECT doc_id FROM (SELECT doc_id, {_REFINED} AS r FROM documents) WHERE r IS NULL OR r = '' OR NOT (regexp_matches(r, '^[Ii][Nn][Tt][Ee][Nn][Cc][Ii]ó[Nn]:') AND regexp_matches(r, '[Tt]é[Rr][Mm][Ii][Nn][Oo][Ss]:'))")
def pending_old_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_REFINED).alias("r")).filter(pending.old_format(F.col("r"))).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text END AS r FROM documents) WHERE r IS NULL")
def pending_unrefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN text END").alias("refined_content"))
    return pending.unrefined(rows).select("doc_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id FROM conversations WHERE turn >= 4 GROUP BY conv_id")
def pending_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = conversation_messages(spark, sf_dir).withColumn("segment_id", F.when(F.split("id", "_")[1].cast("int") < 4, "s"))
    vectors = messages.select(F.col("id").alias("entity_id"), F.lit("message").alias("entity_type"), F.lit(1).alias("vector"))
    return pending.needs_segmentation(messages, vectors)


@query("SELECT entity_id, entity_type FROM (SELECT 'm' || doc_id AS entity_id, 'message' AS entity_type, 0 AS p FROM documents WHERE lang = 'fr' UNION ALL SELECT 'c' || doc_id, 'chunk', 1 FROM documents WHERE lang IS DISTINCT FROM 'fr') ORDER BY p, entity_id LIMIT 50")
def messages_then_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    messages = rows.filter("lang = 'fr'").select(F.concat(F.lit("m"), "doc_id").alias("id"), F.col("text").alias("vectorizable_content"))
    parts = rows.filter("NOT lang <=> 'fr'").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.lit(None).cast("string").alias("refined_text"))
    return pending.messages_then_chunks(messages, parts, 50).select("entity_id", "entity_type")


@query("SELECT count(*) AS total, count_if(l.doc_id IS NOT NULL AND d.doc_id % 2 = 0) AS reindexed, count(*) - count_if(l.doc_id IS NOT NULL AND d.doc_id % 2 = 0) AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def reindex_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    content = rows.select(F.col("id").alias("message_id"), F.when(F.col("id") % 2 == 0, "Intención: a | Términos: b").alias("refined_content"))
    return pending.reindex_status(rows, content, _side(spark, sf_dir).withColumn("model_version", F.lit("v")), "v")


_NEW = "SELECT custkey, seg FROM (SELECT CAST(o_custkey AS BIGINT) AS custkey, o_orderpriority AS seg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1"


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("custkey"), F.col("c_mktsegment").alias("seg"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderpriority").alias("seg"), "o_orderkey")
    return old, new


@query(f"WITH n AS ({_NEW}) SELECT custkey, seg FROM n UNION ALL SELECT CAST(c_custkey AS BIGINT), c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM n)")
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _changes(spark, sf_dir)
    return store.upsert(old, new, ["custkey"], "o_orderkey")


@query(f"WITH n AS ({_NEW}) SELECT CAST(c_custkey AS BIGINT) AS custkey, coalesce(n.seg, c_mktsegment) AS seg FROM customer LEFT JOIN n ON c_custkey = n.custkey")
def update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _changes(spark, sf_dir)
    return store.update(old, store.keep_last(new, ["custkey"], "o_orderkey"), ["custkey"], ["seg"])


@query("SELECT CAST(c_custkey AS BIGINT) AS custkey, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS extra FROM customer")
def add_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.schema import struct

    old, _ = _changes(spark, sf_dir)
    return store.add_missing_columns(store.add_missing_columns(old, struct("custkey long, note string, extra long")), struct("note string"))


@query(
    """WITH c AS (SELECT doc_id, unnest(range((length(text) + 3799) // 3800)) AS i FROM documents WHERE length(text) > 4000)
    SELECT 'message_content' AS item, count(*) AS n FROM documents UNION ALL SELECT 'message_chunks', count(*) FROM c UNION ALL SELECT 'vectors', count(*) FROM labels UNION ALL SELECT 'orphaned_vectors', 0 UNION ALL
    SELECT 'vectors_dim_' || coalesce(CAST(CASE WHEN toxic = 1 THEN 384 WHEN quality = 0 THEN NULL ELSE 768 END AS VARCHAR), 'null'), count(*) FROM labels GROUP BY 1"""
)
def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    vectors = _side(spark, sf_dir).withColumn("entity_id", F.col("entity_id").cast("string"))
    return store.migration_report(rows.select(F.col("id").alias("message_id")), store.chunk_rows(rows, NOW, "text", None), vectors)


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def dedup_by_file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("file_hash"))
    return pending.new_files(files, files.filter("source = 'src0'")).select("doc_id", "file_hash")


# Segmentation -----------------------------------------------------------------

_FOLD = """WITH RECURSIVE v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
f AS (SELECT label, vec_id, k, 1 AS seq, e AS total FROM v WHERE k = 1 UNION ALL
SELECT v.label, v.vec_id, v.k, CASE WHEN list_inner_product(v.e, f.total) / sqrt(list_inner_product(f.total, f.total)) < 0.05 THEN f.seq + 1 ELSE f.seq END,
CASE WHEN list_inner_product(v.e, f.total) / sqrt(list_inner_product(f.total, f.total)) < 0.05 THEN v.e ELSE list_transform(list_zip(v.e, f.total), lambda z: z[1] + z[2]) END FROM f JOIN v ON v.label = f.label AND v.k = f.k + 1)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_segment_ids(segment.segment_numbers(embedding_vectors(spark, sf_dir), "label", ["vec_id"], "vector", 0.05), "label")


@query(f"{_FOLD} SELECT vec_id, label, CAST(seq AS INTEGER) AS segment_sequence, label || '_seg' || seq AS segment_id FROM f")
def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("vec_id", "label", "segment_sequence", "segment_id")


@query(f"{_FOLD} SELECT label, CAST(max(seq) AS INTEGER) AS segments, count(*) AS n FROM f GROUP BY label")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).groupBy("label").agg(F.max("segment_sequence").alias("segments"), F.count("*").alias("n"))


_WORDS = """w AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM conversations)),
c AS (SELECT conv_id, turn, word, count(*) AS n, min(pos) AS first FROM w WHERE regexp_full_match(word, '[a-z]{4,}') AND word NOT IN (%s) GROUP BY conv_id, turn, word),
m AS (SELECT conv_id, turn, word, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS k FROM c),
s AS (SELECT conv_id, word, count(*) AS n, min(turn * 100 + k) AS first FROM m WHERE k <= 5 GROUP BY conv_id, word),
r AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS k FROM s)""" % ", ".join(map(q.quoted, classify.STOPWORDS))


@query(f"WITH {_WORDS} SELECT conv_id, {q.title_case('max(word) FILTER (k = 1)')} || CASE WHEN count(*) = 1 THEN '' WHEN count(*) = 2 THEN ' & ' ELSE ' / ' END || coalesce({q.title_case('max(word) FILTER (k = 2)')}, '') AS segment_topic FROM r GROUP BY conv_id")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("segment_id"), "turn", F.col("text").alias("vectorizable_content"), classify.top_words(classify.topic_words(F.col("text"))).alias("topics"))
    with_topics = rows.join(rows.filter(F.size("topics") > 0).select("segment_id").distinct(), "segment_id", "left_semi")
    found = segment.segment_topics(with_topics, ["turn"])
    return found.select(F.col("segment_id").cast("long").alias("conv_id"), "segment_topic")


# Refinement -------------------------------------------------------------------

#: Answers made from whole texts: all fields; a dashed list; nothing understood; more terms than are shown; repeated fields.
_ANSWER = """CASE CAST((conv_id + turn) % 5 AS INT)
 WHEN 0 THEN 'Intención: [' || role || ']' || chr(10) || 'Términos: a, ' || role || ' , t' || turn || chr(10) || 'Tiene_Pregunta: SÍ' || chr(10) || 'Resumen: ' || flat
 WHEN 1 THEN 'Términos:' || chr(10) || '- ' || role || chr(10) || '- t' || turn || chr(10) || chr(10) || '- c' || chr(10) || 'Resumen: ' || flat
 WHEN 2 THEN 'nothing of the kind'
 WHEN 3 THEN 'entidades: SaaS (Software as a Service), b, c, d, e, f, g, h, ' || role || ', t' || turn
 ELSE 'INTENCION: ' || role || chr(10) || 'Resumen: one' || chr(10) || 'Resumen: ' || flat END"""
_FLAT_TURNS = f"(SELECT conv_id, turn, role, text, {q.strip(f'regexp_replace(text, {q.quoted(q.WHITE + "+")}, chr(32), chr(103))')} AS flat FROM conversations)"
#: What the answers hold, field by field, as whoever made them knows.
_FIELDS = f"""(SELECT conv_id, turn, text, k, CASE WHEN k IN (0, 4) THEN role END AS intent, CASE k WHEN 0 THEN ['a', role, 't' || turn] WHEN 1 THEN [role, 't' || turn]
 WHEN 3 THEN ['SaaS (Software as a Service)', 'b', 'c', 'd', 'e', 'f', 'g', 'h', role, 't' || turn] ELSE CAST([] AS VARCHAR[]) END AS entities, CASE WHEN k IN (0, 1, 4) THEN flat END AS summary, k = 0 AS has_question
 FROM (SELECT *, CAST((conv_id + turn) % 5 AS INT) AS k FROM {_FLAT_TURNS}))"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("flat", text.strip(text.collapse(F.col("text")))).withColumn("answer", F.expr(_ANSWER))
    return rows.select("conv_id", "turn", refine.parse_answer(F.col("answer"), F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


@query(
    f"""SELECT conv_id, turn, md5(CASE WHEN k = 2 THEN left(text, 500) ELSE concat_ws(' | ', 'Intención: ' || intent, 'Términos: ' || nullif(array_to_string(entities[:8], ', '), ''), 'Resumen: ' || nullif(summary, '')) END) AS refined_content,
    intent, array_to_string(entities, ',') AS entities, md5(summary) AS summary, CASE WHEN k = 2 THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS confidence, has_question FROM {_FIELDS}"""
)
def refiner_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).withColumns({"entities": F.array_join("entities", ","), "refined_content": F.md5("refined_content"), "summary": F.md5("summary")})


@query(f"SELECT conv_id, turn, md5(concat_ws(' ', intent, nullif(array_to_string(list_transform(entities, lambda e: trim(translate(e, '()', '  '))), ' '), ''), nullif(summary, ''))) AS keywords FROM {_FIELDS}")
def semantic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("conv_id", "turn", F.md5(refine.semantic_keywords(F.col("intent"), F.col("entities"), F.col("summary"))).alias("keywords"))


@query(
    """SELECT conv_id, turn, md5('Intención: ' || role || ' | Términos: ' || role || ', t' || turn || CASE WHEN turn % 2 = 0 AND text <> '' THEN ' | Resumen: ' || regexp_replace(text, '\\s+', ' ', 'g') ELSE '' END) AS refined_content FROM conversations"""
)
def refiner_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    made = refine.compose(F.col("role"), F.array("role", F.concat(F.lit("t"), "turn")), F.when(F.col("turn") % 2 == 0, text.collapse(F.col("text"))), F.lit(False), F.col("text"))
    return rows.select("conv_id", "turn", F.md5(made["refined_content"]).alias("refined_content"))


# Import -----------------------------------------------------------------------


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations.parquet as raw rows of chat-export archives, a few nodes hidden, blank or without a message."""
    message = lambda content, hidden: F.struct(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.struct(F.upper("role").alias("role"), F.lit(None).cast("string").alias("name")).alias("author"),
        F.struct(F.lit("text").alias("content_type"), F.array(content).alias("parts")).alias("content"),
        (F.lit(1.7e9) + F.col("turn")).alias("create_time"),
        F.struct(hidden.alias("is_visually_hidden_from_conversation"), F.array(F.struct(F.concat(F.lit("f"), "turn").alias("id"))).alias("attachments")).alias("metadata"),
    )
    body = message(F.when(F.col("turn") == 5, "   ").otherwise(F.col("text")), F.col("turn") == 6)
    nodes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.concat(F.lit("p"), "turn").alias("parent"), F.when(F.col("turn") != 7, body).alias("message")).alias("node"))
    talks = nodes.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("n"), "turn").alias("k"), "node")))).alias("mapping"))
    conversation = F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), F.when(F.col("conv_id") % 2 == 0, "T").alias("title"), F.when(F.col("conv_id") % 3 != 0, F.lit(1.7e9) + F.col("conv_id")).otherwise(0.0).alias("create_time"), "mapping"))
    return talks.select(F.lit("a.zip").alias("path"), F.lit("h").alias("file_hash"), F.lit(1).cast("long").alias("file_size"), F.array(F.lit("f0-x.png"), F.lit("f1.png")).alias("members"), conversation.alias("conversation"), F.lit(None).cast("string").alias("problem"), F.lit('{"id": "u"}').alias("user_info"))


@query(
    """SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS conversation_id, role AS author_role, md5(text) AS content, '2023-11-14 22:13:' || lpad(CAST(20 + turn AS VARCHAR), 2, '0') AS at, 'p' || turn AS parent_message_id,
    CASE WHEN conv_id % 2 = 0 THEN 'T' ELSE 'Untitled' END AS title, upper(role) AS original_role, CASE turn WHEN 0 THEN 'f0-x.png' WHEN 1 THEN 'f1.png' END AS attached FROM conversations WHERE turn NOT IN (5, 6, 7) AND trim(text) <> ''"""
)
def archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.messages(_export(spark, sf_dir), NOW)
    return found.select("id", "conversation_id", "author_role", F.md5("content").alias("content"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "parent_message_id", F.col("metadata.conversation_title").alias("title"), F.col("metadata.original_role").alias("original_role"), F.col("attachments")[0]["local_path"].alias("attached"))


_AT = "strftime(make_timestamp(1700000000000000 + {}(conv_id) FILTER (conv_id % 3 <> 0) * 1000000), '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT 'chatgpt' AS format, count(DISTINCT conv_id) AS total_conversations, {_AT.format("min")} AS first_at, {_AT.format("max")} AS last_at, '{{"id": "u"}}' AS user_info FROM conversations""")
def metadata_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f"{c}_at")
    return archive.metadata(_export(spark, sf_dir)).select("format", "total_conversations", at("first"), at("last"), "user_info")


# The whole way ----------------------------------------------------------------

_WHOLE = f"SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS conversation_id, CASE WHEN lower(role) IN ('user', 'assistant', 'system', 'tool') THEN lower(role) ELSE 'system' END AS author_role, {q.normalize('text')} AS t, {q.vectorizable(q.normalize('text'))} AS v FROM conversations"


def _embedded_sql(rows: str, width: int = 64) -> str:
    """CTEs to e (id, i, x): the hashing embedding of rows (id, v), without its zeros."""
    return f"""ew AS (SELECT id, unnest(regexp_extract_all(lower(v), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {rows}),
    eh AS (SELECT id, CAST(('0x' || left(md5(word), 8))::BIGINT % {width} AS INTEGER) AS i, CASE WHEN ('0x' || substr(md5(word), 9, 1))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM ew),
    es AS (SELECT id, i, sum(s) AS x FROM eh GROUP BY ALL), en AS (SELECT id, sqrt(sum(x * x)) AS norm FROM es GROUP BY id), e AS (SELECT es.id, es.i, es.x / en.norm AS x FROM es JOIN en ON es.id = en.id WHERE es.x <> 0)"""


def _topics_cte(stopwords: tuple[str, ...]) -> str:
    """CTEs to topics (id, topics) of rows m (id, t)."""
    return f"""tw AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM m)),
    tc AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM tw WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN ({", ".join(map(q.quoted, stopwords))}) GROUP BY id, word),
    tr AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS k FROM tc), topics AS (SELECT id, string_agg(word, ',' ORDER BY k) AS topics FROM tr WHERE k <= 5 GROUP BY id)"""


_RULED_WHOLE = f"""m AS ({_WHOLE}), {_topics_cte(classify.STOPWORDS)}, i AS (SELECT id, split_part(r, '|', 1) AS intent, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence FROM (SELECT id, {_INTENT} AS r FROM m))"""


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.components import PROFILES
    from corvane.plans.ingest import processed

    return processed(balanced(conversation_messages(spark, sf_dir)), PROFILES["lite"])


@query(
    f"""WITH {_RULED_WHOLE}, {_embedded_sql("m")}, x AS (SELECT id, sum((i + 1) * x) AS total FROM e GROUP BY id)
    SELECT m.id, conversation_id, author_role, md5(t) AS clean_content, md5(v) AS vectorizable_content, intent, confidence AS intent_confidence, CASE WHEN intent = 'social' THEN '' ELSE coalesce(topics, '') END AS topics,
    starts_with(intent, 'question_') AS is_question, intent = 'command' AS is_command, round(coalesce(total, 0), 6) AS vector_sum FROM m JOIN i ON m.id = i.id LEFT JOIN topics ON m.id = topics.id LEFT JOIN x ON m.id = x.id"""
)
def ingest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, classify, embed: the columns of the messages table, texts as digests, the vector as a weighted sum."""
    total = F.aggregate(F.transform("vector", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    found = _processed(spark, sf_dir).withColumns({"topics": F.array_join("topics", ","), "clean_content": F.md5("clean_content"), "vectorizable_content": F.md5("vectorizable_content"), "vector_sum": rounded(total)})
    return found.select("id", "conversation_id", "author_role", "clean_content", "vectorizable_content", "intent", "intent_confidence", "topics", "is_question", "is_command", "vector_sum")


_ASKED = "what is thon and wher?"


@query(
    f"""WITH {_RULED_WHOLE}, rows AS (SELECT id, v FROM m WHERE author_role = 'user' UNION ALL SELECT '?', {q.quoted(_ASKED)}), {_embedded_sql("rows")},
    s AS (SELECT m.id, coalesce(sum(a.x * b.x), 0) AS score FROM m LEFT JOIN e a ON a.id = m.id LEFT JOIN e b ON b.id = '?' AND a.i = b.i WHERE m.author_role = 'user' GROUP BY m.id)
    SELECT CAST(row_number() OVER (ORDER BY score DESC, s.id) AS INTEGER) AS rank, s.id, conversation_id, intent, round(score, 6) AS score, t AS clean_content FROM s JOIN m ON s.id = m.id JOIN i ON s.id = i.id ORDER BY score DESC, s.id LIMIT 10"""
)
def flagship_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in, rules and embedding applied, the ten nearest to a question among user messages out."""
    rows = _processed(spark, sf_dir).filter("author_role = 'user'")
    asked = spark.createDataFrame([(_ASKED,)], "text string").select(embed.hashing_embedding(F.col("text"), 64).alias("v")).first()["v"]
    found = retrieval.vector_search(rows, list(asked), 10, key="id")
    return found.select("rank", "id", "conversation_id", "intent", rounded("score").alias("score"), "clean_content")


flagship = flagship_search


# Searches over joined tables --------------------------------------------------


def _documents_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("conversation_id"), F.col("lang").alias("segment_topic"), F.lit("unknown").alias("intent"), F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("topics"))


@query(
    f"""WITH s AS (SELECT CAST(vec_id AS VARCHAR) AS id, score FROM ({_SCORES}) WHERE label <> 9), f AS (SELECT id, score, text, lang FROM s JOIN documents ON id = CAST(doc_id AS VARCHAR) WHERE lang = 'en')
    SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score, lang AS label, md5(CASE WHEN length(g) > 200 THEN left(g, 197) || '...' ELSE g END) AS snippet FROM (SELECT *, {_FLAT} AS g FROM f) ORDER BY score DESC, id LIMIT 10"""
)
def filtered_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors joined with their messages, one topic of them, presented as the search shows them; vectors of chunks don't count."""
    kind = F.when(F.col("label") == 9, "chunk").otherwise("message")
    vectors = embedding_vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("entity_id"), kind.alias("entity_type"), "vector")
    found = retrieval.presented(retrieval.vector_search(vectors, _probe(spark, sf_dir), 10, _documents_as_messages(spark, sf_dir), {"segment_topic": "en", "unknown": "x"}))
    return found.select("id", "rank", rounded("score").alias("score"), "label", F.md5("snippet").alias("snippet"))


_WIDE = f"SELECT v.vec_id, v.label, sum(v.x * p.x) AS score FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) v JOIN (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) p ON v.i = p.i GROUP BY ALL"


@query(
    f"""WITH s AS (SELECT lpad(CAST(vec_id AS VARCHAR), 19, '0') AS id, score FROM ({_WIDE}) WHERE vec_id % 50 <> 3), f AS (SELECT s.id, score FROM s JOIN documents ON CAST(s.id AS BIGINT) = doc_id WHERE lang = 'en')
    SELECT CAST(id AS BIGINT) AS vec_id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM f ORDER BY score DESC, id LIMIT 20"""
)
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a store through its index, a fiftieth of them taken away since it was made, messages of one topic wanted; ids have leading zeros, so that they sort as numbers."""
    from corvane.operators.vectorindex import VectorIndex

    rows = embedding_vectors(spark, sf_dir)
    name = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    made = store.Store(spark, f"{_shared_folder(spark)}/corvane-stores/{uuid.uuid4().hex}")
    made.write("vectors", rows.select(name("vec_id").alias("entity_id"), F.lit("message").alias("entity_type"), "vector"))
    messages = table(spark, sf_dir, "documents").select(name("doc_id").alias("id"), F.col("lang").alias("segment_topic"))
    index = VectorIndex(spark, f"{made.root}/_vectors")
    index.build(made)
    made.upsert("vectors", rows.filter("vec_id % 50 = 3").select(name("vec_id").alias("entity_id"), F.lit("message").alias("entity_type"), F.lit(None).cast("array<float>").alias("vector")))
    asked = rows.orderBy("vec_id").select("vector").first()["vector"]
    found = index.search(made, list(asked), 20, messages, {"segment_topic": "en"})
    return found.select(F.col("id").cast("long").alias("vec_id"), "rank", rounded("score").alias("score"))


@query(_bm25_sql([_term("wher")], f"SELECT d.doc_id FROM ({_term('wher')}) d JOIN documents m ON d.doc_id = m.doc_id WHERE m.lang = 'en' AND m.source = 'src1'"))
def filtered_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search in the messages of one topic and conversation; scores come from all documents."""
    rows = _documents_as_messages(spark, sf_dir).withColumn("doc_id", F.col("id").cast("long"))
    messages = retrieval.equality_filters(rows, {"segment_topic": "en", "conversation_id": "src1"})
    found = fulltext.text_search(fulltext.postings(rows, "doc_id", ("content",)), fulltext.lengths(rows, "doc_id", ("content",)), "wher", 20, messages, "doc_id", ("content",))
    return found.select(F.col("doc").alias("doc_id"), rounded("bm25").alias("bm25"), "rank", rounded("score").alias("score"))


# Incremental runs over a store ------------------------------------------------


def _store(spark: SparkSession, sf_dir: str, profile: str, messages: DataFrame | None = None) -> store.Store:
    """A store with messages ingested (default: the conversations), below the session's shared folder."""
    from corvane.plans.components import PROFILES
    from corvane.plans.ingest import ingest

    folder = _shared_folder(spark)
    made = store.Store(spark, f"{folder}/corvane-stores/{uuid.uuid4().hex}")
    ingest(made, conversation_messages(spark, sf_dir) if messages is None else messages, PROFILES[profile], NOW)
    return made


#: The stand-in refiner's answer to a text cut to 1,500 characters at a word's end.
_ECHO = f"""c AS (SELECT *, list_filter(string_split(CASE WHEN length(v) > 1500 THEN regexp_replace(left(v, 1500), ' [^ ]*$', '') || '...' ELSE v END, ' '), lambda w: w <> '') AS words FROM m),
 a AS (SELECT *, list_sort(list_transform(list_distinct(list_filter(list_transform(words, lambda w: trim(w, ',.;')), lambda w: w <> '')), lambda w: [lpad(CAST(100000 - length(w) AS VARCHAR), 6, '0'), w])) AS found FROM c),
 r AS (SELECT *, trim(array_to_string(words[:3], ' '), '[]') AS intent, list_filter(list_transform(string_split(trim(array_to_string(list_transform(found[:3], lambda p: p[2]), ', '), '[]'), ','), lambda w: {q.strip("w")}), lambda w: w <> '') AS topics, {q.strip("array_to_string(words[:12], ' ')")} AS summary FROM a)"""


def _reindexed_sql(rows: str) -> str:
    """What a full re-index with the stand-in refiner makes of rows (id, v)."""
    return f"""WITH m AS ({rows}), {_ECHO}, x AS (SELECT *, concat_ws(' | ', 'Intención: ' || nullif(intent, ''), 'Términos: ' || nullif(array_to_string(topics, ', '), ''), 'Resumen: ' || nullif(summary, '')) AS refined FROM r)
    SELECT id, md5(CASE WHEN refined = '' THEN '' ELSE refined END) AS refined_content, md5(concat_ws(' ', nullif(intent, ''), nullif(array_to_string(list_transform(topics, lambda e: trim(translate(e, '()', '  '))), ' '), ''), nullif(summary, ''))) AS keywords,
    CASE WHEN intent = '' THEN 'unknown' ELSE intent END AS intent, array_to_string(topics, ',') AS topics, false AS is_question, 64 AS vector_dim, 'hashing_dim64' AS model_version FROM x"""


@query(_reindexed_sql(_WHOLE))
def reindex_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after ingest and a full re-index: what all three tables hold."""
    return _reindexed(_store(spark, sf_dir, "express"))


def _reindexed(made: store.Store) -> DataFrame:
    from corvane.plans import reindex
    from corvane.plans.components import PROFILES

    reindex.reindex_all(made, PROFILES["express"], NOW)
    content = made.read("message_content").select(F.col("message_id").alias("id"), F.md5("refined_content").alias("refined_content"))
    vectors = made.read("vectors").select(F.col("entity_id").alias("id"), "vector_dim", "model_version")
    rows = made.read("messages").select("id", F.md5("refined_content").alias("keywords"), "intent", F.array_join("topics", ",").alias("topics"), "is_question")
    return rows.join(content, "id").join(vectors, "id").select("id", "refined_content", "keywords", "intent", "topics", "is_question", "vector_dim", "model_version")


@query(
    f"""WITH m AS ({_WHOLE}), l AS (SELECT id, v FROM m WHERE length(v) > 4000), c AS (SELECT count(*) AS n FROM (SELECT unnest(range((length(v) + 3799) // 3800)) FROM l)), t AS (SELECT count(*) AS n FROM m)
    SELECT 'outdated' AS run, 0 AS first, CAST(t.n AS BIGINT) AS forced, 0 AS again FROM t UNION ALL SELECT 'refined', 0, t.n, 0 FROM t UNION ALL SELECT 'dimension', t.n + c.n, 0, 0 FROM t, c UNION ALL SELECT 'rebuilt', t.n, t.n, 0 FROM t"""
)
def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each run takes at first, when forced or made again, and once nothing is pending."""
    from dataclasses import replace

    from corvane.plans import reindex
    from corvane.plans.components import PROFILES

    lite, made = PROFILES["lite"], _store(spark, sf_dir, "lite")
    other = replace(lite, dimension=32)
    refined = lambda **more: reindex.refine_pending(made, lite, NOW, chunks=False, **more)["messages"]
    counted = [
        ("outdated", reindex.revectorize_outdated(made, lite, NOW), reindex.revectorize_outdated(made, lite, NOW, force=True), reindex.revectorize_outdated(made, lite, NOW)),
        ("refined", refined(), refined(force=True), refined()),
        ("dimension", sum(reindex.revectorize_dimension(made, other, NOW).values()), sum(reindex.revectorize_dimension(made, other, NOW).values()), 0),
        ("rebuilt", reindex.rebuild(made, lite, NOW, segments=False)["classified"], reindex.rebuild(made, lite, NOW, vectors_only=True, resume=False, segments=False)["vectors"], reindex.rebuild(made, lite, NOW, vectors_only=True, resume=True, segments=False)["vectors"]),
    ]
    return spark.createDataFrame(counted, "run string, first long, forced long, again long")


#: Whole documents behind a long word in parentheses, as messages; many are over 4,000 characters, so they have chunks.
_LONG_TEXT = "'(Incomprehensibilities' || doc_id % 7 || ') ' || text"
_LONG = f"SELECT CAST(doc_id AS VARCHAR) AS id, {q.vectorizable(q.normalize(f'({_LONG_TEXT})'))} AS v FROM documents"
_ENTITIES = f"""w AS ({_LONG}), m AS (SELECT id, 'message' AS entity_type, left(v, 8000) AS v FROM w
    UNION ALL SELECT id || '_chunk' || k, 'chunk', substr(v, 3800 * (k - 1) + 1, 3800) FROM (SELECT id, v, unnest(range(1, (length(v) + 3799) // 3800 + 1)) AS k FROM w WHERE length(v) > 4000))"""


def _long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("conversation_id"), F.lit("user").alias("author_role"), F.expr(_LONG_TEXT).alias("content"), F.lit("text").alias("content_type"), F.timestamp_seconds("doc_id").alias("timestamp"))


@query(_reindexed_sql(_LONG))
def reindex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full re-index of long messages with parentheses among their terms."""
    return _reindexed(_store(spark, sf_dir, "express", _long_messages(spark, sf_dir)))


@query(
    f"""WITH {_ENTITIES}, {_ECHO}, x AS (SELECT *, concat_ws(' | ', 'Intención: ' || nullif(intent, ''), 'Términos: ' || nullif(array_to_string(topics, ', '), ''), 'Resumen: ' || nullif(summary, '')) AS refined FROM r)
    SELECT id, entity_type, md5(CASE entity_type WHEN 'chunk' THEN left(refined, 4000) ELSE refined END) AS refined FROM x"""
)
def refine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined texts of long messages and of their chunks."""
    from corvane.plans import reindex
    from corvane.plans.components import PROFILES

    made = _store(spark, sf_dir, "express", _long_messages(spark, sf_dir))
    reindex.refine_pending(made, PROFILES["express"], NOW, force=True)
    messages = made.read("messages").select("id", F.lit("message").alias("entity_type"), F.md5("refined_content").alias("refined"))
    return messages.unionByName(made.read("message_chunks").select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("entity_type"), F.md5("refined_text").alias("refined")))


@query(
    f"""WITH {_ENTITIES}, {_embedded_sql("m", 32)}, x AS (SELECT id, sum((i + 1) * CAST(CAST(x AS FLOAT) AS DOUBLE)) AS total FROM e GROUP BY id)
    SELECT m.id, entity_type, 32 AS vector_dim, 'hashing_dim32' AS model_version, round(coalesce(total, 0), 6) AS vector_sum FROM m LEFT JOIN x ON m.id = x.id"""
)
def dimension_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of long messages and of their chunks after a change of dimension, each as a weighted sum."""
    from dataclasses import replace

    from corvane.plans import reindex
    from corvane.plans.components import PROFILES

    made = _store(spark, sf_dir, "lite", _long_messages(spark, sf_dir))
    reindex.revectorize_dimension(made, replace(PROFILES["lite"], dimension=32), NOW)
    total = F.aggregate(F.transform("vector", lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.read("vectors").select(F.col("entity_id").alias("id"), "entity_type", "vector_dim", "model_version", rounded(total).alias("vector_sum"))


# Counts kept by bucket ----------------------------------------------------------

#: Documents as messages: three to a conversation, their language the topic; one of fifty loses its topic later on.
_COUNTED = "SELECT doc_id, 'c' || CAST(floor(doc_id / 3) AS BIGINT) AS talk, CASE WHEN doc_id % 50 <> 3 THEN lang END AS topic, CASE WHEN doc_id % 50 = 3 THEN 'command' ELSE source END AS intent FROM documents"


def _counted(spark: SparkSession, sf_dir: str):
    """Counts of a store that was written to after they were made."""
    from corvane.operators.rollups import Rollups

    made = store.Store(spark, f"{_shared_folder(spark)}/corvane-stores/{uuid.uuid4().hex}")
    made.initialize()
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("c"), F.floor(F.col("doc_id") / 3)).alias("conversation_id"), F.col("lang").alias("segment_topic"), F.col("source").alias("intent"), F.timestamp_seconds("doc_id").alias("timestamp"))
    made.write("messages", rows)
    made.write("vectors", store.vector_rows(embedding_vectors(spark, sf_dir), "vec_id", "message", "v", NOW))
    counts = Rollups(made)
    counts.refresh("messages")
    counts.refresh("vectors")
    late = rows.filter("doc_id % 50 = 3")
    made.upsert("messages", late.withColumns({"segment_topic": F.lit(None).cast("string"), "intent": F.lit("command")}))
    return counts


@query(
    f"""SELECT topic AS segment_topic, count(*) AS messages, count(DISTINCT talk) AS conversations, min(doc_id) AS first, max(doc_id) AS last FROM ({_COUNTED}) WHERE topic IS NOT NULL GROUP BY topic"""
)
def rollup_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic roll-up from counts kept by bucket, after a change."""
    found = _counted(spark, sf_dir).topic_rollup()
    return found.select("segment_topic", "messages", "conversations", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"))


@query(
    f"""WITH d AS ({_COUNTED}) SELECT 'intent' AS kind, intent AS value, count(*) AS n FROM d GROUP BY intent UNION ALL SELECT 'total', 'messages', count(*) FROM d UNION ALL SELECT 'total', 'conversations', count(DISTINCT talk) FROM d
    UNION ALL SELECT 'topics', 'topics', count(DISTINCT topic) FROM d UNION ALL SELECT 'topics', 'messages', count(topic) FROM d UNION ALL SELECT 'dimension', CAST(len(embedding) AS VARCHAR), count(*) FROM embeddings GROUP BY ALL"""
)
def rollup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, intents and dimensions from counts kept by bucket, after a change."""
    counts = _counted(spark, sf_dir)
    pairs = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.inline(F.array(*[F.struct(F.lit(c.removeprefix("total_")).alias("value"), F.col(c).alias("n")) for c in df.columns])))
    of = lambda df, kind: df.toDF("value", "n").select(F.lit(kind).alias("kind"), F.col("value").cast("string").alias("value"), "n")
    return of(counts.intents(), "intent").union(pairs(counts.totals(), "total")).union(pairs(counts.topic_totals(), "topics")).union(of(counts.dimensions(), "dimension"))


# Archives as files --------------------------------------------------------------

_PER_ARCHIVE = 10


def _archive_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The conversations written as archives of ten: ZIP files, every fifth a plain JSON file, every fifth cut off before its end."""
    from corvane.sources.stores import opened

    talks = _export(spark, sf_dir).select((F.get_json_object("conversation", "$.conversation_id").cast("long")).alias("conv_id"), "conversation")
    folder = f"{_shared_folder(spark)}/corvane-archives/{uuid.uuid4().hex}"

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        kind, store_, inside = number % 5, *opened(folder)
        body = ("[" + ",\n".join(rows.sort_by("conv_id")["conversation"].to_pylist()) + "]").encode()
        if kind == 1:
            raw, name = body, f"talks-{number}.json"
        else:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(archive.MEMBER, body)
                z.writestr("f0-x.png", b"")
                z.writestr("f1.png", b"")
            raw, name = packed.getvalue(), f"talks-{number}.zip"
        if kind == 3:
            raw = raw[: len(raw) // 2]
        store_.create_dir(inside, recursive=True)
        with store_.open_output_stream(f"{inside}/{name}") as out:  # a task that is tried again writes the same
            out.write(raw)
        return pa.table({"path": [f"{folder}/{name}"]})

    written = talks.withColumn("archive", F.floor(F.col("conv_id") / _PER_ARCHIVE).cast("long")).groupBy("archive").applyInArrow(write, "path string")
    return [r["path"] for r in written.collect()]  # a row per file


_FILE_OF = f"CAST(floor(conv_id / {_PER_ARCHIVE}) AS BIGINT)"


@query(
    f"""SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS conversation_id, role AS author_role, md5(text) AS content, '2023-11-14 22:13:' || lpad(CAST(20 + turn AS VARCHAR), 2, '0') AS at,
    CASE WHEN {_FILE_OF} % 5 = 1 THEN NULL WHEN turn = 0 THEN 'f0-x.png' WHEN turn = 1 THEN 'f1.png' END AS attached FROM conversations WHERE turn NOT IN (5, 6, 7) AND trim(text) <> '' AND {_FILE_OF} % 5 <> 3"""
)
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of written archives, packed and plain, read back by the data source; of those cut off nothing comes."""
    found = archive.messages(archive.conversations(spark, _archive_files(spark, sf_dir)), NOW)
    return found.select("id", "conversation_id", "author_role", F.md5("content").alias("content"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), F.get("attachments", F.lit(0))["local_path"].alias("attached"))


@query(
    f"""SELECT 'talks-' || file || CASE WHEN file % 5 = 1 THEN '.json' ELSE '.zip' END AS file, CASE WHEN file % 5 = 3 THEN 0 ELSE n END AS conversations, file % 5 = 3 AS wrong,
    CASE WHEN file % 5 <> 3 THEN 'chatgpt' END AS format, CASE file % 5 WHEN 3 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence
    FROM (SELECT {_FILE_OF} AS file, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1)"""
)
def archive_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the directories of the written archives tell, beside what reading them gives."""
    paths = _archive_files(spark, sf_dir)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    read = archive.conversations(spark, paths).groupBy(name).agg(F.count("conversation").alias("conversations"), (F.count("problem") > 0).alias("wrong"))
    return read.join(archive.detect(spark, paths).select(name, "format", "confidence"), "file")


# Segments of a store --------------------------------------------------------------

_SEGMENTED = f"""{_FOLD}, c AS (SELECT label, seq, 't' || (vec_id % 3) AS topic, count(*) AS n, min(vec_id) AS first FROM f GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, seq ORDER BY n DESC, first) AS place FROM c),
    g AS (SELECT label, seq, max(CASE WHEN place = 1 THEN upper(topic) END) AS a, max(CASE WHEN place = 2 THEN upper(topic) END) AS b, max(place) AS m FROM r GROUP BY ALL)
    SELECT vec_id, CAST(f.seq AS INTEGER) AS segment_sequence, f.label || '_seg' || f.seq AS segment_id, CASE m WHEN 1 THEN a WHEN 2 THEN a || ' & ' || b ELSE a || ' / ' || b END AS segment_topic FROM f JOIN g ON f.label = g.label AND f.seq = g.seq"""


def _vector_store(spark: SparkSession, sf_dir: str) -> tuple[store.Store, DataFrame]:
    """A store of the embeddings as messages with vectors, a label's being a conversation; and the messages with their vectors."""
    made = store.Store(spark, f"{_shared_folder(spark)}/corvane-stores/{uuid.uuid4().hex}")
    made.initialize()
    rows = embedding_vectors(spark, sf_dir).select(
        F.lpad(F.col("vec_id").cast("string"), 19, "0").alias("id"), F.col("label").cast("string").alias("conversation_id"), F.lit("user").alias("author_role"),
        F.timestamp_seconds("vec_id").alias("timestamp"), F.array(F.concat(F.lit("t"), F.col("vec_id") % 3)).alias("topics"), F.lit("").alias("vectorizable_content"), "vector",
    )
    made.upsert("messages", rows.drop("vector"))
    made.upsert("vectors", store.vector_rows(rows, "id", "message", "v", NOW))
    return made, rows


def _segments_of(made: store.Store) -> DataFrame:
    return made.read("messages").select(F.col("id").cast("long").alias("vec_id"), "segment_sequence", "segment_id", "segment_topic")


@query(_SEGMENTED)
def segment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that a run over the store gives to its messages."""
    from corvane.plans import reindex

    made, _ = _vector_store(spark, sf_dir)
    reindex.segment_pending(made, 0.05)
    return _segments_of(made)


@query(_SEGMENTED)
def segment_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments from a stream of the messages in two parts, one of fifty coming late."""
    from corvane.streaming.segments import follow

    made, rows = _vector_store(spark, sf_dir)
    folder = f"{_shared_folder(spark)}/corvane-streams/{uuid.uuid4().hex}"
    late = F.col("id").cast("long") % 50 == 3
    for part in (~late, late):
        rows.filter(part).select("conversation_id", "id", "timestamp", "vector").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("conversation_id string, id string, timestamp timestamp, vector array<float>").parquet(f"{folder}/in")
        follow(made, stream, f"{folder}/seen", 0.05).awaitTermination()
    return _segments_of(made)


# All code blocks of a text -----------------------------------------------------------

_FENCED = "text || '\n```python\nprint(' || doc_id || ')\n```\nafter\n\n```\n' || text || '\n  ```' || CASE WHEN doc_id % 3 = 0 THEN '\n```sql\nselect 1\n```' ELSE '' END"
_LINES = "length({0}) - length(replace({0}, chr(10), ''))"


@query(
    f"""WITH d AS (SELECT doc_id, {_FENCED.replace(chr(10), "' || chr(10) || '")} AS t FROM documents),
    m AS (SELECT doc_id, regexp_extract_all(t, '```(\\w+)?\\n(.*?)```', 0, 's') AS w, regexp_extract_all(t, '```(\\w+)?\\n(.*?)```', 1, 's') AS l, regexp_extract_all(t, '```(\\w+)?\\n(.*?)```', 2, 's') AS c, string_split_regex(t, '```(?:\\w+)?\\n(?:.*?)```', 's') AS b FROM d),
    x AS (SELECT *, CAST(unnest(range(1, len(w) + 1)) AS INTEGER) AS block FROM m)
    SELECT doc_id, block, coalesce(nullif(l[block], ''), 'text') AS language, md5({q.strip("c[block]")}) AS code,
    CAST({_LINES.format("array_to_string(b[1:block], '')")} + {_LINES.format("coalesce(array_to_string(w[1:block - 1], ''), '')")} + 1 AS INTEGER) AS line FROM x"""
)
def code_blocks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fenced block of whole texts, with its language and line."""
    rows = balanced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(_FENCED).alias("t"))
    found = rows.select("doc_id", F.posexplode(text.code_blocks(F.col("t"))).alias("k", "b"))
    return found.select("doc_id", (F.col("k") + 1).alias("block"), F.col("b.language").alias("language"), F.md5("b.code").alias("code"), F.col("b.line").cast("int").alias("line"))
