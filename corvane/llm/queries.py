"""The registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chat, codebooks, editjoin, exact, interaction, minhash, packing, quality, sharding, spiece, tiles, tokenfile, tokens
from corvane.llm.common import documents, token_file


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingle sets of similarity 0.8 or more, linked and joined into components."""
    return minhash.near_groups(documents(spark, sf_dir), width=2, threshold_percent=80).drop("row_hash")


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, each source in its share of the corpus."""
    return packing.packed(documents(spark, sf_dir), token_file("word_bpe_49k.json"), end_id=1, window=2048)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of conversations, calls linked with results, ordered, validated, as canonical JSON."""
    found = chat.formatted(chat.as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), chat.REPLY_TOOL)
    return found.withColumnsRenamed({"conversation": "conv_id", "message": "turn"})


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines, linked if two edits or fewer apart."""
    return editjoin.near_lines(documents(spark, sf_dir), threshold=2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exact.exact_groups(documents(spark, sf_dir)).drop("ties")


def op6_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, equal texts together."""
    return sharding.byte_shards(documents(spark, sf_dir), shards=8)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    return spiece.round_trips(documents(spark, sf_dir), token_file("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokens.token_counts(documents(spark, sf_dir), token_file("word_bpe_49k.json"), limit=2048)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and risk-controlled verdict of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.judged(documents(spark, sf_dir), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.SCORES)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, written and read back."""
    return tokenfile.token_files(documents(spark, sf_dir), token_file("byte_bpe_50k.json"), end_id=0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as eight codes of 16 entries, with its error."""
    return codebooks.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of cosine 0.9 or more, linked and joined into components, whatever their labels."""
    return tiles.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove under each of their 120 orders, by language."""
    return interaction.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_mixture_packing, op3_chat_formatting, op4_line_dedup, op5_exact_dedup, op6_byte_sharding, op7_sentencepiece, op8_token_counts, op9_quality_rules, op10_token_files, op11_vector_codes, op12_embedding_near_dedup, op13_filter_interaction)}


def _lloyd_sql(rounds: int = codebooks.ROUNDS) -> str:
    """DuckDB SQL of op11: rounds of assignments and integer means, unrolled."""
    parts = [
        """good AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, CAST(floor(4096 * embedding[i + 1]::DOUBLE) AS BIGINT) AS q FROM (SELECT r, embedding, len(embedding) // 8 AS w, unnest(range(len(embedding))) AS i FROM good)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, q AS c FROM v WHERE r <= 16)"""
    ]
    for k in range(rounds + 1):
        parts.append(f"""d{k} AS (SELECT r, part, entry, sum((q - c) * (q - c)) AS d FROM v JOIN b{k} USING (part, pos) GROUP BY r, part, entry),
        a{k} AS MATERIALIZED (SELECT r, part, min(entry) AS entry, any_value(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY r, part) AS least FROM d{k}) WHERE d = least GROUP BY r, part)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT part, entry, pos, sum(q) AS s, count(*) AS n FROM v JOIN a{k} USING (r, part) GROUP BY part, entry, pos),
        b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))""")
    return f"""WITH {", ".join(parts)},
        h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}),
        c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM good JOIN c USING (r), h"""


#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL = {
    "op3_chat_formatting": """
        WITH r AS (SELECT DISTINCT conv_id, turn, role, text, lower(role) AS kind FROM conversations),
        k AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run,
            max(CASE WHEN kind = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS answer,
            max(CASE WHEN kind = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS question FROM r)
        SELECT conv_id, turn, role,
            CASE kind WHEN 'user' THEN CASE WHEN answer IS NULL THEN 'open' ELSE 'answered' END WHEN 'assistant' THEN CASE WHEN question IS NULL THEN 'orphan' ELSE 'result' END END AS link,
            CAST(turn - min(turn) OVER (PARTITION BY conv_id, run) AS BIGINT) AS depth,
            CASE WHEN kind = 'user' THEN coalesce(text, '') <> '' END AS valid,
            CASE WHEN kind = 'user' AND coalesce(text, '') = '' THEN '$.prompt: shorter than 1' END AS problem,
            CASE WHEN kind = 'user' THEN '{"content":null,"role":' || to_json(role) || ',"tool_calls":[{"arguments":{"prompt":' || to_json(coalesce(text, '')) || ',"turn":' || turn || '},"id":"call_' || turn || '","name":"reply"}]}'
            ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || CASE WHEN kind = 'assistant' THEN ',"tool_call_id":"call_' || (turn - 1) || '"}' ELSE '}' END END AS json
        FROM k
    """,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op11_vector_codes": _lloyd_sql(),
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.9),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """,
    "op13_filter_interaction": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
        f AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
            regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        j AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
        k AS (SELECT unnest(range(5)) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT array_to_string(list_transform(p, lambda x: chr(CAST(65 + x AS INTEGER))), '') AS filter_order, CAST(i + 1 AS INTEGER) AS step, p[i + 1] AS own, p[1:i] AS earlier FROM o, k),
        r AS (SELECT part, filter_order, step, own, good, toxic, fails[own + 1] AS now, len(list_filter(earlier, lambda x: fails[x + 1])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n FROM j, s),
        c AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT now) AS kept, count(*) FILTER (now AND NOT gone) AS removed, count(*) FILTER (now AND gone) AS redundant,
            count(*) FILTER (now AND n = 1) AS unique_fails, count(*) FILTER (now AND NOT gone AND good) AS good_lost, count(*) FILTER (now AND NOT gone AND toxic) AS toxic_lost FROM r GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
    """,
}
