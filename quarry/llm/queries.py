"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, chat, decontam, jaccard, linededup, quality, secrets, sharding, topk, urlrules
from quarry.llm.common import table


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10, scale=1024)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *_tokenizer())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op6_n_gram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, top=90)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlrules.contract_rules() + urlrules.default_patterns()
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24, carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scans, op2_exact_top_k, op3_chat_formatting, op4_byte_level_bpe, op5_line_dedup, op6_n_gram_jaccard_join, op7_quality_classifier, op8_url_filters, op9_sharding, op10_benchmark_decontamination)}

ORACLES: dict[str, str] = {
    "op2_exact_top_k": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
          WHERE embedding IS NOT NULL),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op8_url_filters": r"""
        WITH u AS (
          SELECT page_id,
                 CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        m AS (
          SELECT page_id, max_by(h || r.p, length(h || r.p)) AS rule, max_by(v, length(h || r.p)) AS v
          FROM p JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id),
        b AS (
          SELECT page_id, list_min(list_filter(string_split(host, '.')[:-2], lambda l: regexp_full_match(l, '(PAIRS)'))) AS hit FROM p)
        SELECT p.page_id, p.host, p.path, m.rule, replace(hit, '-', ' ') AS pattern,
               coalesce(m.v, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM p JOIN b USING (page_id) LEFT JOIN m USING (page_id)""".replace("PAIRS", f"(?:{'|'.join(urlrules.SPAM_FIRST.split())})-(?:{'|'.join(urlrules.SPAM_SECOND.split())})"),
    "op3_chat_formatting": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        n AS (
          SELECT *, regexp_replace(text, '(\\*(?:</?turn>|<next>))', '\\\1', 'g') AS escaped,
                 lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior
          FROM t)
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(length(escaped) + CASE WHEN prior = role THEN 8 ELSE length(replace(replace(role, '\', '\\'), chr(10), '\n')) + 16 END)::BIGINT AS formatted_chars
        FROM n GROUP BY conv_id""",
    "op5_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        r AS (
          SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40
          GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        d AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.keeper AS dropped FROM l LEFT JOIN r ON l.k = r.k)
        SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
