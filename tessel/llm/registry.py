"""The thin queries of this subpackage. Each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import bpe, dac

    encoder = bpe.library_ids(_vocabulary("word_bpe_49k.json"))
    return dac.read_token_ids(dac.write_token_ids(table(spark, sf_dir, "documents"), encoder, end_id=2))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import pages

    return pages.extract_text(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import language

    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import bpe, packing

    encoder = bpe.library_ids(_vocabulary("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), encoder, end_id=2, capacity=1024)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import bpe

    return bpe.bpe_digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import rabitq

    return rabitq.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import substrings

    return substrings.remove_duplicates(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import chat

    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessel.llm import multiindex

    return multiindex.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_ids, op2_html_text, op3_language_id, op4_best_fit_packing, op5_byte_bpe, op6_embedding_near_dedup, op7_substring_dedup, op8_simhash, op9_chat_format, op10_nearest_neighbours]
    return {f.__name__: f for f in found}


_VECTORS = """WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.n)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY x) ON vec_id = x LEFT JOIN (SELECT n, min(c) AS c FROM r GROUP BY n) ON vec_id = n"""

_SUBSTRINGS = """WITH d AS (
    SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words FROM documents
), p AS (
    SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word, words FROM d
), w AS (
    SELECT doc_id, pos, word, CASE WHEN pos + 49 <= len(words) THEN array_to_string(words[pos : pos + 49], ' ') END AS span FROM p
), f AS (
    SELECT doc_id, pos, word, span IS NOT NULL AND min(doc_id) OVER (PARTITION BY span) < doc_id AS again FROM w
), c AS (
    SELECT doc_id, pos, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, count(*) FILTER (gone)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id, len(d.words)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_near_dedup": _VECTORS, "op7_substring_dedup": _SUBSTRINGS}
