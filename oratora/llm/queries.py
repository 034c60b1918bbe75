"""The thin query layer: each query applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontaminate, html_text, lm, packing, pii, quality_rules, simhash, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = {k: F.col(f"__{k}") for k in pii.KINDS}
    return found.select(
        F.col("__id").alias("doc_id"),
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()],
        F.sha2(pii.as_text(base), 256).alias("base_sha256"),
        pii.as_text(base | {pii.TERM: F.col("__terms")}).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which of several rules rejects a text depends on the estimated order, so its name stays out
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), {"ids_crc32": F.crc32("ids")})


def vocabulary() -> str:
    """The rank file of the byte-level vocabulary; ``packing.encoder`` takes the ``.json`` of the same ids as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_chat, op4_quality, op5_html_text, op6_url_filter, op7_pii, op8_quality_rules, op9_lm_score, op10_packing)}

#: DuckDB SQL for the queries that SQL expresses; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": r"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
 w AS (SELECT kind, id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM t),
 p AS (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
 s AS (SELECT DISTINCT kind, id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s FROM p),
 n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
 SELECT d.id AS doc_id, i.id AS item_id, n AS n_item, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n AS containment
 FROM s d JOIN s i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id GROUP BY d.id, i.id, n HAVING CAST(count(*) AS DOUBLE) / n >= 0.8 - 1e-12""",
    "op8_quality_rules": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
 x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
 r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM x) WHERE c > 1),
 d AS (SELECT doc_id, sum(len(list_distinct(w[i:i + 199]))) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 200)) AS i FROM w) GROUP BY doc_id),
 c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals, len(l) AS lines, d.n AS distinct_words FROM l LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words * 3 OR capitals * 2 > word_chars OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words
  OR (lines >= 4 AND 10 * (lines - n_dup_lines) < 5 * lines) OR 10 * distinct_words < n_words) AS kept FROM b""",
}
