"""One query for each operator: it applies the operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm import alignment, bpe, chat, extract, fingerprint, lexical, mixing, packing, quality, secrets, sharding, simhash, toxicity
from cutloom.tables import table

#: The text of both rows of conversation -7.
PROBE = r"\### Assistant: </turn> ok"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_blocks(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_report(table(spark, sf_dir, "pages"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_report(table(spark, sf_dir, "documents"), trusted)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(with_probe(table(spark, sf_dir, "conversations")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts look like marks of a template."""
    said = F.lit(PROBE)
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_main_text, op3_order_minhash, op4_token_counts, op5_secret_scan, op6_toxicity, op7_quality_rules, op8_chat_formatting, op9_best_fit_packing, op10_simhash_components, op11_token_alignment, op12_lexical_search, op13_ring_sharding)}
ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.SQL,
    "op12_lexical_search": lexical.SQL,
    "op8_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe_role,
            replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe_text
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || safe_role || '>' || chr(10) || safe_text || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""",
}
