"""Queries that search: patterns of rules in texts, similar cases by an index, exact quantiles of crowded classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators import rules, similar
from cutloom.plans.registry import query
from cutloom.tables import table

#: Pairs of words that follow each other in the benchmark's texts, as rules with one pattern each.
PATTERNS_SQL = """
SELECT DISTINCT w[i] || ' ' || w[i + 1] AS pattern FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark))"""


def pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each pair of neighbouring words of the benchmark; every third one by length is for English only."""
    words = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w")).where("size(w) > 1")
    pairs = words.select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("rule_id")).distinct()
    size, none = F.char_length("rule_id"), F.array().cast("array<string>")
    return pairs.select("rule_id", none.alias("tokens"), none.alias("reasons"), F.array("rule_id").alias("patterns"), F.when(size % 3 == 0, "en").alias("context"), F.when(size % 2 == 0, "accept").otherwise("reject").alias("verdict"), (size % 5).alias("priority"), F.lit(None).cast("string").alias("ts"))


@query(f"""
WITH patterns AS ({PATTERNS_SQL}),
hits AS (SELECT doc_id AS case_id, pattern AS rule_id, CASE WHEN length(pattern) % 2 = 0 THEN 'accept' ELSE 'reject' END AS verdict, length(pattern) % 5 AS priority
         FROM documents JOIN patterns ON contains(text, pattern) WHERE pattern <> '' AND (length(pattern) % 3 <> 0 OR lang = 'en'))
SELECT case_id, rule_id, verdict, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, rule_id) AS place FROM hits) WHERE place <= 3""")
def q100_text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best rules whose pattern a document's text holds, in the rule's language."""
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text", F.col("lang").alias("context"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("reason"))
    return rules.matched_rules(cases, pattern_rules(spark, sf_dir), 3).select("case_id", "rule_id", "verdict", "place")


@query("""
WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 50),
s AS (SELECT q.vec_id AS query_id, h.vec_id AS case_id, list_cosine_similarity(q.embedding::DOUBLE[], h.embedding::DOUBLE[]) AS similarity FROM q JOIN embeddings h USING (label) WHERE q.vec_id <> h.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS place FROM s) WHERE place <= 5),
said AS (SELECT *, CASE case_id % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'open' ELSE 'accept' END AS verdict FROM top)
SELECT query_id, count(*) AS n, count(*) FILTER (verdict = 'accept') AS accepts, count(*) FILTER (verdict = 'reject') AS rejects, round(max(similarity), 6) AS best,
       CASE WHEN max(similarity) >= 0.5 THEN 'near_case' ELSE 'same_class' END AS match_reason, string_agg('case ' || case_id, '; ' ORDER BY place) AS notes,
       CASE WHEN count(*) FILTER (verdict = 'reject') > 0 THEN 'review_first' WHEN count(*) FILTER (verdict = 'accept') = count(*) THEN 'review_last' ELSE 'normal' END AS priority
FROM said GROUP BY query_id""")
def q101_case_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the five most similar past cases of its class say for each open case: verdicts, notes, reason and priority of review."""
    cases = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    found = similar.similar(cases.where("id % 100 = 50"), similar.built(cases, "label"), "label", exact=True)
    kind = F.col("id") % 4
    said = cases.select("id", F.when(kind == 0, "reject").when(kind == 1, "open").otherwise("accept").alias("verdict"), F.concat(F.lit("case "), "id").alias("note"))
    memory = similar.remembered(found, said, 0.5)
    return memory.withColumns({"best": F.round("best", 6), "notes": F.array_join("notes", "; ")})
