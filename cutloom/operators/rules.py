"""Retrieval of feedback rules, and routes of feedback and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.patterns import pattern_hits
from cutloom.operators.running import tasks_for


#: Tokens and reasons of rules up to which they are broadcast, so that cases do not travel to the few tasks of their tokens.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def matched_rules(cases: DataFrame, rules: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` best rules of each case: case columns, rule_id, verdict, exact, place.

    ``cases``: case_id, token, reason, context. ``rules``: rule_id, tokens (array), reasons (array), context, verdict, priority, ts.
    A rule needs a hit on its tokens (exact), or, having none, on its reasons; a context it names must be the case's. Exact hits
    come first, then priority, then the newest (those without a time last), then rule_id, as one order. Rules are
    matched by equi-joins on token and reason, so no case meets rules that do not concern it. Where cases have a ``text`` and rules ``patterns`` (array), a pattern
    that the text holds is an exact hit too, and a rule with patterns is not matched by its reasons alone.
    """
    if "patterns" in rules.columns and "text" in cases.columns:
        return matched_by_text(cases, rules, most)
    by_token = rules.withColumn("token", F.explode("tokens")).withColumn("exact", F.lit(True)).drop("tokens", "reasons")
    by_reason = rules.where(F.size(F.coalesce("tokens", F.array().cast("array<string>"))) == 0).withColumn("reason", F.explode("reasons")).withColumn("exact", F.lit(False)).drop("tokens", "reasons")
    strip = lambda df: df.withColumnRenamed("context", "rule_context")
    hits = cases.join(few(strip(by_token)), "token").select(*cases.columns, "rule_id", "rule_context", "verdict", "priority", "ts", "exact")
    hits = hits.union(cases.join(few(strip(by_reason)), "reason").select(*cases.columns, "rule_id", "rule_context", "verdict", "priority", "ts", "exact"))
    hits = hits.where(F.col("rule_context").isNull() | (F.col("rule_context") == F.col("context")))
    # dealt by case before equal hits are dropped: no task holds more than its share, before or after the shuffle
    hits = hits.repartition(tasks_for(hits), "case_id").distinct()
    return best_rules(hits, most).select(*cases.columns, "rule_id", "verdict", "exact", "place")


def best_rules(hits: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of the rules that each case_id was hit by, with ``place``."""
    best = Window.partitionBy("case_id").orderBy(F.desc("exact"), F.desc("priority"), F.desc_nulls_last("ts"), "rule_id")
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def matched_by_text(cases: DataFrame, rules: DataFrame, most: int = 1) -> DataFrame:
    """As ``matched_rules``, for rules with ``patterns`` and cases with ``text``; the texts are read once and do not travel."""
    keys, kept = [c for c in cases.columns if c != "text"], ["rule_id", "verdict", "priority", "ts"]
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    named = rules.withColumnRenamed("context", "rule_context").select(*kept, "rule_context", "tokens", "reasons", "patterns")
    fits = F.col("rule_context").isNull() | (F.col("rule_context") == F.col("context"))
    out = [*keys, *kept, "exact"]

    by_pattern = named.withColumn("pattern", F.explode("patterns")).withColumn("exact", F.lit(True))
    hits = pattern_hits(cases, by_pattern, keys).join(by_pattern, "pattern").where(fits).select(*out)
    by_token = named.withColumn("token", F.explode("tokens")).withColumn("exact", F.lit(True))
    hits = hits.union(cases.select(*keys).join(few(by_token), "token").where(fits).select(*out))
    by_reason = named.where(none("tokens") & none("patterns")).withColumn("reason", F.explode("reasons")).withColumn("exact", F.lit(False))
    hits = hits.union(cases.select(*keys).join(few(by_reason), "reason").where(fits).select(*out))
    hits = hits.repartition(tasks_for(hits), "case_id").distinct()
    return best_rules(hits, most).select(*keys, "rule_id", "verdict", "exact", "place")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; an append-only log read with the latest entry winning."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def event_route(exact: Column, similar: Column, rejected: Column) -> Column:
    """What is known of a new candidate from reviewed history."""
    return F.when(exact & rejected, "rejected_execution_issue").when(exact, "already_reviewed_exact").when(similar, "semantic_reuse_boundary_review").otherwise("new_event")


def feedback_route(tool: Column, document: Column) -> tuple[Column, Column]:
    """(route, confidence) of a note: a tool that applies it, else a document that covers it, else a patch of the session's rules."""
    route = F.when(tool.isNotNull(), "TOOL_APPLY").when(document.isNotNull(), "DOC_REFERENCE").otherwise("SESSION_FEEDBACK_PATCH")
    return route, F.when(tool.isNotNull(), 0.9).when(document.isNotNull(), 0.7).otherwise(0.5)


def representatives(rows: DataFrame, by: list[str], key: str, most: int = 2) -> DataFrame:
    """The ``most`` rows of each class with the smallest key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("place") <= most)
