"""Queries over gates, routes and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators import gates, params, rules
from cutloom.operators.lake import changed
from cutloom.operators.running import tasks_for
from cutloom.plans.registry import query
from cutloom.tables import table

#: Gates of a line item: (name, Spark condition and SQL condition are the same text).
GATES = (
    ("whitelisted", "l_returnflag IN ('A', 'N')"),
    ("confident", "l_discount >= 0.04"),
    ("not_preserved", "l_linestatus <> 'O' OR l_tax < 0.04"),
    ("short_enough", "l_quantity <= 30"),
    ("unprotected", "l_linenumber BETWEEN 2 AND 6"),
)
#: (rule_id, tokens, reasons, context, verdict, priority, ts)
RULES = (
    (1, ("error",), (), None, "never_cut", 100, "2026-01-01"),
    (2, ("error", "click"), (), "low", "pause_shorter", 20, "2026-03-01"),
    (3, ("click",), (), None, "needs_extension", 20, "2026-02-01"),
    (4, ("click",), (), None, "needs_extension", 20, None),
    (5, (), ("few",), None, "context_accepted", 10, "2026-01-15"),
    (6, (), ("many",), "high", "policy", 10, None),
    (7, ("view",), (), "high", "both_spans_or_none", 30, "2026-01-20"),
)
CASES_SQL = "SELECT event_id AS case_id, event_type AS token, CASE WHEN user_id % 2 = 0 THEN 'few' ELSE 'many' END AS reason, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS context FROM events"


def gated(spark: SparkSession, sf_dir: str, longest: int = 30) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return gates.cascade(rows, [(name, F.expr(test.replace("<= 30", f"<= {longest}"))) for name, test in GATES])


def gates_sql(longest: int = 30) -> str:
    tests = [(name, f"coalesce({test}, FALSE)".replace("<= 30", f"<= {longest}")) for name, test in GATES]
    fails = "CASE " + " ".join(f"WHEN NOT {test} THEN '{name}'" for name, test in tests) + " END"
    return f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{t} AS {n}' for n, t in tests)}, {fails} AS first_fail, {fails} IS NULL AS auto_cut FROM lineitem"


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value / 100 < 0.6 THEN 'REJECT' ELSE 'KEEP' END AS verdict FROM events")
def q01_probability_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improbable candidates of two kinds are rejected."""
    return table(spark, sf_dir, "events").select("event_id", gates.reject_improbable(F.col("event_type"), F.col("value") / 100, ("click", "view")).alias("verdict"))


@query(gates_sql())
def q11_gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates with their evidence, and the first that fails."""
    return gated(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *(n for n, _ in GATES), "first_fail", "auto_cut")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_discount < 0.02 THEN 'REMOVE_FROM_EDL' WHEN l_quantity - 5 < 0 THEN 'REMOVE_FROM_EDL' WHEN l_quantity - 5 < 10 THEN 'NEEDS_HUMAN_REVIEW' WHEN l_returnflag = 'R' THEN 'BUTT_SPLICE'
            WHEN l_linestatus = 'F' THEN 'CROSSFADE_50MS' WHEN l_tax >= 0.04 THEN 'CROSSFADE_100MS_HUMAN_REVIEW' ELSE 'CROSSFADE_50MS' END AS strategy
FROM lineitem""")
def q12_splice_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of seven ordered rules over three checks names the splice."""
    heard, gap = F.when(F.col("l_discount") < 0.02, "REJECT_LOW_PROB_HALLUCINATION"), F.col("l_quantity") - 5
    rhythm = F.when(gap < 0, "RHYTHM_INVALID_NEGATIVE_GAP").when(gap < 10, "RHYTHM_TOO_TIGHT")
    location = F.when(F.col("l_returnflag") == "R", "CUT_IN_SILENCE").when(F.col("l_linestatus") == "F", "CUT_SPANS_BOUNDARY").when(F.col("l_tax") >= 0.04, "CUT_IN_CONTENT_ZONE")
    strategy = gates.splice_strategy(heard, rhythm, location)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", strategy.alias("strategy"))


def regate_sql() -> str:
    return f"""
WITH old AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS case_id, bool_or(auto_cut) AS auto_cut FROM ({gates_sql(30)}) GROUP BY 1),
new AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS case_id, bool_or(auto_cut) AS auto_cut FROM ({gates_sql(35)}) WHERE l_linenumber <> 7 GROUP BY 1)
SELECT case_id, o.auto_cut AS old_value, n.auto_cut AS new_value,
       CASE WHEN o.case_id IS NULL THEN 'added' WHEN n.case_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL OUTER JOIN new n USING (case_id) WHERE o.case_id IS NULL OR n.case_id IS NULL OR o.auto_cut <> n.auto_cut"""


def auto_cuts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(case_id, auto_cut) of a run, and of one with a looser length gate that lacks some cases."""
    case = (F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("case_id")
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    # dealt before they are grouped: most cases are one row, so nothing is gained by grouping where rows lie
    run = lambda df: df.select(case, "auto_cut").repartition(tasks, "case_id").groupBy("case_id").agg(F.bool_or("auto_cut").alias("auto_cut"))
    return run(gated(spark, sf_dir, 30)), run(gated(spark, sf_dir, 35).where("l_linenumber <> 7"))


@query(regate_sql())
def q17_regate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a looser length gate decides differently."""
    return changed(*auto_cuts(spark, sf_dir), "case_id", "auto_cut").where("change <> 'same'")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({gates_sql(35)}) WHERE auto_cut EXCEPT SELECT l_orderkey, l_linenumber, l_partkey FROM ({gates_sql(30)}) WHERE auto_cut")
def q67_newly_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that only the looser gate cuts, as a set difference."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return gated(spark, sf_dir, 35).where("auto_cut").select(*key).subtract(gated(spark, sf_dir, 30).where("auto_cut").select(*key))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({gates_sql(20)}) WHERE auto_cut INTERSECT SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice > 30000")
def q55_both_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that two ways of judging agree on."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return gated(spark, sf_dir, 20).where("auto_cut").select(*key).intersect(table(spark, sf_dir, "lineitem").where("l_extendedprice > 30000").select(*key))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_quantity - 25) > 20 THEN 'hard' WHEN abs(l_quantity - 25) > 10 THEN 'soft' ELSE 'ok' END AS band FROM lineitem")
def q22_level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level differences by band."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", params.band(F.abs(F.col("l_quantity") - 25), 10, 20).alias("band"))


@query("SELECT event_id, CASE WHEN value / 4 - 60 < -50 THEN 'OK' WHEN value / 4 - 60 >= -25 THEN 'BLOCK' ELSE 'HUMAN_REVIEW' END AS risk FROM events")
def q42_artifact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of an audible cut by its level."""
    return table(spark, sf_dir, "events").select("event_id", gates.artifact_risk(F.col("value") / 4 - 60).alias("risk"))


@query("""
SELECT o_orderkey, CASE WHEN abs(o_totalprice - 200000) <= 100000 THEN 'PASS' ELSE 'FAIL' END AS loudness,
       CASE WHEN o_totalprice <= 400000 THEN 'PASS' ELSE 'FAIL' END AS peak, CASE WHEN abs(o_totalprice - 250000) <= 50000 THEN 'PASS' ELSE 'WARN' END AS range_check FROM orders""")
def q34_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures within tolerance of their targets; one of them only warns."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", gates.tolerance(price, 200000, 100000).alias("loudness"), F.when(price <= 400000, "PASS").otherwise("FAIL").alias("peak"), F.when(F.abs(price - 250000) <= 50000, "PASS").otherwise("WARN").alias("range_check"))


@query("""
WITH p(scope, class, value) AS (VALUES ('default', NULL, 50.0), ('class', 'error', 200.0), ('class', 'view', 80.0), ('profile', 'P3', 120.0))
SELECT e.event_id, coalesce(c.value, f.value, 50.0)::DOUBLE AS crossfade_ms FROM events e
LEFT JOIN p c ON c.scope = 'class' AND c.class = e.event_type LEFT JOIN p f ON f.scope = 'profile' AND f.class = 'P' || (e.user_id % 5)""")
def q28_parameter_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter by class, else profile, else default."""
    known = [("default", "crossfade_ms", None, 50.0), ("class", "crossfade_ms", "error", 200.0), ("class", "crossfade_ms", "view", 80.0), ("profile", "crossfade_ms", "P3", 120.0)]
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("class"), F.concat(F.lit("P"), F.col("user_id") % 5).alias("profile"))
    return params.looked_up(rows, spark.createDataFrame(known, "scope string, key string, class string, value double"), "crossfade_ms", "crossfade_ms").select("event_id", "crossfade_ms")


def rules_sql() -> str:
    as_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({i}, {as_list(t)}, {as_list(r)}, {text(c)}, '{v}', {p}, {text(ts)})" for i, t, r, c, v, p, ts in RULES)


@query(f"""
WITH rules(rule_id, tokens, reasons, context, verdict, priority, ts) AS (VALUES {rules_sql()}), cases AS ({CASES_SQL}),
hits AS (
  SELECT c.case_id, r.rule_id, r.verdict, list_contains(r.tokens, c.token) AS exact, r.priority, r.ts FROM cases c JOIN rules r
  ON (list_contains(r.tokens, c.token) OR (len(r.tokens) = 0 AND list_contains(r.reasons, c.reason))) AND (r.context IS NULL OR r.context = c.context))
SELECT case_id, rule_id, verdict, exact, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY exact DESC, priority DESC, ts DESC NULLS LAST, rule_id) AS place FROM hits) WHERE place <= 2""")
def q06_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best feedback rules of each case."""
    kind = "rule_id int, tokens array<string>, reasons array<string>, context string, verdict string, priority int, ts string"
    known = spark.createDataFrame([(i, list(t), list(r), c, v, p, ts) for i, t, r, c, v, p, ts in RULES], kind)
    cases = table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("token"), F.when(F.col("user_id") % 2 == 0, "few").otherwise("many").alias("reason"), F.when(F.col("value") < 50, "low").otherwise("high").alias("context"))
    return rules.matched_rules(cases, known, 2).select("case_id", "rule_id", "verdict", "exact", "place")


@query("""
SELECT c_custkey, CASE WHEN x.exact AND x.bad THEN 'rejected_execution_issue' WHEN x.exact THEN 'already_reviewed_exact' WHEN s.c_nationkey IS NOT NULL THEN 'semantic_reuse_boundary_review' ELSE 'new_event' END AS route
FROM customer c LEFT JOIN (SELECT o_custkey, TRUE AS exact, bool_or(o_orderstatus = 'F') AS bad FROM orders WHERE o_totalprice > 400000 GROUP BY 1) x ON x.o_custkey = c.c_custkey
LEFT JOIN (SELECT DISTINCT s_nationkey AS c_nationkey FROM supplier WHERE s_acctbal > 9000) s ON s.c_nationkey = c.c_nationkey""")
def q18_event_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against reviewed history: by exact key, else by class, else new."""
    exact = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("exact"), F.bool_or(F.col("o_orderstatus") == "F").alias("bad"))
    similar = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("similar")).distinct()
    joined = table(spark, sf_dir, "customer").join(exact, "c_custkey", "left").join(similar, "c_nationkey", "left")
    return joined.select("c_custkey", rules.event_route(F.col("exact"), F.col("similar"), F.col("bad")).alias("route"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'source_track_gate' ELSE 'render_sync_cut' END AS scope, CASE WHEN value / 100 < 0.85 THEN 'both_spans' ELSE 'first_span' END AS spans FROM events")
def q68_cut_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cut mutes one track or all, and one span or both."""
    return table(spark, sf_dir, "events").select("event_id", gates.cut_scope(F.col("event_type"), ("error", "signup")).alias("scope"), gates.paraphrase_scope(F.col("value") / 100).alias("spans"))


@query("""
SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS content, bool_or(o_orderpriority = '2-HIGH') AS packaging,
       CASE WHEN bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '2-HIGH') THEN 'release' ELSE 'draft' END AS state FROM orders GROUP BY o_custkey""")
def q50_two_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release needs both approvals."""
    signed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("content"), F.bool_or(F.col("o_orderpriority") == "2-HIGH").alias("packaging"))
    return signed.withColumn("state", F.when(F.col("content") & F.col("packaging"), "release").otherwise("draft"))


@query("""
SELECT o_custkey, count(*) AS notes, bool_or(o_orderstatus = 'P' AND o_totalprice > 480000) AS gold,
       CASE WHEN bool_or(o_orderstatus = 'P' AND o_totalprice > 480000) THEN 'gold_edl' WHEN count(*) >= 5 THEN 'batch' WHEN count(*) = 1 THEN 'single_note' ELSE 'small_batch' END AS stream FROM orders GROUP BY o_custkey""")
def q51_learning_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reviewer's notes go, by their number and kind."""
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("notes"), F.bool_or((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 480000)).alias("gold"))
    return counted.withColumn("stream", gates.learning_stream(F.col("notes"), F.col("gold")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s.s_suppkey IS NOT NULL THEN 'TOOL_APPLY' WHEN p.p_partkey IS NOT NULL THEN 'DOC_REFERENCE' ELSE 'SESSION_FEEDBACK_PATCH' END AS route,
       CASE WHEN s.s_suppkey IS NOT NULL THEN 0.9 WHEN p.p_partkey IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000) s ON s.s_suppkey = l_suppkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 40) p ON p.p_partkey = l_partkey""")
def q52_feedback_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's route: a tool, else a document, else a patch."""
    tools = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("tool"))
    documents = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("document"))
    route, confidence = rules.feedback_route(F.col("tool"), F.col("document"))
    return table(spark, sf_dir, "lineitem").join(tools, "l_suppkey", "left").join(documents, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", route.alias("route"), confidence.alias("confidence"))


@query("SELECT c.case_id, CASE WHEN v.verdict IN ('KEEP_CUT', 'REJECT_KEEP') THEN v.verdict ELSE 'NEEDS_REVIEW' END AS verdict FROM (SELECT event_id AS case_id FROM events) c LEFT JOIN (SELECT event_id AS case_id, CASE WHEN value < 20 THEN 'KEEP_CUT' WHEN value < 60 THEN 'REJECT_KEEP' ELSE 'odd' END AS verdict FROM events WHERE event_type <> 'error') v USING (case_id)")
def q69_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdicts joined to their cases; missing and unknown ones go to a person."""
    events = table(spark, sf_dir, "events")
    said: Column = F.when(F.col("value") < 20, "KEEP_CUT").when(F.col("value") < 60, "REJECT_KEEP").otherwise("odd")
    verdicts = events.where("event_type <> 'error'").select(F.col("event_id").alias("case_id"), said.alias("verdict"))
    return events.select(F.col("event_id").alias("case_id")).join(verdicts, "case_id", "left").select("case_id", gates.verdict_or_review(F.col("verdict")).alias("verdict"))
