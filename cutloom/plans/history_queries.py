"""Queries over decisions, history and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import content_hash, exact_avg
from cutloom.operators import lake, media, quantiles, rules, running, similar
from cutloom.plans.registry import query
from cutloom.tables import table

LEVELS = ["lang", "source"]
LABELLED_SQL = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)"
LAKE_SQL = f"""
SELECT (CASE WHEN grouping(lang) = 1 THEN 0 WHEN grouping(source) = 1 THEN 1 ELSE 2 END)::INT AS level, lang, source, count(*) FILTER (quality = 1) AS accept, count(*) FILTER (quality <> 1) AS reject,
       count(*) AS total, round(count(*) FILTER (quality = 1) / count(*), 3) AS accept_rate FROM ({LABELLED_SQL}) GROUP BY ROLLUP (lang, source)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(LAKE_SQL)
def q13_label_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected cases, rolled up over two levels."""
    return lake.label_lake(labelled(spark, sf_dir).withColumn("accepted", F.col("quality") == 1), LEVELS)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS reviewers, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest FROM events GROUP BY event_type")
def q14_by_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of each run, their reviewers and the latest time."""
    grouped = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("reviewers"), F.max("ts").alias("latest"))
    return grouped.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"SELECT source, bool_or(toxic = 1) AS vetoed, bool_and(quality = 1) AS all_good, round(count(*) FILTER (quality = 1) / count(*), 3) AS rate FROM ({LABELLED_SQL}) GROUP BY source")
def q15_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reject vetoes a class, whatever its rate."""
    return labelled(spark, sf_dir).groupBy("source").agg(F.bool_or(F.col("toxic") == 1).alias("vetoed"), F.bool_and(F.col("quality") == 1).alias("all_good"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 3).alias("rate"))


@query("""
WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, h.vec_id AS case_id, list_cosine_similarity(q.embedding::DOUBLE[], h.embedding::DOUBLE[]) AS similarity FROM q JOIN embeddings h USING (label) WHERE q.vec_id <> h.vec_id)
SELECT query_id, case_id, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS place FROM s) WHERE place <= 5""")
def q19_similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar cases of the same class for each query case, by an index and its bounds."""
    history = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    found = similar.similar(history.where("id % 100 = 0"), similar.built(history, "label"), "label", exact=True)
    return found.select("query_id", "case_id", F.round("similarity", 6).alias("similarity"), "place")


@query("SELECT lang, source, doc_id, place FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS place FROM documents) WHERE place <= 2")
def q20_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of each class."""
    return rules.representatives(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id").select("lang", "source", "doc_id", "place")


@query("SELECT lang, round(quantile_cont(n_chars, 0.25), 3) AS p25, round(quantile_cont(n_chars, 0.5), 3) AS median, round(quantile_cont(n_chars, 0.75), 3) AS p75 FROM documents GROUP BY lang")
def q21_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of a measure by class, however large a class is."""
    found = quantiles.exact_quantiles(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return found.select("lang", *(F.round(c, 3).alias(c) for c in ("p25", "median", "p75")))


@query("""
WITH r AS (SELECT conv_id, role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL),
s AS (SELECT *, round(turns / sum(turns) OVER (PARTITION BY conv_id), 4) AS ratio, round(chars / sum(chars) OVER (PARTITION BY conv_id), 4) AS share FROM r)
SELECT conv_id, role, turns, chars, ratio, share, rank() OVER (PARTITION BY conv_id ORDER BY share DESC, role) AS place FROM s""")
def q23_speaker_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each role of a conversation says, against the others."""
    own = Window.partitionBy("conv_id")
    said = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"))
    shared = said.withColumns({"ratio": F.round(F.col("turns") / F.sum("turns").over(own), 4), "share": F.round(F.col("chars") / F.sum("chars").over(own), 4)})
    return shared.withColumn("place", F.rank().over(own.orderBy(F.desc("share"), "role")))


@query("SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, max((props->>'k')::BIGINT) AS most, count(*) FILTER ((props->>'missing') IS NULL) AS without FROM events GROUP BY event_type")
def q24_json_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON inside a string."""
    read = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k BIGINT, missing STRING"))
    return read.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.max("p.k").alias("most"), F.count_if(F.col("p.missing").isNull()).alias("without"))


@query(f"SELECT count(*) FILTER (n_chars > 400 AND quality = 1) AS tp, count(*) FILTER (n_chars > 400 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 400 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 400 AND quality <> 1) AS tn FROM ({LABELLED_SQL})")
def q25_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction against the gold labels."""
    return lake.confusion(labelled(spark, sf_dir), F.col("n_chars") > 400, F.col("quality") == 1)


@query(f"""
WITH t AS ({LABELLED_SQL}), history AS (SELECT lang, count(*) AS total, round(count(*) FILTER (quality = 1) / count(*), 3) AS rate FROM t WHERE source <> 'src0' GROUP BY lang)
SELECT t.doc_id, h.rate, CASE WHEN h.total IS NULL OR h.total < 5 THEN 'HUMAN_REVIEW_REQUIRED' WHEN h.rate >= 0.88 THEN 'MACHINE_CUT_SUGGESTED' WHEN h.rate <= 0.2 THEN 'MACHINE_PRESERVE_SUGGESTED' ELSE 'HUMAN_REVIEW_REQUIRED' END AS suggestion
FROM t LEFT JOIN history h USING (lang) WHERE t.source = 'src0'""")
def q43_leak_safe_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for one run from the history of all others."""
    rows = labelled(spark, sf_dir)
    history = rows.where("source <> 'src0'").groupBy("lang").agg(F.count("*").alias("total"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 3).alias("rate"))
    return rows.where("source = 'src0'").join(history, "lang", "left").select("doc_id", "rate", lake.suggestion(F.col("rate"), F.col("total"), cut=0.88).alias("suggestion"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sha256('{\"l_linenumber\":' || l_linenumber || ',\"l_orderkey\":' || l_orderkey || ',\"l_partkey\":' || l_partkey || ',\"l_returnflag\":\"' || l_returnflag || '\"}') AS digest FROM lineitem")
def q32_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each row's content."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", content_hash("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("digest"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q37_latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log read with the latest entry winning."""
    return rules.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH h AS (SELECT p_brand AS r, p_type AS s, split_part(p_name, ' ', 1) AS t, p_size <= 25 AS a FROM part WHERE p_retailprice < 950),
h3 AS (SELECT r, s, t, round(count(*) FILTER (a) / count(*), 3) AS rate FROM h GROUP BY ALL), h2 AS (SELECT r, s, round(count(*) FILTER (a) / count(*), 3) AS rate FROM h GROUP BY ALL), h1 AS (SELECT r, round(count(*) FILTER (a) / count(*), 3) AS rate FROM h GROUP BY ALL)
SELECT p_partkey, coalesce(h3.rate, h2.rate, h1.rate) AS rate, CASE WHEN h3.rate IS NOT NULL THEN 3 WHEN h2.rate IS NOT NULL THEN 2 WHEN h1.rate IS NOT NULL THEN 1 ELSE 0 END AS rate_level
FROM part p LEFT JOIN h3 ON h3.r = p_brand AND h3.s = p_type AND h3.t = split_part(p_name, ' ', 1) LEFT JOIN h2 ON h2.r = p_brand AND h2.s = p_type LEFT JOIN h1 ON h1.r = p_brand""")
def q38_rate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accept rate of a case's token, else of its subtype, else of its reason."""
    cases = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("reason_key"), F.col("p_type").alias("subtype"), F.split("p_name", " ")[0].alias("filler_token"), "p_size", "p_retailprice")
    history = lake.label_lake(cases.where("p_retailprice < 950").withColumn("accepted", F.col("p_size") <= 25))
    return lake.looked_up_rate(cases, history).select("p_partkey", "rate", "rate_level")


@query("SELECT o_custkey, string_agg(o_orderpriority || '@' || o_orderkey, ' | ' ORDER BY o_orderkey) AS notes FROM orders GROUP BY o_custkey")
def q49_joined_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free-text notes of a key in one line."""
    note = F.concat("o_orderpriority", F.lit("@"), F.col("o_orderkey").cast("string"))
    noted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", note.alias("note")))).alias("all"))
    return noted.select("o_custkey", F.array_join(F.transform("all", lambda x: x["note"]), " | ").alias("notes"))


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_mktsegment, count(*) AS cases, count(n.n) AS covered, count(*) FILTER (n.n IS NULL) AS uncovered, count(*) FILTER (n.n >= 15) AS busy, round(count(n.n) / count(*), 4) AS coverage
FROM customer LEFT JOIN n ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def q48_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of cases by history, by class."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("cases"), F.count("n").alias("covered"), F.count_if(F.col("n").isNull()).alias("uncovered"), F.count_if(F.col("n") >= 15).alias("busy"), F.round(F.count("n") / F.count("*"), 4).alias("coverage"))


@query("""
SELECT 'order' AS family, o_orderkey AS id, o_orderpriority AS kind, NULL AS level, 'human_review_required' AS state FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'event', event_id, event_type, value, 'human_review_required' FROM events WHERE value > 150""")
def q54_candidate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families of candidates with different columns as one."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("order").alias("family"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    events = table(spark, sf_dir, "events").where("value > 150").select(F.lit("event").alias("family"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("level"))
    return orders.unionByName(events, allowMissingColumns=True).withColumn("state", F.lit("human_review_required"))


@query("""
WITH p AS (SELECT o_custkey, avg(o_totalprice) AS liking FROM orders GROUP BY 1)
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(liking, 2) DESC NULLS LAST, c_custkey) AS shown_at FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def q58_preference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preference order of all cases of a nation, sliced by liking; cases without one, which come last, by id. Orders of the same prices
    are liked alike, in whatever order their rows are summed."""
    # SQL rounds the double that is a hundred times as much
    liking = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((-F.round(exact_avg("o_totalprice") * 100) / 100).alias("down"))
    liked = table(spark, sf_dir, "customer").join(liking, "c_custkey", "left").select("c_nationkey", "c_custkey", F.col("down").isNull().alias("without"), "down")
    slices = F.struct("without", F.floor(F.col("down") / 1000), F.when(F.col("without"), F.floor(F.col("c_custkey") / 1000)))
    return running.with_place(liked, ["c_nationkey"], ["without", "down", "c_custkey"], slices).select("c_nationkey", "c_custkey", F.col("place").alias("shown_at"))


@query("SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0")
def q70_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest joined with its approvals."""
    approvals = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(approvals, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority AS value FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")
def q78_unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value is outside its domain."""
    return media.unknown_values(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query("""
SELECT c_nationkey, c_mktsegment, c_custkey, place, "of" FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS "of" FROM customer) WHERE place <= 3""")
def q79_case_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples of each class, and the class's size."""
    found = media.examples(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return found.select("c_nationkey", "c_mktsegment", "c_custkey", "place", "of")
