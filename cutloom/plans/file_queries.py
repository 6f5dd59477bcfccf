"""Queries whose rows go through files and back: logs, decisions, versions, digest trees, and table functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.functions import table_functions
from cutloom.operators import digests
from cutloom.plans import views
from cutloom.plans.decision_queries import auto_cuts, regate_sql
from cutloom.plans.registry import query
from cutloom.sources import logs, wav
from cutloom.streaming import refresh
from cutloom.tables import shared_dir, table


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in shared storage that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, pos, word, start, end) of the turns: a word every 300 ms, and a pause before every seventh."""
    start = (F.col("pos") - 1) * 300 + F.floor(F.col("pos") / 7) * 600
    return views.turn_words(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("pos").cast("bigint").alias("pos"), "word", start.alias("start"), (start + 20 * F.char_length("word")).alias("end"))


TIMED_SQL = f"""
SELECT conv_id || '-' || turn AS key, pos, word, (pos - 1) * 300 + (pos // 7) * 600 AS start, (pos - 1) * 300 + (pos // 7) * 600 + 20 * length(word) AS "end" FROM ({views.TURN_WORDS_SQL})"""


@query(f"""
WITH timed AS ({TIMED_SQL}),
opened AS (SELECT *, CASE WHEN right(lag(word) OVER w, 1) IN ('.', '?', '!') OR start - lag("end") OVER w >= 600 THEN 1 ELSE 0 END AS opens FROM timed WINDOW w AS (PARTITION BY key ORDER BY pos)),
counted AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY pos)::INT AS clause FROM opened)
SELECT key, clause, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", string_agg(word, ' ' ORDER BY pos) AS text FROM counted GROUP BY key, clause""")
def q102_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn as clauses, by a table function over ordered partitions."""
    table_functions.register(spark)
    return spark.sql("SELECT key, clause, first_pos, last_pos, start, end, array_join(words, ' ') AS text FROM clauses(TABLE({timed}) PARTITION BY key ORDER BY pos)", timed=timed_words(spark, sf_dir))


@query(regate_sql())
def q103_digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a looser gate decides differently, from two stored runs of which only the ranges with unequal digests are read."""
    paths = []
    for run in auto_cuts(spark, sf_dir):
        paths.append(new_folder(spark, "run"))
        digests.store_run(run, paths[-1], "case_id", bits=5)
    return digests.compared(spark, *paths, "case_id", "auto_cut")


@query("""
SELECT o_orderkey::VARCHAR AS episode, strftime(o_orderdate, '%Y-%m-%d') AS day, [o_orderpriority, o_orderstatus] AS tokens, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE [o_orderstatus] END AS reasons, CASE WHEN o_totalprice > 200000 THEN 'never_cut' ELSE 'policy' END AS verdict
FROM orders""")
def q104_feedback_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a feedback log, written and read again: lists and single names, dates as times."""
    orders, path = table(spark, sf_dir, "orders"), new_folder(spark, "feedback")
    both = F.to_json(F.array("o_orderpriority", "o_orderstatus"))
    pattern = F.struct(both.alias("filler_token"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("reason_key"))
    lines = orders.select(F.col("o_orderkey").cast("string").alias("episode_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), pattern.alias("candidate_pattern"), F.when(F.col("o_totalprice") > 200_000, "never_cut").otherwise("policy").alias("verdict"))
    logs.append_log(lines, path)
    return logs.feedback(spark, path).select(F.col("episode_id").alias("episode"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "tokens", "reasons", "verdict")


@query("SELECT event_type AS run_id, 'R' || user_id % 3 AS reviewer, event_id::VARCHAR AS clip_id, CASE WHEN value < 50 THEN 'accept' ELSE 'reject' END AS verdict, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS decided_at FROM events")
def q105_decisions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decision documents, one for a run, reviewer and hour, written below a folder and read again."""
    path = new_folder(spark, "decisions")
    decided = F.struct(F.col("event_id").cast("string").alias("clip_id"), F.when(F.col("value") < 50, "accept").otherwise("reject").alias("verdict"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("decided_at"))
    by = ["event_type", (F.col("user_id") % 3).alias("r"), F.date_trunc("hour", "ts").alias("hour")]
    documents = table(spark, sf_dir, "events").groupBy(*by).agg(F.collect_list(decided).alias("decisions"))
    logs.append_log(documents.select(F.col("event_type").alias("run_id"), F.concat(F.lit("R"), "r").alias("reviewer"), "decisions"), path)
    read = logs.decisions(spark, path, "*.json", lines=True)
    return read.select("run_id", "reviewer", "clip_id", "verdict", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"))


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY lang")
def q106_frozen_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that holds the first version of a table still reads it after a second one came."""
    documents, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), new_folder(spark, "versions")
    logs.write_version(documents.where("doc_id % 2 = 0"), path, 0)
    held, first = logs.frozen(spark, path)
    logs.write_version(documents, path, held + 1)
    return first.groupBy("lang").agg(F.count("*").alias("n"))


@query("""
WITH arrived AS (
  SELECT user_id AS case_id, event_type AS reason_key, CASE WHEN value < 40 THEN TRUE WHEN value < 120 THEN FALSE END AS accepted, ts AS decided_at FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY decided_at DESC NULLS LAST, accepted DESC NULLS LAST, reason_key DESC) AS n FROM arrived) WHERE n = 1 AND accepted IS NOT NULL)
SELECT (CASE WHEN grouping(reason_key) = 1 THEN 0 ELSE 1 END)::INT AS level, reason_key, count(*) FILTER (accepted) AS accept, count(*) FILTER (NOT accepted) AS reject, count(*) AS total, round(count(*) FILTER (accepted) / count(*), 3) AS accept_rate
FROM latest GROUP BY ROLLUP (reason_key)""")
def q114_streamed_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label lake after two batches of decisions of which many change earlier ones, kept up by a stream and read as published."""
    place = new_folder(spark, "stream")
    accepted = F.when(F.col("value") < 40, True).when(F.col("value") < 120, False)
    arrived = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("reason_key"), accepted.alias("accepted"), F.col("ts").cast("timestamp").alias("decided_at"))
    kind, levels = "case_id long, reason_key string, accepted boolean, decided_at timestamp", ["reason_key"]
    for half in (0, 1):
        arrived.where(F.pmod(F.xxhash64("decided_at"), F.lit(2)) == half).write.mode("append").parquet(f"{place}/in")
        refresh.refresh_on_decisions(refresh.as_stream(spark, f"{place}/in", kind), f"{place}/lake", f"{place}/check", ["case_id"], levels).awaitTermination()
    return refresh.rolled_up(refresh.published(spark, f"{place}/lake"), levels)


@query("""
WITH f AS (SELECT event_type || '-' || user_id % 7 || '.wav' AS name, CASE event_type WHEN 'view' THEN 2 ELSE 1 END AS channels, CASE WHEN user_id % 7 < 3 THEN 48000 ELSE 8000 END AS sample_rate, count(*) AS frames FROM events GROUP BY ALL)
SELECT name, 44 + frames * channels * 2 AS bytes, 1 AS codec, channels, sample_rate, 16 AS bits, round(frames / sample_rate, 9) AS duration_s FROM f""")
def q117_wav_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent files, as long as there are events of a kind, written and their headers read by the data source."""
    path = new_folder(spark, "recordings")
    name = F.concat("event_type", F.lit("-"), F.col("user_id") % 7, F.lit(".wav")).alias("name")
    channels, rate = F.when(F.col("event_type") == "view", 2).otherwise(1), F.when(F.col("user_id") % 7 < 3, 48_000).otherwise(8_000)
    wav.write_silence(table(spark, sf_dir, "events").groupBy(name, channels.alias("channels"), rate.alias("sample_rate"), F.lit(16).alias("bits")).agg(F.count("*").alias("frames")), path)
    spark.dataSource.register(wav.WavSource)
    read = spark.read.format("wav_facts").option("path", path).option("suffix", ".wav").load()
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "codec", "channels", "sample_rate", "bits", F.round("duration_s", 9).alias("duration_s"))
