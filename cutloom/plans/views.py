"""How the given tables play the parts of the domain's tables, for queries and their SQL alike.

Documents and conversations are transcripts, whose words single spaces part. Events are timed spans: one starts at ts and lasts
``value`` seconds; its type is its track, its user its speaker. Line items are candidates with measures; orders are episodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.functions.scalars import epoch_ms
from cutloom.operators.sequence import tokens
from cutloom.tables import table

#: Words that are emphasis or pronouns: never cut.
NEVER_CUT = ("the", "la", "de", "der", "el", "que", "of")

WORDS_SQL = "SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
TURN_WORDS_SQL = "SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)"
SPANS_SQL = 'SELECT event_id AS id, event_type AS track, user_id, (epoch_us(ts) // 1000) AS start, (epoch_us(ts) // 1000) + round(value * 1000)::BIGINT AS "end", value FROM events'
RUNS_SQL = f"""
SELECT doc_id, word, min(pos) AS start_pos, count(*) AS n
FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS island FROM ({WORDS_SQL}))
GROUP BY doc_id, word, island HAVING count(*) >= 2"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"), ["doc_id"])


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, track, user_id, start, end, value), times in ms."""
    start = epoch_ms(F.col("ts"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("track"), "user_id", start.alias("start"), (start + F.round(F.col("value") * 1000).cast("bigint")).alias("end"), "value")


def word_list(spark: SparkSession, words: tuple[str, ...] = NEVER_CUT) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")
