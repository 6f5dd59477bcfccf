"""Queries over a whole project: its candidates, speakers, sentences, review package and delivery report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators import candidates, project, sequence, verification
from cutloom.plans import views
from cutloom.plans.cut_queries import HOUR, MINUTE, PACKED_SQL, PLAN_SQL, packed_spans
from cutloom.plans.file_queries import TIMED_SQL, new_folder, timed_words
from cutloom.plans.registry import query
from cutloom.tables import table

#: Words that answer rather than say something.
ANSWERS = ("the", "la", "de", "of", "der", "el")


@query(f"""
WITH spans AS ({PACKED_SQL}),
fillers AS (SELECT * FROM spans a WHERE kind IN ('click', 'signup') AND NOT (kind = 'click' AND track = 3 AND EXISTS (SELECT 1 FROM spans b WHERE b.track <> a.track AND b.start BETWEEN a.start - 3000 AND a.start + 3000))),
gaps AS (SELECT id, track, "end" AS start, lead(start) OVER (PARTITION BY track ORDER BY start, id) AS "end" FROM spans),
pauses AS (SELECT * FROM gaps g WHERE "end" - start >= 2000 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.track <> g.track AND s.start < g."end" AND g.start < s."end"))
SELECT 'filler' AS kind, id, track, start, "end" FROM fillers UNION ALL SELECT 'pause', id, track, start, "end" FROM pauses""")
def q107_candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers and pauses of all tracks as one table; what only answers another speaker is left out."""
    spans = packed_spans(spark, sf_dir).select("id", F.col("kind").alias("token"), "track", "start", "end")
    roles = spark.createDataFrame([(3, "host"), (0, "guest")], "track long, role string")
    return candidates.fillers_and_pauses(spans, spans.drop("token"), roles, ("click", "signup"), ("click",), "track", 2_000, 3_000, MINUTE)


ANSWERS_SQL = ", ".join(f"'{w}'" for w in ANSWERS)


@query(f"""
WITH w AS (SELECT conv_id, role AS track, word FROM ({views.TURN_WORDS_SQL}) JOIN conversations USING (conv_id, turn)),
t AS (SELECT conv_id, track, count(*) FILTER (word IN ({ANSWERS_SQL})) / count(*) AS ratio, sum(20 * length(word)) AS said FROM w GROUP BY ALL),
s AS (SELECT *, said / nullif(sum(said) OVER (PARTITION BY conv_id), 0) AS fraction FROM t),
r AS (SELECT *, row_number() OVER o AS place, lead(ratio) OVER o AS following FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY ratio DESC, fraction NULLS FIRST, track)),
d AS (SELECT *, bool_or(place = 1 AND ratio > 0 AND ratio >= 1.5 * coalesce(following, 0)) OVER (PARTITION BY conv_id) AS sure FROM r)
SELECT conv_id, track, round(ratio, 6) AS backchannel_ratio, round(fraction, 6) AS speaking_fraction, CASE WHEN NOT sure THEN 'undecided' WHEN place = 1 THEN 'host' ELSE 'guest' END AS role FROM d""")
def q108_hosts_and_guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is the host of each conversation, by how often a role only answers."""
    said = views.turn_words(spark, sf_dir).join(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    timed = said.select("conv_id", F.col("role").alias("track"), F.col("word").alias("token"), F.lit(0).alias("start"), (20 * F.char_length("word")).alias("end"))
    found = project.speaker_roles(timed, ["conv_id"], "track", ANSWERS)
    return found.withColumns({c: F.round(c, 6) for c in ("backchannel_ratio", "speaking_fraction")})


@query(f"""
WITH timed AS ({TIMED_SQL}),
opened AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 600 THEN 1 ELSE 0 END AS opens FROM timed),
counted AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY pos)::BIGINT AS sentence FROM opened),
s AS (SELECT key, sentence, min(pos) AS first_pos, max(pos) AS last_pos, list(word ORDER BY pos) AS words FROM counted GROUP BY key, sentence)
SELECT a.key, a.sentence, a.first_pos, a.last_pos, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS overlap
FROM s a JOIN s b ON a.key = b.key AND a.sentence = b.sentence + 1 WHERE len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) >= 0.2""")
def q109_restarts_after_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, parted by pauses, that say much of the sentence before again."""
    said = sequence.sentences_by_gap(timed_words(spark, sf_dir), ["key"], 600, 1_000)
    return sequence.sentence_restarts(said, ["key"], 0.2).join(said.select("key", "sentence", "first_pos", "last_pos"), ["key", "sentence"])


def finished(spark: SparkSession, sf_dir: str, root: str, reuse: bool = False) -> project.Finished:
    """Clicks and errors as candidates, views as words, quiet sign-ups as silence; of three candidates a judge keeps one, refuses one and has not seen one."""
    spans = packed_spans(spark, sf_dir)
    words = spans.where("kind = 'view'").select("id", "track", "start", "end", (F.col("value") / 100).alias("probability"))
    levels = spans.where("kind = 'signup'").select("track", "start", "end", F.col("value").alias("level"))
    silence = verification.silences(levels, ["track"], HOUR, 60, 10_000)
    judged = F.when(F.col("id") % 3 == 0, "REJECT_KEEP").otherwise("KEEP_CUT")
    verdicts = spans.where("id % 3 <> 2").select("id", judged.alias("judged"))
    make = lambda: spans.where("kind IN ('click', 'error')").drop("value")
    return project.finish(spark, root, make, words, silence, verdicts, ["track"], ("click",), MINUTE, HOUR, reuse, salts=4)


@query(f"""
WITH {PLAN_SQL},
wide AS (SELECT c.id, min(w.start) AS s, max(w."end") AS e FROM cuts c JOIN words w ON w.track = c.track AND w.start <= c.start AND w."end" >= c."end" AND w.start < c."end" AND c.start < w."end" WHERE c.kind = 'click' GROUP BY c.id),
cut AS (SELECT j.*, coalesce(s, start) AS cut_start, coalesce(e, "end") AS cut_end FROM judged j LEFT JOIN wide USING (id)),
edl AS (SELECT id, TRUE AS applied, greatest(0, least(coalesce(crossfade_ms, 0) * 48, (cut_end - cut_start) * 48 - 128))::BIGINT AS crossfade FROM cut WHERE verdict = 'APPROVE' AND id % 3 = 1)
SELECT id, kind, verdict, strategy, start - cut_start AS head_ms, cut_end - "end" AS tail_ms, cut_end - cut_start AS applied_ms, coalesce(applied, FALSE) AS applied, crossfade FROM cut LEFT JOIN edl USING (id)""")
def q110_delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a finished project: every candidate with its verdict, splice and extent, and whether it was cut."""
    return finished(spark, sf_dir, new_folder(spark, "project")).report


@query(f"""
WITH spans AS ({PACKED_SQL}), cuts AS (SELECT * FROM spans WHERE kind IN ('click', 'error')), words AS (SELECT * FROM spans WHERE kind = 'view'),
near AS (SELECT c.id, string_agg('v' || w.id, ' ' ORDER BY w.id) AS heard, count(*) FILTER (w.start >= c.start AND w."end" <= c."end") AS n_taken FROM cuts c JOIN words w ON w.track = c.track AND w.start < c."end" + 1500 AND c.start - 1500 < w."end" GROUP BY c.id),
beside AS (SELECT a.id, count(*) - 1 AS beside FROM cuts a JOIN cuts b ON a.track = b.track AND b.start BETWEEN a.start - 1500 AND a.start + 1500 GROUP BY a.id)
SELECT id, kind, track, start, "end", coalesce(heard, '') AS heard, coalesce(n_taken, 0) AS n_taken, beside, CASE WHEN kind = 'click' THEN 'listen' ELSE 'look' END AS rule FROM cuts LEFT JOIN near USING (id) JOIN beside USING (id)""")
def q111_review_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees of each cut: the words around it, what it takes, and the rule that named it."""
    spans = packed_spans(spark, sf_dir)
    words = spans.where("kind = 'view'").select("track", F.col("id").alias("pos"), F.concat(F.lit("v"), "id").alias("word"), "start", "end")
    cuts = spans.where("kind IN ('click', 'error')").drop("value")
    rule = F.when(F.col("kind") == "click", "listen").otherwise("look")
    return project.review_package(words, cuts, rule, 1_500, MINUTE, ["track"]).withColumn("heard", F.array_join("heard", " "))
