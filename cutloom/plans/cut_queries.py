"""Queries over whole cut plans: their checks, edges, guards, lists and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.functions.scalars import content_hash, epoch_ms, to_samples
from cutloom.operators import candidates, gates, intervals, lake, params, registry_checks, sequence, verification
from cutloom.plans import views
from cutloom.plans.registry import query
from cutloom.sources import logs
from cutloom.tables import table, written

MINUTE, HOUR, DAY = 60_000, 3_600_000, 24 * 3_600_000
#: Edges by class of a cut, in ms: fixed values.
EDGES = (("default", None, 100.0), ("class", "click", 180.0), ("class", "purchase", 40.0))

#: Times are packed by this factor, so that tracks are as dense as speech; a track is a fourth of the users.
PACKED, TRACKS = 20, 4
PACKED_SQL = f'SELECT id, track AS kind, user_id % {TRACKS} AS track, start // {PACKED} AS start, start // {PACKED} + ("end" - start) AS "end", value FROM ({views.SPANS_SQL})'
PLAN_SQL = f"""
spans AS ({PACKED_SQL}), cuts AS (SELECT * FROM spans WHERE kind IN ('click', 'error')),
words AS (SELECT track, start, "end", (start + "end") // 2 AS middle, value / 100 AS probability FROM spans WHERE kind = 'view'),
evidence AS (
  SELECT c.id, count(*) FILTER (w.start < c."end" AND c.start < w."end") AS n_words, min(w.probability) FILTER (w.start < c."end" AND c.start < w."end") AS min_probability,
         c.start - max(w."end") FILTER (middle < c.start) AS gap_before, min(w.start) FILTER (middle >= c."end") - c."end" AS gap_after
  FROM cuts c LEFT JOIN words w ON w.track = c.track GROUP BY c.id, c.start, c."end"),
frames AS (SELECT track, start, "end", row_number() OVER () AS rid FROM spans WHERE kind = 'signup' AND value < 60 AND start < "end"),
marked AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY track ORDER BY start, "end", rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM frames),
islands AS (SELECT track, start, "end", sum(opens) OVER (PARTITION BY track ORDER BY start, "end", rid) AS island FROM marked),
silences AS (SELECT track, min(start) AS start, max("end") AS "end" FROM islands GROUP BY track, island HAVING max("end") - min(start) >= 10000),
held AS (SELECT c.id, bool_or(s.start <= c.start AND s."end" >= c."end") AS held FROM cuts c JOIN silences s ON s.track = c.track AND s.start < c."end" AND c.start < s."end" GROUP BY c.id),
facts AS (
  SELECT c.id, c.kind, c.track, c.start, c."end", n_words, min_probability, gap_before, gap_after,
    CASE WHEN kind = 'click' AND min_probability < 0.6 THEN 'REJECT_LOW_PROB_HALLUCINATION' WHEN n_words = 0 THEN 'NO_WORD' ELSE 'KEEP' END AS heard,
    CASE WHEN held THEN 'CUT_IN_SILENCE' WHEN NOT held THEN 'CUT_SPANS_BOUNDARY' WHEN c.track IN (SELECT track FROM silences) THEN 'CUT_IN_CONTENT_ZONE' END AS location
  FROM cuts c JOIN evidence USING (id) LEFT JOIN held USING (id)),
paced AS (
  SELECT *, CASE WHEN least(gap_before, gap_after) < 0 THEN 'RHYTHM_INVALID_NEGATIVE_GAP' WHEN gap_before < 50 AND coalesce(location, '') <> 'CUT_IN_SILENCE' THEN 'RHYTHM_REJECT'
    WHEN gap_before < 120 OR gap_after < 120 THEN 'RHYTHM_TOO_TIGHT' WHEN gap_before > 300 OR gap_after > 450 THEN 'RHYTHM_DRAGGING' ELSE 'RHYTHM_OK' END AS rhythm FROM facts),
routed AS (
  SELECT *, CASE WHEN heard = 'REJECT_LOW_PROB_HALLUCINATION' OR rhythm = 'RHYTHM_INVALID_NEGATIVE_GAP' THEN 'REMOVE_FROM_EDL' WHEN rhythm = 'RHYTHM_TOO_TIGHT' THEN 'NEEDS_HUMAN_REVIEW'
    WHEN location = 'CUT_IN_SILENCE' THEN 'BUTT_SPLICE' WHEN location = 'CUT_SPANS_BOUNDARY' THEN 'CROSSFADE_50MS' WHEN location = 'CUT_IN_CONTENT_ZONE' THEN 'CROSSFADE_100MS_HUMAN_REVIEW' ELSE 'CROSSFADE_50MS' END AS strategy FROM paced),
judged AS (
  SELECT *, CASE WHEN strategy = 'REMOVE_FROM_EDL' OR rhythm = 'RHYTHM_REJECT' THEN 'REJECT' WHEN contains(strategy, 'HUMAN_REVIEW') THEN 'HUMAN_REVIEW' ELSE 'APPROVE' END AS verdict,
    CASE strategy WHEN 'BUTT_SPLICE' THEN 0 WHEN 'CROSSFADE_50MS' THEN 50 WHEN 'CROSSFADE_100MS_HUMAN_REVIEW' THEN 100 END AS crossfade_ms, CASE WHEN strategy = 'BUTT_SPLICE' THEN 10 WHEN strategy LIKE 'CROSSFADE%' THEN 0 END AS room_tone_ms
  FROM routed)"""


def packed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, track, start, end, value): the events as a few tracks of dense spans."""
    start = F.floor(F.col("start") / PACKED)
    return views.spans(spark, sf_dir).select("id", F.col("track").alias("kind"), (F.col("user_id") % TRACKS).alias("track"), start.alias("start"), (start + F.col("end") - F.col("start")).alias("end"), "value")


def verified_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors as cuts, views as words, quiet sign-ups as silence, each of its own track."""
    spans = packed_spans(spark, sf_dir)
    cuts = spans.where("kind IN ('click', 'error')").drop("value")
    words = spans.where("kind = 'view'").select("track", "start", "end", (F.col("value") / 100).alias("probability"))
    levels = spans.where("kind = 'signup'").select("track", "start", "end", F.col("value").alias("level"))
    silence = verification.silences(levels, ["track"], HOUR, 60, 10_000)
    return verification.verified(cuts, words, silence, ["track"], ("click",), MINUTE, HOUR, salts=4)


@query(f"WITH {PLAN_SQL} SELECT id, n_words, min_probability, location, gap_before, gap_after, heard, rhythm, strategy, crossfade_ms, room_tone_ms, verdict FROM judged")
def q81_verified_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors as cuts: all four checks against their own track, the splice with its parameters, and the verdict."""
    return verified_cuts(spark, sf_dir).select("id", "n_words", "min_probability", "location", "gap_before", "gap_after", "heard", "rhythm", "strategy", "params.crossfade_ms", "params.room_tone_ms", "verdict")


EDGES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {'NULL' if c is None else repr(c)}, {v})" for s, c, v in EDGES) + ") p(scope, class, value)"


@query(f"""
WITH p AS ({EDGES_SQL}), spans AS ({views.SPANS_SQL}), edged AS (
  SELECT s.*, coalesce(c.value, (SELECT value FROM p WHERE scope = 'default'))::BIGINT AS edge FROM spans s LEFT JOIN p c ON c.scope = 'class' AND c.class = s.track)
SELECT id, edge, greatest(start - edge, coalesce(lag("end") OVER w + 20, start - edge)) AS cut_start, least("end" + edge, coalesce(lead(start) OVER w - 30, "end" + edge)) AS cut_end
FROM edged WINDOW w AS (PARTITION BY user_id ORDER BY start, id)""")
def q82_class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts widened by the edge of their class, up to the word before and short of the onset of the next, which stays."""
    known = spark.createDataFrame([(s, "edge_ms", c, v) for s, c, v in EDGES], "scope string, key string, class string, value double")
    spans = views.spans(spark, sf_dir).withColumns({"class": F.col("track"), "profile": F.lit(None).cast("string")})
    edged = params.looked_up(spans, known, "edge_ms", "edge").withColumn("edge", F.col("edge").cast("bigint"))
    return candidates.widened(edged, ["user_id"], F.col("edge"), DAY, pad=20, onset=30).select("id", "edge", "cut_start", "cut_end")


@query(f"""
WITH words AS ({views.TURN_WORDS_SQL}), near AS (
  SELECT *, coalesce(max(CASE WHEN regexp_matches(word, '^[A-Za-z]{{2,}}') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1
         OR coalesce(max(CASE WHEN regexp_matches(word, '^[A-Za-z]{{2,}}') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1 AS foreign_near FROM words)
SELECT conv_id, turn, pos, word FROM near WHERE length(word) = 1 AND (foreign_near OR (pos * 37 % 100) / 100.0 < 0.6)""")
def q83_never_cut_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single characters that are never cut: a word of letters is near, or the recogniser was not sure of them."""
    words = views.turn_words(spark, sf_dir).withColumn("probability", F.pmod(F.col("pos") * 37, F.lit(100)) / 100)
    near = sequence.with_near_any(words, ["conv_id", "turn"], "foreign", F.col("word").rlike("^[A-Za-z]{2,}"))
    return near.where(gates.single_character_guard(F.col("word"), F.col("foreign"), F.col("probability"))).select("conv_id", "turn", "pos", "word")


@query(f"""
WITH spans AS ({views.SPANS_SQL}), refined AS (SELECT id, start + 7 AS s, CASE WHEN value > 40 THEN "end" - 5 END AS e FROM spans WHERE track = 'view')
SELECT id, coalesce(s, start) AS cut_start, coalesce(e, "end") AS cut_end, CASE WHEN s IS NULL AND e IS NULL THEN 'asr' WHEN s IS NULL OR e IS NULL THEN 'mixed' ELSE 'refined' END AS origin
FROM spans LEFT JOIN refined USING (id)""")
def q84_refined_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of an aligner where it gave them, else the recogniser's."""
    spans = views.spans(spark, sf_dir)
    refined = spans.where("track = 'view'").select("id", (F.col("start") + 7).alias("refined_start"), F.when(F.col("value") > 40, F.col("end") - 5).alias("refined_end"))
    return candidates.refined(spans, refined).select("id", "cut_start", "cut_end", "origin")


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity <= 30), b AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity <= 25 OR l_discount > 0.08)
SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def q85_bag_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one of two runs has more often than the other, both ways and as often as that."""
    rows = table(spark, sf_dir, "lineitem")
    return lake.bag_difference(rows.where("l_quantity <= 30").select("l_suppkey", "l_returnflag"), rows.where("l_quantity <= 25 OR l_discount > 0.08").select("l_suppkey", "l_returnflag"))


@query("""
WITH t AS (SELECT d.doc_id, d.lang AS reason_key, d.source AS subtype, CASE WHEN n_chars > 400 THEN 'long' ELSE 'short' END AS filler_token, quality = 1 AS ok FROM labels JOIN documents d USING (doc_id))
SELECT reason_key, subtype, filler_token, doc_id AS case_id, count(*) FILTER (ok) OVER leaf AS accept, count(*) OVER leaf AS total, round(count(*) FILTER (ok) OVER leaf / count(*) OVER leaf, 3) AS accept_rate
FROM t WINDOW leaf AS (PARTITION BY reason_key, subtype, filler_token)""")
def q86_leaf_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of each leaf of a lake of three levels, with the leaf's counts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("reason_key"), F.col("source").alias("subtype"), F.when(F.col("n_chars") > 400, "long").otherwise("short").alias("filler_token"))
    decisions = table(spark, sf_dir, "labels").join(documents, "doc_id").withColumn("accepted", F.col("quality") == 1)
    return lake.leaf_cases(decisions, "doc_id").select("reason_key", "subtype", "filler_token", F.col("doc_id").alias("case_id"), "accept", "total", "accept_rate")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, round((epoch_us(l_shipdate) // 1000) * 48000 / 1000.0)::BIGINT AS start_sample, (l_quantity::BIGINT * 4800) AS length FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'R')
SELECT l_orderkey, l_linenumber, l_partkey, start_sample, start_sample + length AS end_sample, greatest(0, least(2400, length - 128)) AS crossfade,
       sha256('{"crossfade":' || greatest(0, least(2400, length - 128)) || ',"end_sample":' || (start_sample + length) || ',"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"start_sample":' || start_sample || '}') AS digest FROM c""")
def q87_approved_edl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved cuts as an edit list in samples, with cross-fades and a digest of each entry."""
    approved = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    cuts = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").join(approved, "l_orderkey", "left_semi")
    length = F.col("l_quantity").cast("bigint") * 4800
    entries = cuts.select("l_orderkey", "l_linenumber", "l_partkey", to_samples(epoch_ms(F.col("l_shipdate"))).alias("start_sample"), length.alias("length"))
    entries = entries.withColumns({"end_sample": F.col("start_sample") + F.col("length"), "crossfade": params.crossfade_samples(F.lit(50), F.col("length"))}).drop("length")
    return entries.withColumn("digest", content_hash("l_orderkey", "l_linenumber", "start_sample", "end_sample", "crossfade"))


@query("""
SELECT epoch_us(ts) // 60000000 AS frame, sum(round(value * 100)::BIGINT * CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 100 ELSE 50 END)::BIGINT AS level FROM events GROUP BY 1""")
def q88_mixed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks mixed to one: the sum of gain times level in each frame."""
    gain = F.when(F.col("event_type") == "view", 80).when(F.col("event_type") == "click", 100).otherwise(50)
    frame = F.floor(epoch_ms(F.col("ts")) / MINUTE).alias("frame")
    return table(spark, sf_dir, "events").groupBy(frame).agg(F.sum(F.round(F.col("value") * 100).cast("bigint") * gain).alias("level"))


@query("""
WITH tools AS (SELECT CASE WHEN page_id % 3 > 0 THEN '/opt/x/scripts/' || (page_id % 40) || '.py' END AS full_path, CASE WHEN page_id % 2 = 0 THEN 'scripts/' || (page_id % 30) || '.sh' END AS script FROM pages),
listed AS (SELECT regexp_replace(p, '^/opt/x/', '') AS path FROM (SELECT full_path AS p FROM tools UNION ALL SELECT script FROM tools) WHERE p IS NOT NULL),
allowed AS (SELECT DISTINCT 'scripts/' || (page_id % 50) || '.py' AS path FROM pages WHERE page_id % 50 > 45),
files AS (SELECT DISTINCT 'scripts/' || CASE WHEN page_id % 5 = 0 THEN '_' ELSE '' END || (page_id % 50) || CASE WHEN page_id % 7 < 4 THEN '.py' ELSE '.sh' END AS path FROM pages)
SELECT path FROM files WHERE NOT starts_with(split_part(path, '/', -1), '_') AND path NOT IN (SELECT path FROM listed) AND split_part(path, '/', -1) NOT IN (SELECT split_part(path, '/', -1) FROM listed) AND path NOT IN (SELECT path FROM allowed)""")
def q89_unregistered_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that no tool names by full path or script, less those of an allowlist of buckets; names with a leading '_' are no scripts."""
    pages = table(spark, sf_dir, "pages")
    n = lambda k: (F.col("page_id") % k).cast("string")
    tools = pages.select(F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("/opt/x/scripts/"), n(40), F.lit(".py"))).alias("full_path"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("scripts/"), n(30), F.lit(".sh"))).alias("script"))
    bucket = F.create_map(F.lit("kept"), F.struct(F.array(F.concat(F.lit("scripts/"), n(50), F.lit(".py"))).alias("files")))
    allowlist = pages.where("page_id % 50 > 45").select(bucket.alias("buckets"))
    ending = F.when(F.col("page_id") % 7 < 4, ".py").otherwise(".sh")
    files = pages.select(F.concat(F.lit("scripts/"), F.when(F.col("page_id") % 5 == 0, "_").otherwise(""), n(50), ending).alias("path")).distinct()
    listed = registry_checks.registered_paths(tools, ["full_path", "script"], "/opt/x/")
    return registry_checks.unregistered(registry_checks.without_prefix(files, "_"), listed, registry_checks.allowed_paths(allowlist))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' AND value >= 60 THEN 'drop' WHEN event_type IN ('click', 'purchase') AND value >= 20 THEN 'keep' ELSE 'human_review' END AS triage,
       CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'not_listed' WHEN event_type = 'view' AND value > 120 THEN 'forbidden' WHEN epoch_us(ts) // 1000 < 1704067200000 + 21600000 OR epoch_us(ts) // 1000 + round(value * 1000)::BIGINT > 1706572800000 THEN 'edge' ELSE 'open' END AS guard
FROM events""")
def q90_triage_and_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference model's triage of cases, and the guards of lists and edges that stand before it."""
    start = epoch_ms(F.col("ts"))
    length = F.round(F.col("value") * 1000).cast("bigint")
    triage = gates.preference_triage((F.col("event_type") == "error") & (F.col("value") >= 60), F.col("event_type").isin("click", "purchase") & (F.col("value") >= 20))
    begin = 1704067200000
    at_edge = ~gates.inside_edges(start - begin, start - begin + length, F.lit(1706572800000 + 21_600_000 - begin), 21_600_000)
    guard = gates.list_guard(F.col("event_type"), ("click", "view", "purchase"), (F.col("event_type") == "view") & (F.col("value") > 120), at_edge)
    return table(spark, sf_dir, "events").select("event_id", triage.alias("triage"), guard.alias("guard"))


SENTENCES_SQL = f"""
SELECT conv_id, turn, before::BIGINT AS sentence, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos, list(word ORDER BY pos) AS words, string_agg(word, ' ' ORDER BY pos) AS text
FROM (SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('.', '?', '!') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({views.TURN_WORDS_SQL}))
GROUP BY conv_id, turn, before"""


@query(f"SELECT conv_id, turn, sentence, first_pos, last_pos, text FROM ({SENTENCES_SQL})")
def q92_gathered_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each turn as text, with the positions of their words."""
    return sequence.gathered_sentences(views.turn_words(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "sentence", "first_pos", "last_pos", "text")


@query(f"""
WITH s AS ({SENTENCES_SQL}), pairs AS (SELECT a.conv_id, a.turn, a.sentence, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS overlap FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.sentence = b.sentence + 1)
SELECT conv_id, turn, sentence, overlap FROM pairs WHERE overlap >= 0.3""")
def q93_sentence_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that say much of the sentence before again."""
    said = sequence.gathered_sentences(views.turn_words(spark, sf_dir), ["conv_id", "turn"])
    return sequence.sentence_restarts(said, ["conv_id", "turn"], 0.3)


@query(f"""
SELECT conv_id, turn, role AS track, pos::INT AS pos, word, (pos - 1) * 300 AS start, CASE WHEN pos % 41 = 0 THEN (pos - 1) * 300 - 10 ELSE (pos - 1) * 300 + 20 * length(word) END AS "end", (pos * 37 % 103) / 100.0::DOUBLE AS probability,
       CASE WHEN word = '' THEN 'no_word' WHEN pos % 41 = 0 THEN 'order' WHEN pos * 37 % 103 > 100 THEN 'probability' END AS fault
FROM ({views.TURN_WORDS_SQL}) JOIN conversations USING (conv_id, turn)""")
def q94_word_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as JSON, made of the turns, read as timed words and checked."""

    def timed(word, i):  # noqa: ANN001, ANN202
        start = i * 300
        end = F.when((i + 1) % 41 == 0, start - 10).otherwise(start + 20 * F.char_length(word))
        return F.struct(word.alias("word"), (start / 1000).alias("start"), (end / 1000).alias("end"), (F.pmod((i + 1) * 37, F.lit(103)) / 100).alias("probability"))

    document = F.to_json(F.struct(F.col("role").alias("track"), F.transform(F.split("text", " "), timed).alias("words")))
    return logs.word_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", document.alias("text")))


@query("""
WITH c AS (
  SELECT 1 AS place, 'orphans' AS layer, count(*) AS n_bad, 'FAIL' AS level FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 2, 'long_spans', count(*), 'WARN' FROM events WHERE value > 100
  UNION ALL SELECT 3, 'negative_values', count(*), 'FAIL' FROM events WHERE value < 0
  UNION ALL SELECT 4, 'unlabelled', count(*), 'FAIL' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 5, 'short_turns', count(*), 'WARN' FROM conversations WHERE length(text) < 20)
SELECT place, layer, n_bad, CASE WHEN n_bad > 0 THEN level ELSE 'PASS' END AS verdict FROM c WHERE place <= coalesce((SELECT min(place) FROM c WHERE n_bad > 0 AND level = 'FAIL'), 5)""")
def q95_ordered_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the tables in order, up to the first that fails."""
    of = lambda name: table(spark, sf_dir, name)
    events = of("events")
    return registry_checks.in_order({
        "orphans": (of("orders").join(of("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "FAIL"),
        "long_spans": (events.where("value > 100"), "WARN"),
        "negative_values": (events.where("value < 0"), "FAIL"),
        "unlabelled": (of("documents").join(of("labels"), "doc_id", "left_anti"), "FAIL"),
        "short_turns": (of("conversations").where("length(text) < 20"), "WARN"),
    })


@query(f"""
WITH {PLAN_SQL},
opened AS (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY track ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM judged WHERE verdict = 'APPROVE' AND start < "end"),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY start, "end", id) AS n FROM opened),
taken AS (SELECT track, min(start) AS s, max("end") AS e FROM numbered GROUP BY track, n)
SELECT v.id, v.track, v.start AS t, CASE WHEN max(CASE WHEN s <= v.start AND v.start < e THEN 1 ELSE 0 END) = 1 THEN NULL ELSE v.start - coalesce(sum(CASE WHEN e <= v.start THEN e - s END), 0) END::BIGINT AS new_t
FROM spans v LEFT JOIN taken USING (track) WHERE v.kind = 'view' GROUP BY v.id, v.track, v.start""")
def q96_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From candidates to the new timeline: cuts are verified once and written, those approved are taken out, and every view gets its time in what is left."""
    approved = written(verified_cuts(spark, sf_dir).where("verdict = 'APPROVE'").select("track", "start", "end"), "approved_cuts")
    points = packed_spans(spark, sf_dir).where("kind = 'view'").select("id", "track", F.col("start").alias("t"))
    return intervals.remapped(points, approved, ["track"], HOUR)
