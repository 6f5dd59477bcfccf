"""Queries over words in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators import candidates, running, sequence
from cutloom.plans import views
from cutloom.plans.registry import query
from cutloom.tables import table

STOPS = ", ".join(f"'{w}'" for w in views.NEVER_CUT)


@query(views.RUNS_SQL)
def q02_repetition_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a word that follows itself."""
    return sequence.runs(views.words(spark, sf_dir), ["doc_id"])


@query(f"SELECT doc_id, word, start_pos, n, greatest(80, least(500, (n - 1) * 60 + CASE WHEN right(word, 1) IN ('.', ',') THEN 200 ELSE 0 END))::BIGINT AS pause_ms FROM ({views.RUNS_SQL})")
def q03_dynamic_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pause that stays where a chain is cut to its last word."""
    chains = q02_repetition_chains(spark, sf_dir)
    return chains.withColumn("pause_ms", candidates.pause_ms(F.col("n") - 1, F.substring("word", -1, 1).isin(".", ",")))


@query(f"""
SELECT conv_id, turn, word, pos,
       coalesce(max(CASE WHEN regexp_matches(word, '^[A-Z0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1
    OR coalesce(max(CASE WHEN regexp_matches(word, '^[A-Z0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1 AS guarded
FROM ({views.TURN_WORDS_SQL})""")
def q04_neighbour_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a capital or digit at the head of a word at most two places away."""
    words = views.turn_words(spark, sf_dir)
    return sequence.with_near_any(words, ["conv_id", "turn"], "guarded", F.col("word").rlike("^[A-Z0-9]"))


@query(f"""
SELECT doc_id, word, start_pos, n, n - 1 AS n_cut, greatest(80, least(500, (n - 1) * 60 + CASE WHEN right(word, 1) IN ('.', ',') THEN 200 ELSE 0 END))::BIGINT AS pause_ms
FROM ({views.RUNS_SQL}) WHERE word NOT IN ({STOPS})""")
def q05_repetition_cut_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that are cut to their last word: those of words that may be cut, with the pause that stays."""
    chains = candidates.repetitions(views.words(spark, sf_dir), ["doc_id"], views.word_list(spark))
    n_cut = F.col("n") - 1
    return chains.select("doc_id", "word", "start_pos", "n", n_cut.alias("n_cut"), candidates.pause_ms(n_cut, F.substring("word", -1, 1).isin(".", ",")).alias("pause_ms"))


@query(f"SELECT doc_id, word, pos FROM ({views.WORDS_SQL}) WHERE word IN ({STOPS})")
def q60_filler_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a dictionary, by semi-join."""
    return candidates.fillers(views.words(spark, sf_dir), views.word_list(spark)).select("doc_id", "word", "pos")


@query(f"""
WITH around AS (
  SELECT doc_id, pos,
         list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pre,
         list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS post
  FROM ({views.WORDS_SQL}))
SELECT doc_id, pos, len(list_filter(pre, lambda x: list_contains(post, x))) AS shared FROM around
WHERE len(pre) = 4 AND len(post) = 4 AND len(list_filter(pre, lambda x: list_contains(post, x))) >= 3""")
def q26_restart_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where three of the four words before come again among the four from here on."""
    both = sequence.around(views.words(spark, sf_dir), ["doc_id"], 4).where("size(pre) = 4 AND size(post) = 4")
    shared = F.size(F.filter("pre", lambda x: F.array_contains(F.col("post"), x)))
    return both.select("doc_id", "pos", shared.alias("shared")).where("shared >= 3")


TRIPLES = "[[{0}[2], {0}[3], {0}[4]], [{0}[1], {0}[3], {0}[4]], [{0}[1], {0}[2], {0}[4]], [{0}[1], {0}[2], {0}[3]]]"


@query(f"""
WITH around AS (
  SELECT doc_id, pos,
         list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pre,
         list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS post
  FROM ({views.WORDS_SQL}))
SELECT doc_id, pos, CASE WHEN pre = post THEN 1.0 ELSE 0.75 END::DOUBLE AS ratio FROM around
WHERE len(pre) = 4 AND len(post) = 4 AND (pre = post OR list_has_any({TRIPLES.format("pre")}, {TRIPLES.format("post")}))""")
def q27_self_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where at least three of the four words before come again in order in the four from here on."""
    return candidates.restarts_in_order(views.words(spark, sf_dir), ["doc_id"])


K = 6


@query(f"""
WITH timed AS (SELECT conv_id, turn, pos, word, (pos - 1) * 300 AS start, (pos - 1) * 300 + 20 * length(word) AS "end" FROM ({views.TURN_WORDS_SQL})),
around AS (
  SELECT conv_id, turn, pos, start - lag("end") OVER (PARTITION BY conv_id, turn ORDER BY pos) AS gap,
         list(word) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN {K} PRECEDING AND 1 PRECEDING) AS pre,
         list(word) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING) AS post
  FROM timed),
-- the usual table of common subsequences, one row a word of post
tabled AS (
  SELECT *, list_reduce(
    list_prepend(list_transform(range({K + 1}), lambda i: 0::BIGINT), list_transform(post, lambda y: list_transform(pre, lambda x: (x = y)::BIGINT))),
    lambda above, hits: list_transform(
      list_reduce(list_prepend([0::BIGINT], list_transform(range({K}), lambda i: [i])), lambda own, place: list_append(own, greatest(own[-1], above[place[1] + 2], above[place[1] + 1] + hits[place[1] + 1]))),
      lambda v: v)) AS last
  FROM around WHERE len(pre) = {K} AND len(post) = {K} AND gap >= 200)
SELECT conv_id, turn, pos, last[-1] / {K}.0::DOUBLE AS ratio, gap FROM tabled WHERE last[-1] / {K}.0::DOUBLE >= 0.3""")
def q97_edit_ratio_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places after a pause where the six words from here on resemble the six before by edit ratio."""
    start = (F.col("pos") - 1) * 300
    timed = views.turn_words(spark, sf_dir).withColumns({"start": start, "end": start + 20 * F.char_length("word")})
    return candidates.restarts(timed, ["conv_id", "turn"], K, 0.3, gap=200)


@query(f"""
WITH spans AS ({views.SPANS_SQL}),
marked AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY track ORDER BY start, id) >= 600000 THEN 1 ELSE 0 END AS opens FROM spans)
SELECT id, track, sum(opens) OVER (PARTITION BY track ORDER BY start, id)::BIGINT AS sentence FROM marked""")
def q39_sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of events of a track that a gap of ten minutes or more parts."""
    points = views.spans(spark, sf_dir).select("id", "track", F.col("start").alias("t"))
    return sequence.sentences(points, ["track"], 600_000, 3_600_000).select("id", "track", "sentence")


@query(f"""
WITH words AS ({views.TURN_WORDS_SQL})
SELECT conv_id, turn, sum(CASE WHEN ends THEN 1 ELSE 0 END)::BIGINT AS n_sentences, sum(CASE WHEN right(word, 1) = '?' THEN 1 ELSE 0 END)::BIGINT AS n_questions, max(pos)::BIGINT AS n_words
FROM (SELECT *, right(word, 1) IN ('.', '?', '!') AS ends FROM words) GROUP BY conv_id, turn""")
def q61_sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and questions of each turn by its closing signs."""
    last = F.substring("word", -1, 1)
    return views.turn_words(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count_if(last.isin(".", "?", "!")).alias("n_sentences"), F.count_if(last == "?").alias("n_questions"), F.max("pos").cast("bigint").alias("n_words"))


@query("""
SELECT conv_id, turn, tier, row_number() OVER (PARTITION BY tier ORDER BY length(text) DESC, conv_id, turn) AS place
FROM (SELECT *, CASE WHEN length(text) < 200 THEN 'short' WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'plain' END AS tier FROM conversations)""")
def q44_priority_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns ranked within their whole review tier, a tier sliced by text length."""
    size = F.char_length("text")
    tiered = table(spark, sf_dir, "conversations").withColumn("tier", F.when(size < 200, "short").when(F.col("text").rlike("[0-9]"), "figures").otherwise("plain"))
    sized = tiered.select("conv_id", "turn", "tier", (-size).alias("down"))
    return running.with_place(sized, ["tier"], ["down", "conv_id", "turn"], F.struct("down", F.floor(F.col("conv_id") / 1000))).select("conv_id", "turn", "tier", "place")
