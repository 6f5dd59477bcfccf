"""Queries over intervals and points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import epoch_ms, to_samples
from cutloom.operators import candidates, frames, intervals, media, params, sequence, sync
from cutloom.plans import views
from cutloom.plans.registry import query
from cutloom.tables import table

HOUR = 3_600_000
DAY = 24 * HOUR
SPANS = views.SPANS_SQL
SHIP_SQL = 'SELECT l_orderkey, (epoch_us(l_shipdate) // 1000) // 86400000 AS start, (epoch_us(l_shipdate) // 1000) // 86400000 + l_quantity::BIGINT AS "end" FROM lineitem'
MERGED_SQL = f"""
SELECT l_orderkey, min(start) AS start, max("end") AS "end", count(*) AS n_parts FROM (
  SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY start, "end", opens DESC ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end", rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
    FROM (SELECT *, row_number() OVER () AS rid FROM ({SHIP_SQL}) WHERE start < "end"))) GROUP BY l_orderkey, island"""


def shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item takes as many days from its shipping day as it has pieces."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("start"), (day + F.col("l_quantity").cast("bigint")).alias("end"))


@query(f"""
WITH spans AS ({SPANS}),
gaps AS (SELECT id, track, "end" AS start, lead(start) OVER (PARTITION BY track ORDER BY start, id) AS "end" FROM spans)
SELECT id, track, start, "end" FROM gaps g WHERE "end" - start >= 60000
AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.track <> g.track AND s.start < g."end" AND g.start < s."end")""")
def q07_global_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a minute or more on a track in which every other track is silent too."""
    return candidates.shared_pauses(views.spans(spark, sf_dir), "track", 60_000, 600_000).select("id", "track", "start", "end")


@query(f"""
WITH spans AS ({SPANS})
SELECT id, user_id FROM spans a WHERE track = 'click' AND EXISTS (SELECT 1 FROM spans b WHERE b.user_id <> a.user_id AND b.start BETWEEN a.start - 60000 AND a.start + 60000)""")
def q08_backchannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that another user's event answers within a minute before or after."""
    points = views.spans(spark, sf_dir).select("id", "user_id", "track", F.col("start").alias("t"))
    return candidates.answered(points.where("track = 'click'"), points, "user_id", 60_000, 120_000).select("id", "user_id")


@query("""
WITH counts AS (
  SELECT (epoch_us(ts) // 1000) // 3600000 AS hour, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click,
         round(coalesce(avg(value) FILTER (event_type = 'view'), 0), 4) AS view_level, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 4) AS click_level FROM events GROUP BY 1)
SELECT *, CASE WHEN view_level > 2 * click_level THEN 'primary_view' WHEN click_level > 2 * view_level THEN 'primary_click' ELSE 'ambiguous' END AS label FROM counts""")
def q09_track_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two tracks is the louder one in each tumbling window."""
    hour = F.floor(epoch_ms(F.col("ts")) / HOUR).alias("hour")
    level = lambda kind: F.round(F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)), 4)
    counts = table(spark, sf_dir, "events").groupBy(hour).agg(F.count_if(F.col("event_type") == "view").alias("n_view"), F.count_if(F.col("event_type") == "click").alias("n_click"), level("view").alias("view_level"), level("click").alias("click_level"))
    view, click = F.col("view_level"), F.col("click_level")
    return counts.withColumn("label", F.when(view > 2 * click, "primary_view").when(click > 2 * view, "primary_click").otherwise("ambiguous"))


@query("""
WITH t AS (SELECT event_type, floor(epoch(ts))::BIGINT AS s FROM events),
w AS (SELECT event_type, (s // 1500) * 1500 - k * 1500 AS start_s, s FROM t, (SELECT unnest([0, 1]) AS k))
SELECT start_s, event_type, count(*) AS n FROM w WHERE s < start_s + 1800 GROUP BY ALL""")
def q10_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by sliding window: half an hour every 25 minutes, from the epoch on."""
    windows = table(spark, sf_dir, "events").groupBy(F.window("ts", "30 minutes", "25 minutes"), "event_type").agg(F.count("*").alias("n"))
    return windows.select((epoch_ms(F.col("window.start")) / 1000).cast("bigint").alias("start_s"), "event_type", "n")


@query(f"""
WITH m AS ({MERGED_SQL})
SELECT l_orderkey, start, "end", n_parts, coalesce(sum("end" - start) OVER (PARTITION BY l_orderkey ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS removed FROM m""")
def q16_removed_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cuts of each order and how much the ones before remove."""
    return intervals.removed_before(shipping(spark, sf_dir), ["l_orderkey"], 365).select("l_orderkey", "start", "end", "n_parts", "removed")


@query(f"""
WITH m AS ({MERGED_SQL}), points AS (SELECT o_orderkey AS l_orderkey, (epoch_us(o_orderdate) // 1000) // 86400000 + 60 AS t FROM orders)
SELECT l_orderkey, t, CASE WHEN max(CASE WHEN m.start <= t AND t < m."end" THEN 1 ELSE 0 END) = 1 THEN NULL ELSE t - coalesce(sum(CASE WHEN m."end" <= t THEN m."end" - m.start END), 0) END::BIGINT AS new_t
FROM points LEFT JOIN m USING (l_orderkey) GROUP BY l_orderkey, t""")
def q62_remapped_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of each order on the timeline without the order's cuts; null where it is cut."""
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.unix_date(F.to_date("o_orderdate")) + 60).cast("bigint").alias("t"))
    return intervals.remapped(points, shipping(spark, sf_dir), ["l_orderkey"], 365).withColumn("new_t", F.col("new_t").cast("bigint"))


@query(f"SELECT count(*) AS n_cuts, sum(\"end\" - start)::BIGINT AS removed FROM ({MERGED_SQL})")
def q63_total_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the cuts take out."""
    return intervals.merged(shipping(spark, sf_dir), ["l_orderkey"], 365).agg(F.count("*").alias("n_cuts"), F.sum(F.col("end") - F.col("start")).alias("removed"))


@query("""
SELECT event_type, round(regr_slope(value, s), 9) AS drift, round(regr_intercept(value, s), 4) AS "offset", round(regr_r2(value, s), 6) AS fit,
       CASE WHEN regr_r2(value, s) < 0.5 THEN 'REFUSE' ELSE 'CORRECT' END AS decision
FROM (SELECT *, ((epoch_us(ts) // 1000) - 1704067200000) / 1000.0 AS s FROM events) GROUP BY event_type""")
def q31_clock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and drift of each track by regression; a poor fit is not corrected."""
    timed = table(spark, sf_dir, "events").withColumn("s", (epoch_ms(F.col("ts")) - 1704067200000) / 1000)
    fit = F.regr_r2("value", "s")
    return timed.groupBy("event_type").agg(F.round(F.regr_slope("value", "s"), 9).alias("drift"), F.round(F.regr_intercept("value", "s"), 4).alias("offset"), F.round(fit, 6).alias("fit"), F.when(fit < 0.5, "REFUSE").otherwise("CORRECT").alias("decision"))


@query("SELECT event_id, round((epoch_us(ts) // 1000) * (1 + 12.5 / 1e6))::BIGINT AS corrected_ms FROM events")
def q56_drift_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times stretched by a drift in parts per million."""
    return table(spark, sf_dir, "events").select("event_id", F.round(epoch_ms(F.col("ts")) * F.lit(1 + 12.5 / 1e6)).cast("bigint").alias("corrected_ms"))


@query(f"""
WITH spans AS ({SPANS}), buys AS (SELECT * FROM spans WHERE track = 'purchase'),
near AS (SELECT b.id, s.start, s.value, row_number() OVER (PARTITION BY b.id ORDER BY s.value, s.start) AS n FROM buys b JOIN spans s ON s.track = 'view' AND s.start BETWEEN b.start - 900000 AND b.start + 900000)
SELECT b.id, b.start AS t, coalesce(n.start, b.start) AS snapped_t FROM buys b LEFT JOIN near n ON n.id = b.id AND n.n = 1""")
def q35_snapped_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase moved to the view of least value within a quarter of an hour."""
    spans = views.spans(spark, sf_dir)
    points = spans.where("track = 'purchase'").select("id", F.col("start").alias("t"))
    frames = spans.where("track = 'view'").select(F.col("start").alias("t"), F.col("value").alias("energy"))
    return candidates.snapped(points, frames, 900_000, HOUR)


@query(f"""
WITH spans AS ({SPANS})
SELECT c.id, coalesce(min(s.start), c.start) AS cut_start, coalesce(max(s."end"), c."end") AS cut_end, count(s.id) AS n_covering
FROM (SELECT * FROM spans WHERE track = 'click') c LEFT JOIN (SELECT * FROM spans WHERE track = 'error') s ON s.start <= c.start AND s."end" >= c."end" AND s.start < c."end" AND c.start < s."end"
GROUP BY c.id, c.start, c."end\"""")
def q36_widened_to_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts widened to the spans that cover all of them; others stay as they are."""
    spans = views.spans(spark, sf_dir)
    cuts = spans.where("track = 'click'").select("id", "start", "end")
    covers = intervals.containing(cuts, spans.where("track = 'error'").select(F.col("id").alias("span_id"), "start", "end"), 60_000, salts=8)
    best = covers.groupBy("id").agg(F.min("r_start").alias("s"), F.max("r_end").alias("e"), F.count("*").alias("k"))
    return cuts.join(best, "id", "left").select("id", F.coalesce("s", "start").alias("cut_start"), F.coalesce("e", "end").alias("cut_end"), F.coalesce("k", F.lit(0)).alias("n_covering"))


@query(f"""
WITH spans AS ({SPANS})
SELECT id, start - lag("end") OVER w AS gap_before, lead(start) OVER w - "end" AS gap_after,
       CASE WHEN start - lag("end") OVER w < 50 THEN 'too_tight' WHEN lead(start) OVER w - "end" > 3600000 THEN 'dragging' ELSE 'ok' END AS rhythm
FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start, id)""")
def q64_rhythm_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps to the speaker's span before and after, and whether they are too tight or drag."""
    gapped = sequence.gaps(views.spans(spark, sf_dir), ["user_id"], DAY)
    rhythm = F.when(F.col("gap_before") < 50, "too_tight").when(F.col("gap_after") > HOUR, "dragging").otherwise("ok")
    return gapped.select("id", "gap_before", "gap_after", rhythm.alias("rhythm"))


@query(f"""
WITH spans AS ({SPANS})
SELECT id, greatest(start - 180, coalesce(lag("end") OVER w + 20, start - 180)) AS cut_start, least("end" + 180, coalesce(lead(start) OVER w - 20, "end" + 180)) AS cut_end
FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start, id)""")
def q47_neighbour_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts widened at their edges, but not into the words beside them."""
    return candidates.widened(views.spans(spark, sf_dir), ["user_id"], 180, DAY).select("id", "cut_start", "cut_end")


@query(f"""
WITH spans AS ({SPANS}), right_side AS (SELECT user_id, start, max(id) AS last_view FROM spans WHERE track = 'view' GROUP BY user_id, start)
SELECT l.id, r.last_view FROM (SELECT * FROM spans WHERE track = 'purchase') l ASOF LEFT JOIN right_side r ON l.user_id = r.user_id AND l.start >= r.start""")
def q40_asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's latest view at or before each purchase."""
    spans = views.spans(spark, sf_dir).select("id", "user_id", "track", F.col("start").alias("t"))
    right = spans.where("track = 'view'").select("user_id", "t", F.col("id").alias("last_view"))
    right = right.groupBy("user_id", "t").agg(F.max("last_view").alias("last_view"))
    return intervals.asof(spans.where("track = 'purchase'").drop("track"), right, ["user_id"], DAY, "last_view").select("id", "last_view")


@query(f"""
WITH spans AS ({SPANS}), near AS (
  SELECT c.id, q.start AS s, q."end" AS e, row_number() OVER (PARTITION BY c.id ORDER BY greatest(q.start - c.start, c.start - q."end", 0), q.start - q."end", q.start) AS n
  FROM (SELECT * FROM spans WHERE track = 'error') c JOIN (SELECT * FROM spans WHERE track = 'signup' AND value < 20) q ON q.start < c.start + 1800001 AND c.start - 1800000 < q."end")
SELECT id, s AS tone_start, e AS tone_end FROM near WHERE n = 1""")
def q53_quiet_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest quiet span within half an hour of each cut."""
    spans = views.spans(spark, sf_dir)
    cuts = spans.where("track = 'error'").select("id", F.col("start").alias("t"))
    return candidates.quiet_spot(cuts, spans.where("track = 'signup' AND value < 20"), 1_800_000, HOUR)


@query("""
SELECT l_orderkey, l_linenumber, round((epoch_us(l_shipdate) // 1000) * 48000 / 1000.0)::BIGINT AS start_sample,
       greatest(0, least(round(50 * 48000 / 1000.0), l_quantity::BIGINT * 100 - 128))::BIGINT AS crossfade
FROM lineitem""")
def q41_edl_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut starts in whole samples, and cross-fades that leave a guard of their cut."""
    start = to_samples(epoch_ms(F.col("l_shipdate")))
    fade = params.crossfade_samples(F.lit(50), F.col("l_quantity").cast("bigint") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start_sample"), fade.alias("crossfade"))


@query(f"""
WITH spans AS ({SPANS}), timed AS (SELECT user_id, track, start, "end" FROM spans)
SELECT user_id, track, list_min(list(start)) AS cut_start, list_sort(list({{'s': start, 'e': "end"}}))[-2].e AS cut_end, count(*) AS n
FROM timed GROUP BY user_id, track HAVING count(*) > 1""")
def q65_chain_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain's cut: from its first start to the end of its last but one."""
    return candidates.chain_extent(views.spans(spark, sf_dir), ["user_id", "track"])


@query("""
WITH m AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, max(value) AS peak, avg(value) AS level FROM events GROUP BY ALL),
z AS (SELECT event_type, day, peak, round((peak - avg(peak) OVER (PARTITION BY event_type)) / nullif(stddev_samp(peak) OVER (PARTITION BY event_type), 0), 6) AS score FROM m)
SELECT event_type, day::VARCHAR AS day, peak, score, dense_rank() OVER (PARTITION BY event_type ORDER BY score DESC, day) AS place FROM z""")
def q45_anomaly_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a track by how far their peak is from its usual one."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("peak"))
    own = Window.partitionBy("event_type")
    scored = days.withColumn("score", F.round((F.col("peak") - F.avg("peak").over(own)) / F.nullif(F.stddev_samp("peak").over(own), F.lit(0.0)), 6))
    return scored.select("event_type", F.col("day").cast("string").alias("day"), "peak", "score", F.dense_rank().over(own.orderBy(F.desc("score"), "day")).alias("place"))


@query(f"""
WITH spans AS ({SPANS})
SELECT id, start FROM spans a WHERE track = 'error' AND value >= 100
AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.track = 'view' AND s.start < a."end" AND a.start < s."end")""")
def q66_transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud spans of one track during which another is silent."""
    spans = views.spans(spark, sf_dir)
    loud = spans.where("track = 'error' AND value >= 100").select("id", "start", "end")
    speech = intervals.covered(spans.where("track = 'view'"), ["track"], DAY).select("start", "end")
    speech = intervals.overlap_join(loud, speech, 120_000).select("id")
    return loud.join(speech, "id", "left_anti").select("id", "start")


@query("""
WITH frames AS (SELECT event_type AS track, epoch_us(ts) // 600000000 AS frame, max(value) AS level FROM events GROUP BY ALL),
around AS (SELECT *, quantile_cont(level, 0.5) OVER (PARTITION BY track ORDER BY frame RANGE BETWEEN 18 PRECEDING AND 18 FOLLOWING) AS median FROM frames)
SELECT track, frame, level, round(median, 6) AS median FROM around WHERE level >= 2 * median""")
def q98_peaks_over_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute frames of a track whose peak is twice the rolling median of three hours before and after."""
    frame = F.floor(epoch_ms(F.col("ts")) / 600_000).alias("frame")
    levels = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("track"), frame).agg(F.max("value").alias("level"))
    return frames.peaks(levels, ["track"], "frame", "level", 18, 2.0, 1_008).withColumn("median", F.round("median", 6))


@query(f"""
WITH frames AS (SELECT event_type AS track, epoch_us(ts) // 600000000 AS frame, max(value) AS level FROM events GROUP BY ALL),
around AS (SELECT *, quantile_cont(level, 0.5) OVER (PARTITION BY track ORDER BY frame RANGE BETWEEN 18 PRECEDING AND 18 FOLLOWING) AS median FROM frames),
spoken AS (SELECT DISTINCT unnest(range(start // 600000, ("end" - 1) // 600000 + 1)) AS frame FROM ({SPANS}) WHERE track = 'view' AND "end" > start)
SELECT frame, level, 'human_review_required' AS state FROM around WHERE track = 'error' AND level >= 1.5 * median AND frame NOT IN (SELECT frame FROM spoken)""")
def q113_transients_without_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in which one track stands out of its surroundings while nobody speaks on another; a person reviews them."""
    spans = views.spans(spark, sf_dir)
    frame = F.floor(F.col("start") / 600_000).alias("frame")
    levels = spans.where("track = 'error'").groupBy("track", frame).agg(F.max("value").alias("level"))
    spoken = media.frames(spans.where("track = 'view'"), 600_000).select("frame").distinct()
    loud = frames.peaks(levels, ["track"], "frame", "level", 18, 1.5, 1_008)
    return loud.join(spoken, "frame", "left_anti").select("frame", "level", F.lit("human_review_required").alias("state"))


#: Largest offset, stretch of time and cell of the vote, in ms; the drift that the second clock is given, in parts per million.
MOST, STRETCH, CELL, DRIFT = 120_000, 6 * HOUR, 400, 35


@query(f"""
WITH spans AS ({SPANS}), a AS (SELECT start AS t FROM spans WHERE id % 7 <> 0), origin AS (SELECT min(start) AS o FROM spans),
b AS (SELECT start + (start - o) * {DRIFT} // 1000000 + 120 AS t FROM spans, origin WHERE id % 5 <> 0),
pairs AS (SELECT a.t AS t_a, b.t - a.t AS d FROM a JOIN b ON b.t BETWEEN a.t - {MOST} AND a.t + {MOST}),
cells AS (SELECT t_a // {STRETCH} AS stretch, floor(d / {CELL})::BIGINT AS cell, count(*) AS n, sum(d) AS sum_d, sum(t_a) AS sum_t FROM pairs GROUP BY ALL),
two AS (SELECT stretch, cell, sum(n) OVER w AS n, sum(sum_d) OVER w AS sum_d, sum(sum_t) OVER w AS sum_t FROM cells WINDOW w AS (PARTITION BY stretch ORDER BY cell RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stretch ORDER BY n DESC, cell) AS r FROM two) WHERE r = 1 AND n >= 3),
peaks AS (SELECT stretch, n::BIGINT AS n, sum_d::BIGINT / n::BIGINT AS d, sum_t::BIGINT / n::BIGINT - (SELECT min(t) FROM a) AS t FROM best),
placed AS (SELECT *, row_number() OVER (ORDER BY stretch) AS place, count(*) OVER () // 2 AS half FROM peaks),
slope AS (SELECT quantile_cont((y.d - x.d) / (y.t - x.t), 0.5) AS s FROM placed x JOIN placed y ON y.place = x.place + x.half WHERE x.half > 0),
rests AS (SELECT n, d - s * t AS rest FROM peaks, slope), middle AS (SELECT quantile_cont(rest, 0.5) AS m FROM rests)
SELECT 0 AS pair, round(max(m), 2) AS offset_ms, round(max(s) * 1e6, 3) AS drift_ppm, round(sum(CASE WHEN abs(rest - m) <= {2 * CELL} THEN n ELSE 0 END) / (SELECT count(*) FROM a), 6) AS share,
       CASE WHEN sum(CASE WHEN abs(rest - m) <= {2 * CELL} THEN n ELSE 0 END) / (SELECT count(*) FROM a) >= 0.5 THEN 'CORRECT' ELSE 'REFUSE' END AS decision
FROM rests, middle, slope""")
def q99_clock_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and drift of a second clock that hears most of the events and some that the first one misses, by votes of time differences."""
    spans = views.spans(spark, sf_dir)
    origin = spans.agg(F.min("start").alias("o")).first()["o"]
    a = spans.where("id % 7 <> 0").select(F.lit(0).alias("pair"), F.col("start").alias("t"))
    late = F.col("start") + F.floor((F.col("start") - origin) * DRIFT / 1_000_000) + 120
    b = spans.where("id % 5 <> 0").select(F.lit(0).alias("pair"), late.alias("t"))
    fit = sync.clock_fit(a, b, ["pair"], MOST, STRETCH, CELL, salts=4)
    return fit.select("pair", F.round("offset_ms", 2).alias("offset_ms"), F.round("drift_ppm", 3).alias("drift_ppm"), F.round("share", 6).alias("share"), "decision")


@query(f"SELECT id, greatest(start - 2000, 0) AS context_start, \"end\" + 3000 AS context_end FROM ({SPANS})")
def q74_context_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with what surrounds them, for previews."""
    return media.with_context(views.spans(spark, sf_dir), 2000, 3000).select("id", "context_start", "context_end")


@query(f"SELECT id, track, greatest(start - 2000, 0) AS context_start, \"end\" + 3000 AS context_end FROM ({SPANS}) WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q116_preview_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that a sample names, with what surrounds them."""
    sample = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return media.preview_segments(views.spans(spark, sf_dir), sample, 2000, 3000).select("id", "track", "context_start", "context_end")


@query("""
SELECT quantile_cont(a - b, 0.5) AS "offset", count(*) AS n FROM
(SELECT l_orderkey AS k, max(epoch_us(l_shipdate) // 86400000000) AS a FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 AS b FROM orders) USING (k)""")
def q75_timeline_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median distance of two timelines over the segments they share."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("bigint")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(day("l_shipdate")).alias("t"))
    return media.timeline_offset(shipped, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("t")), "k")


@query(f"""
WITH spans AS ({SPANS})
SELECT c.id, count(*) AS n, max(abs(p.value)) AS peak, sum(round(p.value * 100)::BIGINT * round(p.value * 100)::BIGINT)::BIGINT AS energy
FROM (SELECT * FROM spans WHERE track = 'signup') c JOIN spans p ON p.start BETWEEN c.start - 600000 AND c.start + 600000 GROUP BY c.id""")
def q76_edge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak and energy of what lies around each cut."""
    points = views.spans(spark, sf_dir).select("id", "track", "value", F.col("start").alias("t"))
    found = media.edge_levels(points.where("track = 'signup'"), points, 600_000, HOUR)
    # values have two places, so their squares sum to whole ten-thousandths
    return found.select("id", "n", "peak", F.round(F.col("mean_square") * F.col("n") * 10_000).cast("bigint").alias("energy"))


@query("""
WITH l AS (SELECT epoch_us(ts) // 3600000000 AS hour, event_type, round(sum(value), 2) AS level FROM events GROUP BY ALL)
SELECT hour, event_type, level FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY level DESC, event_type) AS n FROM l) WHERE n = 1""")
def q77_dominant_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudest track of each hour."""
    hour = F.floor(epoch_ms(F.col("ts")) / HOUR).alias("hour")
    levels = table(spark, sf_dir, "events").groupBy(hour, "event_type").agg(F.round(F.sum("value"), 2).alias("level"))
    return media.dominant(levels, "hour", "event_type", "level")


@query(f"""
WITH spans AS ({SPANS})
SELECT id, unnest(range(start // 60000, ("end" - 1) // 60000 + 1)) AS frame, least("end", (frame + 1) * 60000) - greatest(start, frame * 60000) AS covered FROM spans WHERE "end" > start""")
def q80_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes that each span touches, and how much of them it covers."""
    return media.frames(views.spans(spark, sf_dir), 60_000)
