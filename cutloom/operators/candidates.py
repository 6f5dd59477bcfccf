"""Candidates for removal, and the arithmetic of cutting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import clamp
from cutloom.functions.sequences import edit_ratio
from cutloom.operators import extremes, intervals, sequence
from cutloom.operators.frames import sliding
from cutloom.operators.running import same


def fillers(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words that the dictionary (word) lists."""
    return words.join(dictionary.select("word").distinct(), "word", "left_semi")


def repetitions(words: DataFrame, keys: list[str], never_cut: DataFrame, least: int = 2) -> DataFrame:
    """Chains of equal words, without the words that are never cut however long their chain is."""
    return sequence.runs(words, keys, least).join(never_cut.select("word").distinct(), "word", "left_anti")


def pause_ms(n_cut: Column, separated: Column, per_cut: int = 60, bonus: int = 200, low: int = 80, high: int = 500) -> Column:
    """The pause that stays where ``n_cut`` words of a chain go."""
    return clamp(n_cut * per_cut + F.when(separated, bonus).otherwise(0), low, high).cast("bigint")


def chain_extent(chain: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut_start, cut_end, n) of chains of timed words: all but the last word go, from the first start to the last but one's end.

    Only the last two words of a chain are ranked; a long chain is never gathered.
    """
    whole = chain.groupBy(*keys).agg(F.min("start").alias("cut_start"), F.count("*").alias("n"))
    from_last = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("end"))
    ends = chain.withColumn("_n", F.row_number().over(from_last)).where("_n <= 2").where("_n = 2").select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("end").alias("cut_end"))
    return whole.join(ends, same(whole, ends, keys, "_k_")).select(*keys, "cut_start", "cut_end", "n")


def widened(cuts: DataFrame, keys: list[str], edge: Column | int, slice_width: int, pad: int = 20, onset: int = 20) -> DataFrame:
    """``cuts`` (keys, start, end, id) widened by ``edge`` on both sides to cut_start and cut_end: no closer than ``pad`` to the word before, and ``onset`` before the next, which is kept."""
    found = sequence.with_neighbours(cuts, keys, slice_width)
    edge = F.lit(edge) if isinstance(edge, int) else edge
    return found.withColumns({"cut_start": F.greatest(F.col("start") - edge, F.col("prev_end") + pad), "cut_end": F.least(F.col("end") + edge, F.col("next_start") - onset)}).drop("prev_end", "next_start")


def refined(cuts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``cuts`` (id, start, end) with cut_start and cut_end: the refined ones of ``boundaries`` (id, refined_start, refined_end) where given, and ``origin``."""
    joined = cuts.join(boundaries, "id", "left")
    both, none = F.col("refined_start").isNotNull() & F.col("refined_end").isNotNull(), F.col("refined_start").isNull() & F.col("refined_end").isNull()
    origin = F.when(none, "asr").when(both, "refined").otherwise("mixed")
    return joined.withColumns({"cut_start": F.coalesce("refined_start", "start"), "cut_end": F.coalesce("refined_end", "end"), "origin": origin}).drop("refined_start", "refined_end")


def shared_pauses(spans: DataFrame, track: str, least: int, width: int) -> DataFrame:
    """Gaps of ``least`` or more on one track in which no other track has a span: track, start, end, id (of the span before).

    Spans of a track are merged first, so a gap meets what they cover and not each of them.
    """
    after = sequence.with_neighbours(spans.select(track, "start", "end", "id"), [track], 100 * width)
    gaps = after.select(track, F.col("end").alias("start"), F.col("next_start").alias("end"), "id").where(F.col("end") - F.col("start") >= least)
    others = intervals.covered(spans, [track], 100 * width).withColumnRenamed(track, "_other")
    broken = intervals.overlap_join(gaps, others, width).where(F.col(track) != F.col("_other")).select("id")
    return gaps.join(broken, "id", "left_anti")


def answered(words: DataFrame, others: DataFrame, track: str, reach: int, width: int) -> DataFrame:
    """The ``words`` (id, t, track) that another track's row of ``others`` (t, track) lies within ``reach`` of.

    Time is cut into bins of ``width``, or of the reach if that is less. Of a bin, a word in it or beside it needs only the first and the last rows of two tracks:
    if any track other than the word's own comes near enough there, one of these does. So no pairs are made, however dense the rows are.
    """
    width = min(width, reach)
    bins = others.where(F.col("t").isNotNull() & F.col(track).isNotNull()).groupBy(F.floor(F.col("t") / width).alias("_bin"), F.col(track).alias("_other")).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    # a row number with a bound lets each task send on only what can win
    by = lambda *order: F.row_number().over(Window.partitionBy("_bin").orderBy(*order))
    first = bins.withColumn("_n", by("_first", "_other")).where("_n <= 2").select("_bin", "_other", F.col("_first").alias("_t"))
    last = bins.withColumn("_n", by(F.desc("_last"), "_other")).where("_n <= 2").select("_bin", "_other", F.col("_last").alias("_t"))
    ends = first.unionByName(last).groupBy("_bin").agg(F.collect_list(F.struct("_other", "_t")).alias("_ends"))
    own, far = F.floor(F.col("t") / width), -(-reach // width)
    beside = words.select("id", F.col(track).alias("_own"), "t", F.explode(F.sequence(own - far, own + far)).alias("_bin"))
    heard = F.exists("_ends", lambda x: (x["_other"] != F.col("_own")) & (F.abs(x["_t"] - F.col("t")) <= reach))
    return words.join(beside.join(ends, "_bin").where(heard).select("id"), "id", "left_semi")


def without_backchannel(found: DataFrame, speech: DataFrame, roles: DataFrame, tokens: tuple[str, ...], track: str, role: str = "host", reach: int = 3_000, width: int = 60_000) -> DataFrame:
    """``found`` (id, token, t, track) without what only answers another speaker: one of the ``tokens``, said on a track whose role (``roles``: track, role) is ``role``, while
    another track speaks (``speech``: t, track) within ``reach`` of it.

    Tracks without a role, and tokens or times that are null, are never taken for an answer.
    """
    said = found.where(F.col("token").isin(*tokens)).join(roles.where(F.col("role") == role).select(track), track, "left_semi")
    return found.join(answered(said, speech, track, reach, width).select("id"), "id", "left_anti")


def fillers_and_pauses(words: DataFrame, speech: DataFrame, roles: DataFrame, fillers: tuple[str, ...], backchannel: tuple[str, ...], track: str, least_pause: int, reach: int, width: int) -> DataFrame:
    """One table of candidates (kind, id, track, start, end): filler words that are no backchannel, and pauses of all tracks.

    ``words`` (id, track, token, start, end); ``speech`` (id, track, start, end) is all that is said. A pause has the id of the span before it.
    """
    spoken = words.where(F.col("token").isin(*fillers)).withColumn("t", F.col("start"))
    kept = without_backchannel(spoken, speech.select(track, F.col("start").alias("t")), roles, backchannel, track, reach=reach, width=width)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", track, "start", "end")
    return named(kept, "filler").unionByName(named(shared_pauses(speech, track, least_pause, width), "pause"))


def restarts(words: DataFrame, keys: list[str], k: int = 4, least: float = 0.75, gap: float | None = None, slice_width: int = sequence.WORDS) -> DataFrame:
    """Places where the ``k`` words from here on resemble the ``k`` before in order: keys, pos, ratio (edit ratio, ``least`` or more).

    With ``gap``, words have start and end, and only places with so long a pause before the word count (``gap`` comes out too); a null time is no
    pause. The first and last words of a key, without ``k`` on either side, are none.
    """
    timed = [] if gap is None else ["start", "end"]
    listed = F.collect_list("word")
    frames = {"pre": (listed, -k, -1), "post": (listed, 0, k - 1)} | ({} if gap is None else {"_heard": (F.last("end"), -1, -1)})
    both = sliding(words.select(*keys, "pos", "word", *timed), keys, "pos", slice_width, True, **frames).where((F.size("pre") == k) & (F.size("post") == k))
    if gap is not None:
        both = both.withColumn("gap", F.col("start") - F.col("_heard")).where(F.col("gap") >= gap)
    alike = both.where(F.arrays_overlap("pre", "post")).withColumn("ratio", edit_ratio(F.col("pre"), F.col("post"), k)).where(F.col("ratio") >= least)
    return alike.select(*keys, "pos", "ratio", *([] if gap is None else ["gap"]))


def restarts_in_order(words: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """Places where the ``k`` words from here on are the ``k`` before, or are so with one word of each left out: keys, pos, ratio (1, or 1 - 1 / k).

    Words match in order, wherever they stand; ``restarts`` may find fewer. Places where the sides do not even share so many words are dropped before that is looked at.
    """
    less_one = lambda side: F.array(*(F.array(*(F.get(side, F.lit(j)) for j in range(k) if j != i)) for i in range(k)))
    both = sequence.around(words, keys, k).where((F.size("pre") == k) & (F.size("post") == k))
    both = both.where(F.size(F.filter("pre", lambda x: F.array_contains(F.col("post"), x))) >= k - 1)
    ratio = F.when(F.col("pre") == F.col("post"), 1.0).when(F.arrays_overlap(less_one(F.col("pre")), less_one(F.col("post"))), 1 - 1 / k)
    return both.withColumn("ratio", ratio).where("ratio IS NOT NULL").select(*keys, "pos", "ratio")


def snapped(points: DataFrame, frames: DataFrame, reach: int, slice_width: int) -> DataFrame:
    """``points`` (id, t) with ``snapped_t``: the frame (t, energy) of least energy within ``reach``, the earliest of equals; t itself where none is."""
    best = extremes.around(points, frames.select("t", F.struct("energy", "t").alias("best")), [], reach, slice_width, best=("min", "best"))
    return points.join(best, "id", "left").withColumn("snapped_t", F.coalesce(F.col("best")["t"], "t")).drop("best")


def quiet_spot(cuts: DataFrame, quiet: DataFrame, reach: int, slice_width: int) -> DataFrame:
    """For each cut (id, t) the nearest quiet span (start, end) within ``reach`` (1 or more) of it, the longer, then earlier of equals: id, tone_start, tone_end.

    The nearest one before, the nearest one after and the longest one around the cut are each found in a sweep or through dyadic cells; no pairs are made.
    """
    t, first = F.col("t"), F.lit(0)
    by_end = quiet.select(F.col("end").alias("t"), F.struct(F.col("end").alias("e"), (F.col("end") - F.col("start")).alias("long")).alias("best"))
    by_start = quiet.select(F.col("start").alias("t"), F.struct(F.col("start").alias("s"), (F.col("start") - F.col("end")).alias("l")).alias("best"))
    before = extremes.swept(cuts, by_end, [], t, -1, first, F.col("_at"), slice_width, best=("max", "best"))
    after = extremes.swept(cuts, by_start, [], t, -1, first, -F.col("_at"), slice_width, best=("min", "best"))
    held = extremes.stabbed(cuts, quiet, [], F.struct((F.col("start") - F.col("end")).alias("l"), F.col("start").alias("s")))
    spot = lambda d, s, e: F.struct(d.alias("d"), (s - e).alias("l"), s.alias("s"), e.alias("e"))
    at, best = cuts.select("id", "t"), F.col("best")
    left = at.join(before, "id").where(best["e"] > t - reach).select("id", spot(t - best["e"], best["e"] - best["long"], best["e"]).alias("x"))
    right = at.join(after, "id").where(best["s"] <= t + reach).select("id", spot(best["s"] - t, best["s"], best["s"] - best["l"]).alias("x"))
    inside = held.select("id", spot(F.lit(0).cast("bigint"), best["s"], best["s"] - best["l"]).alias("x"))
    nearest = left.union(right).union(inside).groupBy("id").agg(F.min("x").alias("x"))
    return nearest.select("id", F.col("x")["s"].alias("tone_start"), F.col("x")["e"].alias("tone_end"))
