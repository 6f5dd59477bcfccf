"""Checks of a cut plan: what was heard there, where silence lies, what gaps are left to the words around, how to splice, and with which parameters.

Each check is of a cut's own track: ``keys`` are in every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.operators import extremes, gates, intervals
from cutloom.operators.params import HEAD_PADS, SPLICES


def word_evidence(cuts: DataFrame, words: DataFrame, keys: list[str], width: int, kinds: tuple[str, ...], least: float = 0.6, salts: int = 1) -> DataFrame:
    """``cuts`` (id, kind, keys, start, end) with n_words and min_probability of the ``words`` (keys, start, end, probability) of their track that they overlap, and ``heard``:
    REJECT_LOW_PROB_HALLUCINATION for the ``kinds`` named with a word under ``least``, NO_WORD without words, else KEEP.

    A null probability is no evidence; a cut without overlapping words has 0 words and a null minimum.
    """
    met = intervals.overlap_join(cuts.select("id", *keys, "start", "end"), words.select(*keys, "start", "end", "probability"), width, keys, salts)
    found = met.groupBy("id").agg(F.count("*").alias("n_words"), F.min("probability").alias("min_probability"))
    joined = cuts.join(found, "id", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    heard = F.when(F.col("kind").isin(*kinds) & (F.col("min_probability") < least), "REJECT_LOW_PROB_HALLUCINATION").when(F.col("n_words") == 0, "NO_WORD").otherwise("KEEP")
    return joined.withColumn("heard", heard)


def silences(levels: DataFrame, keys: list[str], slice_width: int, threshold: float, least: int) -> DataFrame:
    """(keys, start, end) of the islands of touching frames (start, end, level) under ``threshold`` that last ``least`` or longer."""
    quiet = levels.where(F.col("level") < threshold)
    return intervals.merged(quiet, keys, slice_width).where(F.col("end") - F.col("start") >= least).select(*keys, "start", "end")


def located(cuts: DataFrame, silence: DataFrame, keys: list[str], width: int, salts: int = 1) -> DataFrame:
    """``cuts`` (id, keys, start, end) with ``location`` by the ``silence`` (keys, start, end) of their track: CUT_IN_SILENCE where one holds all of it, CUT_SPANS_BOUNDARY where
    one is only overlapped, CUT_IN_CONTENT_ZONE where none is, and null where the track has no silence at all."""
    met = intervals.overlap_join(cuts.select("id", *keys, "start", "end"), silence.select(*keys, "start", "end"), width, keys, salts)
    held = met.groupBy("id").agg(F.bool_or((F.col("r_start") <= F.col("l_start")) & (F.col("r_end") >= F.col("l_end"))).alias("_held"))
    known = silence.select(*keys).distinct().withColumn("_known", F.lit(True))
    location = F.when(F.col("_held"), "CUT_IN_SILENCE").when(~F.col("_held"), "CUT_SPANS_BOUNDARY").when(F.col("_known"), "CUT_IN_CONTENT_ZONE")
    return cuts.join(held, "id", "left").join(known, keys, "left").withColumn("location", location).drop("_held", "_known")


def word_gaps(cuts: DataFrame, words: DataFrame, keys: list[str], slice_width: int) -> DataFrame:
    """``cuts`` (id, keys, start, end) with gap_before and gap_after to the ``words`` (keys, start, end) of their track that stay; null where none is.

    A word stays before a cut if its middle does, and after it if its middle is at the cut's end or later; what a cut takes of it makes the gap negative.
    """
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    rows = words.select(*keys, middle.alias("t"), "start", "end")
    edge = lambda c: cuts.select(*keys, "id", F.col(c).alias("t"))
    whole, at = F.lit(0), F.col("t")
    before = extremes.swept(edge("start"), rows, keys, at, -1, whole, F.col("_at"), slice_width, _last=("max", "end"))
    after = extremes.swept(edge("end"), rows, keys, at, 1, whole, -F.col("_at"), slice_width, _first=("min", "start"))
    joined = cuts.join(before, "id", "left").join(after, "id", "left")
    return joined.withColumns({"gap_before": F.col("start") - F.col("_last"), "gap_after": F.col("_first") - F.col("end")}).drop("_last", "_first")


def rhythm(gap_before: Column, gap_after: Column, location: Column, before: tuple[float, float] = (120, 300), after: tuple[float, float] = (120, 450), reject: float = 50) -> Column:
    """What the gaps beside a cut are, by the first that holds: RHYTHM_INVALID_NEGATIVE_GAP where words are cut into, RHYTHM_REJECT under ``reject`` before a cut outside silence,
    RHYTHM_TOO_TIGHT under or RHYTHM_DRAGGING over their target ranges, else RHYTHM_OK. A null gap, at an end, is within."""
    return gates.first_match(
        [
            (F.least(gap_before, gap_after) < 0, "RHYTHM_INVALID_NEGATIVE_GAP"),
            ((gap_before < reject) & ~F.coalesce(location == "CUT_IN_SILENCE", F.lit(False)), "RHYTHM_REJECT"),
            (F.coalesce(gap_before < before[0], F.lit(False)) | F.coalesce(gap_after < after[0], F.lit(False)), "RHYTHM_TOO_TIGHT"),
            (F.coalesce(gap_before > before[1], F.lit(False)) | F.coalesce(gap_after > after[1], F.lit(False)), "RHYTHM_DRAGGING"),
        ],
        "RHYTHM_OK",
    )


def recommended(strategy: Column, kind: Column) -> Column:
    """The parameters that go with a splice and a class: crossfade_ms and room_tone_ms (null where nothing is spliced), pad_before_ms and pad_after_ms (null for classes without pads of their own)."""
    of = lambda i, table, key: F.coalesce(*(F.when(key == name, F.lit(values[i])) for name, values in table.items()))
    return F.struct(of(0, SPLICES, strategy).alias("crossfade_ms"), of(1, SPLICES, strategy).alias("room_tone_ms"), of(0, HEAD_PADS, kind).alias("pad_before_ms"), of(1, HEAD_PADS, kind).alias("pad_after_ms"))


def expanded(cuts: DataFrame, words: DataFrame, keys: list[str], kinds: tuple[str, ...], width: int, salts: int = 1) -> DataFrame:
    """``cuts`` (id, kind, keys, start, end) with cut_start and cut_end: of the ``kinds`` named, the word of their track that holds all of it (of several the widest reach), else their own."""
    own = cuts.where(F.col("kind").isin(*kinds)).select("id", *keys, "start", "end")
    held = intervals.containing(own, words.select(*keys, "start", "end"), width, keys, salts).groupBy("id").agg(F.min("r_start").alias("_s"), F.max("r_end").alias("_e"))
    return cuts.join(held, "id", "left").withColumns({"cut_start": F.coalesce("_s", "start"), "cut_end": F.coalesce("_e", "end")}).drop("_s", "_e")


def verified(cuts: DataFrame, words: DataFrame, silence: DataFrame, keys: list[str], kinds: tuple[str, ...], width: int, slice_width: int, salts: int = 1) -> DataFrame:
    """The four checks of each cut (id, kind, keys, start, end) and what follows: n_words, min_probability, heard, location, gap_before, gap_after, rhythm, strategy, params
    and ``verdict`` (REJECT for what goes out of the plan, HUMAN_REVIEW, or APPROVE).

    ``words`` (keys, start, end, probability) and ``silence`` (keys, start, end) of all tracks; only those of a cut's own keys count.
    """
    heard = word_evidence(cuts, words, keys, width, kinds, salts=salts)
    gapped = word_gaps(located(heard, silence, keys, width, salts), words, keys, slice_width)
    judged = gapped.withColumn("rhythm", rhythm(F.col("gap_before"), F.col("gap_after"), F.col("location")))
    judged = judged.withColumn("strategy", gates.splice_strategy(F.col("heard"), F.col("rhythm"), F.col("location")))
    verdict = F.when((F.col("strategy") == "REMOVE_FROM_EDL") | (F.col("rhythm") == "RHYTHM_REJECT"), "REJECT").when(F.col("strategy").contains("HUMAN_REVIEW"), "HUMAN_REVIEW").otherwise("APPROVE")
    return judged.withColumns({"params": recommended(F.col("strategy"), F.col("kind")), "verdict": verdict})
