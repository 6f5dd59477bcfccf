"""Gates, routers and labels: ordered rules over columns, with their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with a boolean for each gate, ``first_fail`` (its name; null if none fails) and ``auto_cut`` (all passed). A gate that is null fails."""
    passed = rows.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in gates})
    fails = F.coalesce(*(F.when(~F.col(name), F.lit(name)) for name, _ in gates))
    return passed.withColumn("first_fail", fails).withColumn("auto_cut", F.col("first_fail").isNull())


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; a rule that is null does not."""
    found = F.coalesce(*(F.when(test, F.lit(label)) for test, label in rules))
    return F.coalesce(found, F.lit(otherwise))


def reject_improbable(kind: Column, probability: Column, kinds: Sequence[str], least: float = 0.6) -> Column:
    """REJECT below ``least`` for the kinds named, else KEEP; a null probability keeps (no evidence against)."""
    return F.when(kind.isin(*kinds) & (probability < least), "REJECT").otherwise("KEEP")


def splice_strategy(heard: Column, rhythm: Column, location: Column) -> Column:
    """How to splice a cut, by the first of seven rules over its three checks that holds."""
    return first_match(
        [
            (heard == "REJECT_LOW_PROB_HALLUCINATION", "REMOVE_FROM_EDL"),
            (rhythm == "RHYTHM_INVALID_NEGATIVE_GAP", "REMOVE_FROM_EDL"),
            (rhythm == "RHYTHM_TOO_TIGHT", "NEEDS_HUMAN_REVIEW"),
            (location == "CUT_IN_SILENCE", "BUTT_SPLICE"),
            (location == "CUT_SPANS_BOUNDARY", "CROSSFADE_50MS"),
            (location == "CUT_IN_CONTENT_ZONE", "CROSSFADE_100MS_HUMAN_REVIEW"),
        ],
        "CROSSFADE_50MS",
    )


def single_character_guard(word: Column, foreign_near: Column, probability: Column, least: float = 0.6) -> Column:
    """Whether a word is one character that is never cut: a foreign word is near it, or its probability is under ``least``."""
    return (F.char_length(word) == 1) & (foreign_near | F.coalesce(probability < least, F.lit(False)))


def inside_edges(start: Column, end: Column, duration: Column, edge: float) -> Column:
    """Whether a cut stays out of the first and last ``edge`` of a recording."""
    return (start >= edge) & (end <= duration - edge)


def list_guard(kind: Column, allowed: Sequence[str], forbidden: Column, at_edge: Column) -> Column:
    """Why a case may not be cut by a machine: its kind is not listed, it is forbidden, or it is at an edge; else open."""
    return first_match([(~kind.isin(*allowed), "not_listed"), (forbidden, "forbidden"), (at_edge, "edge")], "open")


def preference_triage(hard_negative: Column, target: Column) -> Column:
    """drop a hard negative, keep a main target, leave the rest to a person."""
    return first_match([(hard_negative, "drop"), (target, "keep")], "human_review")


def artifact_risk(level_db: Column, review: float = -50, block: float = -25) -> Column:
    """OK below ``review`` dBFS, BLOCK from ``block`` on, HUMAN_REVIEW between or without a level."""
    return F.when(level_db < review, "OK").when(level_db >= block, "BLOCK").otherwise("HUMAN_REVIEW")


def tolerance(value: Column, target: float, within: float) -> Column:
    return F.when(F.abs(value - target) <= within, "PASS").otherwise("FAIL")


def cut_scope(kind: Column, one_track: Sequence[str]) -> Column:
    """Noises of one track mute that track; all else is cut from every track."""
    return F.when(kind.isin(*one_track), "source_track_gate").otherwise("render_sync_cut")


def paraphrase_scope(ratio: Column, least: float = 0.85) -> Column:
    return F.when(ratio < least, "both_spans").otherwise("first_span")


def learning_stream(notes: Column, gold: Column) -> Column:
    """Where a set of notes goes: gold cuts first, a batch from five on, a single note; two to four are held as a small batch."""
    return F.when(gold, "gold_edl").when(notes >= 5, "batch").when(notes == 1, "single_note").when(notes > 1, "small_batch").otherwise("none")


def verdict_or_review(verdict: Column) -> Column:
    """A judge's verdict, NEEDS_REVIEW where it is missing or unknown."""
    return F.when(verdict.isin("KEEP_CUT", "REJECT_KEEP", "NEEDS_REVIEW"), verdict).otherwise("NEEDS_REVIEW")
