"""Parameters by scope: a class's own value, else its profile's, else the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cross-fade in ms, gap bounds in ms, level bands in dB, probability, silence, edges in ms.
DEFAULTS = {
    "crossfade_ms": 50, "gap_before_lo": 120, "gap_before_hi": 300, "gap_before_reject": 50, "gap_after_lo": 120, "gap_after_hi": 450,
    "rms_soft_db": 15, "rms_hard_db": 25, "least_probability": 0.6, "silence_db": -40, "silence_ms": 100, "silence_context_s": 1.5,
    "filler_edge_ms": 180, "chain_edge_ms": 40, "onset_pad_ms": 30, "neighbour_pad_ms": 20, "pause_per_cut_ms": 60, "pause_separator_ms": 200,
    "pause_lo_ms": 80, "pause_hi_ms": 500, "longest_cut_ms": 800, "edge_s": 6, "long_pause_ms": 2000, "sentence_gap_ms": 600, "crossfade_guard_samples": 128,
    "lufs_target": -22.2, "lufs_tolerance": 1.0, "true_peak_most": -1.0, "lra_target": 7.9,
}


#: Cross-fade and room tone in ms by strategy: fixed values.
SPLICES = {"BUTT_SPLICE": (0, 10), "CROSSFADE_50MS": (50, 0), "CROSSFADE_100MS_HUMAN_REVIEW": (100, 0)}
#: Target gaps in ms before and after a cut by its class: fixed values.
HEAD_PADS = {"filler_hesitation": (210, 110), "pause": (100, 120), "boundary_review": (180, 300)}


def looked_up(rows: DataFrame, params: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` (class, profile, …) with the value of ``key``: by class, else by profile, else the default row.

    ``params`` (scope, key, class, value) has at most one row a scope, key and class.
    """
    own = params.where(F.col("key") == key)
    by = lambda scope, name: own.where(F.col("scope") == scope).select(F.col("class").alias(name), F.col("value").alias(f"_{scope}"))
    found = rows.join(by("class", "class"), "class", "left").join(by("profile", "profile"), "profile", "left")
    default = own.where("scope = 'default'").agg(F.max("value").alias("_default"))
    return found.crossJoin(F.broadcast(default)).withColumn(out, F.coalesce("_class", "_profile", "_default")).drop("_class", "_profile", "_default")


def crossfade_samples(target_ms: Column, cut_samples: Column, rate: int = 48_000, guard: int = 128) -> Column:
    """A cross-fade in samples that leaves ``guard`` samples of its cut, and never less than none."""
    return F.greatest(F.lit(0), F.least(F.round(target_ms * rate / 1000), cut_samples - guard)).cast("bigint")


def band(difference: Column, soft: float = 15, hard: float = 25) -> Column:
    """A level difference in dB: ok up to ``soft``, hard above ``hard``, soft between."""
    return F.when(difference > hard, "hard").when(difference > soft, "soft").otherwise("ok")
