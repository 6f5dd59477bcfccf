"""The table side of media steps: frames, levels and offsets. Signal processing itself stays outside; facts of files are read by ``sources.wav``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.operators import extremes, intervals
from cutloom.operators.quantiles import exact_quantiles
from cutloom.operators.running import same


def drift_fixture(spark: SparkSession, n: int, offset_ms: float, drift_ppm: float, step_ms: int = 1000) -> DataFrame:
    """(t_a, t_b): times of one clock, and of another with a known offset and drift."""
    t = F.col("id") * step_ms
    return spark.range(n).select(t.cast("double").alias("t_a"), (t * (1 + drift_ppm / 1e6) + offset_ms).alias("t_b"))


def offset_and_drift(pairs: DataFrame, least_fit: float = 0.99) -> DataFrame:
    """One row: offset_ms, drift_ppm, fit, decision (REFUSE where the fit is poor) of matched times (t_a, t_b)."""
    fit = F.regr_r2("t_b", "t_a")
    return pairs.agg(F.regr_intercept("t_b", "t_a").alias("offset_ms"), ((F.regr_slope("t_b", "t_a") - 1) * 1e6).alias("drift_ppm"), fit.alias("fit"), F.when(fit >= least_fit, "CORRECT").otherwise("REFUSE").alias("decision"))


def timeline_offset(one: DataFrame, other: DataFrame, segment: str) -> DataFrame:
    """One row: the median of the time differences of the segments (``segment``, t) that both timelines have, and their number."""
    pairs = one.select(segment, F.col("t").alias("_a")).join(other.select(segment, F.col("t").alias("_b")), segment)
    return exact_quantiles(pairs.select((F.col("_a") - F.col("_b")).alias("d")), [], "d", {"offset": 0.5}).select("offset", "n")


def with_context(spans: DataFrame, before: int, after: int) -> DataFrame:
    """``spans`` with context_start and context_end around them, from 0 on."""
    return spans.withColumns({"context_start": F.greatest(F.col("start") - before, F.lit(0)), "context_end": F.col("end") + after})


def preview_segments(spans: DataFrame, sample: DataFrame, before: int, after: int) -> DataFrame:
    """``spans`` (id, start, end, …) that the ``sample`` (id) names, with context_start and context_end around them, from 0 on. An id that comes twice in the sample counts once."""
    return with_context(spans.join(sample.select("id"), "id", "left_semi"), before, after)


def frames(spans: DataFrame, step: int) -> DataFrame:
    """The frames (id, frame, covered) of a grid of ``step`` that each span touches, with how much of a frame it covers."""
    touched = intervals.binned(spans.where("start < end"), F.col("start"), F.col("end"), step)
    covered = F.least("end", (F.col("_bin") + 1) * step) - F.greatest("start", F.col("_bin") * step)
    return touched.select("id", F.col("_bin").alias("frame"), covered.alias("covered"))


def dominant(levels: DataFrame, window: str, track: str, level: str) -> DataFrame:
    """The loudest track of each window, the first by name of equals: window, track, level. A null level is the least."""
    best = F.min_by(F.struct(track, level), F.struct(F.col(level).isNull(), -F.col(level), F.col(track)))
    return levels.groupBy(window).agg(best.alias("x")).select(window, f"x.{track}", f"x.{level}")


def edge_levels(cuts: DataFrame, points: DataFrame, reach: int, slice_width: int) -> DataFrame:
    """For each cut (id, t): n, peak and mean square of the points (t, value) within ``reach`` of it; cuts without points are left out, and a null value is silence."""
    level = F.coalesce(F.abs("value"), F.lit(0.0))
    rows = points.select("t", level.alias("peak"), (level * level).alias("square"), F.lit(1).cast("bigint").alias("one"))
    sums = extremes.sums_around(cuts, rows, [], reach, slice_width, n="one", squares="square")
    highest = extremes.around(cuts, rows, [], reach, slice_width, peak=("max", "peak"))
    return sums.where("n > 0").join(highest, "id").select("id", "n", "peak", (F.col("squares") / F.col("n")).alias("mean_square"))


def unknown_values(rows: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """(key, value) of rows whose ``column`` is null or not among ``allowed``: quarantined, not failed."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(key, F.col(column).alias("value"))


def examples(cases: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """Up to ``most`` cases of each class, with ``of``, the class's size. The rank limit is applied before the shuffle as well as after."""
    own = Window.partitionBy(*by)
    sizes = cases.groupBy(*(F.col(c).alias(f"_k_{c}") for c in by)).agg(F.count("*").alias("of"))
    first = cases.withColumn("place", F.row_number().over(own.orderBy(*order))).where(F.col("place") <= most)
    return first.join(sizes, same(first, sizes, by, "_k_")).select(*cases.columns, "place", "of")
