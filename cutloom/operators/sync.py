"""Offset and drift of two clocks whose points nobody has matched.

Every pair of points within the largest offset votes for the difference of its times. Votes are counted by stretch of time in narrow cells, so only
counts and sums leave the join; true pairs agree and pile up in a cell, others spread. A robust line through the stretches' peaks, the median of
slopes across half the recording, gives the drift; what it leaves gives the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators import intervals
from cutloom.operators.running import same


def votes(a: DataFrame, b: DataFrame, keys: list[str], most_ms: int, stretch_ms: int, cell_ms: int, salts: int = 1) -> DataFrame:
    """(keys, stretch, cell, n, sum_d, sum_t): how many pairs of points (keys, t in ms) of ``a`` and ``b``, at most ``most_ms`` apart, differ by about ``cell`` cells, by stretch of
    ``a``'s time; the sums of their differences and of ``a``'s times."""
    near = a.select(*keys, F.col("t").alias("t_a"), (F.col("t") - most_ms).alias("start"), (F.col("t") + most_ms + 1).alias("end"))
    points = b.select(*keys, F.col("t").alias("start"), (F.col("t") + 1).alias("end"))
    pairs = intervals.overlap_join(near, points, 2 * most_ms + 1, keys, salts).withColumn("d", F.col("r_start") - F.col("t_a"))
    by = [*keys, F.floor(F.col("t_a") / stretch_ms).alias("stretch"), F.floor(F.col("d") / cell_ms).alias("cell")]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum("d").alias("sum_d"), F.sum("t_a").alias("sum_t"))


def clock_fit(a: DataFrame, b: DataFrame, keys: list[str], most_ms: int, stretch_ms: int, cell_ms: int, least_votes: int = 3, least_share: float = 0.5, salts: int = 1) -> DataFrame:
    """(keys, offset_ms, drift_ppm, share, decision) of the clock of ``b`` against that of ``a``: a point at t is expected at t + offset + (t - first t) · drift.

    A stretch's peak is the two neighbouring cells with most votes (the lower ones of equals) and counts from ``least_votes`` on. ``share`` is how many points of ``a`` vote in
    the peaks that lie within two cells of the line; under ``least_share``, or with fewer than two stretches, the decision is REFUSE and the numbers are not to be
    used. Points without a time are ignored; repeated points vote each; keys that one side lacks have no row.
    """
    cells = votes(a, b, keys, most_ms, stretch_ms, cell_ms, salts)
    pair = Window.partitionBy(*keys, "stretch").orderBy("cell").rangeBetween(0, 1)
    both = cells.select(*keys, "stretch", "cell", *(F.sum(c).over(pair).alias(c) for c in ("n", "sum_d", "sum_t")))
    top = both.groupBy(*keys, "stretch").agg(F.max_by(F.struct("n", "sum_d", "sum_t"), F.struct("n", -F.col("cell"))).alias("top")).select(*keys, "stretch", "top.*")
    first = a.groupBy(*keys).agg(F.min("t").alias("first"), F.count("t").alias("points"))
    first = first.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "first", "points")
    peaks = top.where(F.col("n") >= least_votes).join(first, same(top, first, keys, "_k_")).select(*keys, "stretch", "n", "points", (F.col("sum_d") / F.col("n")).alias("d"), (F.col("sum_t") / F.col("n") - F.col("first")).alias("t"))

    # one row a stretch from here on; slopes reach across half the recording
    along = Window.partitionBy(*keys).orderBy("stretch")
    placed = peaks.withColumns({"place": F.row_number().over(along), "half": F.floor(F.count("*").over(Window.partitionBy(*keys)) / 2)})
    far = placed.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.col("place") - F.col("half")).alias("_k_place"), F.col("d").alias("far_d"), F.col("t").alias("far_t"))
    slopes = placed.where("half > 0").join(far, same(placed, far, [*keys, "place"], "_k_"))
    drift = slopes.groupBy(*keys).agg(F.median((F.col("far_d") - F.col("d")) / (F.col("far_t") - F.col("t"))).alias("drift"))
    drift = drift.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "drift")
    levelled = peaks.join(drift, same(peaks, drift, keys, "_k_"), "left").select(*keys, "n", "points", "drift", (F.col("d") - F.col("drift") * F.col("t")).alias("rest"))
    middle = levelled.groupBy(*keys).agg(F.median("rest").alias("offset")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "offset")
    held = levelled.join(middle, same(levelled, middle, keys, "_k_"))
    agreeing = F.sum(F.when(F.abs(F.col("rest") - F.col("offset")) <= 2 * cell_ms, F.col("n")).otherwise(0))
    found = held.groupBy(*keys).agg(F.max("offset").alias("offset_ms"), (F.max("drift") * 1e6).alias("drift_ppm"), (agreeing / F.max("points")).alias("share"))
    return found.withColumn("decision", F.when(F.coalesce(F.col("share") >= least_share, F.lit(False)) & F.col("drift_ppm").isNotNull(), "CORRECT").otherwise("REFUSE"))
