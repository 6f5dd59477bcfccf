"""Exact quantiles by refining histograms: no task holds a class's values, however many there are.

The order statistics that a quantile lies between are each known to be in an interval, at first from the least to the greatest value of their class. A pass
counts the values of each interval in cells, and each cell's own least and greatest value bound the next interval. A few passes leave a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.running import same
from cutloom.tables import written

CELLS = 4_096
#: Classes up to which their intervals are broadcast to the rows; beyond, rows meet them in a join.
MOST_CLASSES = 50_000


def refined(rows: DataFrame, targets: DataFrame, keys: list[str], value: str, cells: int, few: bool) -> DataFrame:
    """``targets`` (keys, share, side, rank, low, high, before) with the intervals of open ones narrowed to a cell's values."""
    given = targets.where("low < high").select(*(F.col(k).alias(f"_k_{k}") for k in keys), "low", "high").distinct()
    met = rows.join(F.broadcast(given) if few else given, same(rows, given, keys, "_k_")).where(F.col(value).between(F.col("low"), F.col("high")))
    cell = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))
    counted = met.groupBy(*keys, "low", "high", cell.alias("cell")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    up_to = Window.partitionBy(*keys, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.withColumn("ahead", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    ahead = ahead.select(*(F.col(c).alias(f"_k_{c}") for c in [*keys, "low", "high"]), "n", "least", "most", "ahead")
    place = F.col("rank") - F.col("before") - F.col("ahead")
    found = targets.join(ahead, same(targets, ahead, [*keys, "low", "high"], "_k_")).where((place >= 0) & (place < F.col("n")))
    kept = [*keys, "share", "side", "rank"]
    narrowed = found.select(*kept, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("ahead")).alias("before"))
    return narrowed.unionByName(targets.where("low = high").select(*kept, "low", "high", "before"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], cells: int = CELLS) -> DataFrame:
    """(keys, n, a column for each ``name=share``): quantiles of the numbers in ``value`` by class, between the two nearest values in proportion.

    Nulls and NaN are no values; a class without values has no row; null keys are a class; equal values count each. Each pass over the rows runs when the function is
    called; there are about as many as it takes powers of ``cells`` to tell the values apart.
    """
    own = keys or ["_all"]
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    held = held.select(*keys, *([] if keys else [F.lit(0).alias("_all")]), value)
    classes = written(held.groupBy(*own).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")), "quantile_classes")
    few = classes.count() <= MOST_CLASSES
    at = lambda share: F.lit(share) * (F.col("n") - 1)
    both = F.array(*(F.struct(F.lit(name).alias("share"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank")) for name, share in shares.items() for side, rank in (("low", F.floor(at(share))), ("high", F.ceil(at(share))))))
    targets = classes.select(*own, F.explode(both).alias("x"), "low", "high").select(*own, "x.*", "low", "high", F.lit(0).cast("bigint").alias("before"))
    targets = written(targets, "quantiles")
    while not targets.where("low < high").isEmpty():
        targets = written(refined(held, targets, own, value, cells, few), "quantiles")
    value_of = lambda name, side: F.max(F.when((F.col("share") == name) & (F.col("side") == side), F.col("low")))
    found = targets.groupBy(*own).agg(*(value_of(name, side).alias(f"_{side}_{name}") for name in shares for side in ("low", "high")))
    found = found.select(*(F.col(k).alias(f"_k_{k}") for k in own), *(F.col(f"_{side}_{name}") for name in shares for side in ("low", "high")))
    between = lambda name, share: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at(share) - F.floor(at(share)))
    return classes.join(found, same(classes, found, own, "_k_")).select(*keys, "n", *(between(name, share).alias(name) for name, share in shares.items()))
