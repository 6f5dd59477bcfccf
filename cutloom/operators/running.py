"""Running aggregates by key that no hot key holds up.

A plain window over a key sends all of its rows to one task. Here a key's rows are sliced along their order
(by time, say): a window runs within each slice, and one over the few slice totals of a key
carries what came before. Both give what one window over the key would.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task gets about where rows are dealt by key: tables that grow take more tasks, not larger ones.
ROWS_A_TASK = 250_000
KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def same(left: DataFrame, right: DataFrame, keys: list[str], renamed: str) -> Column:
    """Equality of ``keys``, nulls equal, with the right side's keys renamed by a prefix."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"{renamed}{k}"]) for k in keys))


def tasks_for(df: DataFrame) -> int:
    """Tasks over which the rows of ``df``, which are counted here, are dealt: the session's number of shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / ROWS_A_TASK))


def with_running(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, tasks: int | None = None, **what: tuple[str, str]) -> DataFrame:
    """``df`` with a column for each ``name=(kind, column)``: the aggregate over the rows before, without the row itself.

    kind: sum, max, min, or last (the last value that is not null). ``slice_by`` must not decrease along ``order``; ``order`` should
    name rows uniquely. Null where nothing came before. ``tasks``: over how many rows are dealt; without it they are counted.
    """
    tasks = tasks or tasks_for(df)
    # one struct names key and slice: in it nulls are equal, and rows are dealt once for window, totals and join
    cut = df.withColumn("_at", F.struct(*keys, slice_by.alias("_slice"))).repartition(tasks, "_at")
    before = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_at._slice").rowsBetween(Window.unboundedPreceding, -1)
    totals, carried, inner = [], [], cut
    for name, (kind, column) in what.items():
        if kind == "last":
            inner = inner.withColumn(f"_in_{name}", F.last(column, ignorenulls=True).over(before))
            totals.append(F.max(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v"))))["_v"].alias(name))
            carried.append(F.last(name, ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        else:
            inner = inner.withColumn(f"_in_{name}", KINDS[kind](column).over(before))
            totals.append(KINDS[kind](column).alias(name))
            carried.append(KINDS[kind](name).over(earlier).alias(f"_c_{name}"))
    by_slice = cut.groupBy("_at").agg(*totals).select("_at", *(F.col("_at")[k].alias(k) for k in keys), *what).repartition(tasks, *keys)
    joined = inner.join(by_slice.select("_at", *carried).repartition(tasks, "_at"), "_at", "left")
    for name, (kind, _) in what.items():
        own, old = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        value = {"sum": F.when(own.isNull() & old.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0))), "max": F.greatest(own, old), "min": F.least(own, old), "last": F.coalesce(own, old)}[kind]
        joined = joined.withColumn(name, value)
    return joined.select(*df.columns, *what)


def with_place(df: DataFrame, keys: list[str], order: list[str], slice_by: Column) -> DataFrame:
    """``df`` with ``place``: the row number in the whole of its key along ``order``, counted by slice as in ``with_running``."""
    counted = with_running(df.withColumn("_one", F.lit(1)), keys, order, slice_by, _before=("sum", "_one"))
    return counted.select(*df.columns, (F.coalesce("_before", F.lit(0)) + 1).alias("place"))
