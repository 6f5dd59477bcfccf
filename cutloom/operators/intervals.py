"""Joins and sweeps over half-open intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.running import tasks_for, with_running


def binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """``df`` once for each bin of ``width`` that its interval touches (an empty interval touches one)."""
    first = F.floor(start / F.lit(width))
    last = F.greatest(first, F.ceil(end / F.lit(width)) - 1)
    return df.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, width: int, on: list[str] | None = None, salts: int = 1) -> DataFrame:
    """Pairs whose intervals overlap: an equi-join on bins, where each pair is kept in the bin of its later start only.

    Both sides have integer start and end; all other column names must differ, but for those in ``on``, which must be equal.
    ``width`` is best near a usual length. ``salts`` deals a crowded bin of the left side over so many tasks.
    """
    a = binned(left.withColumnsRenamed({"start": "l_start", "end": "l_end"}), F.col("l_start"), F.col("l_end"), width)
    b = binned(right.withColumnsRenamed({"start": "r_start", "end": "r_end"}), F.col("r_start"), F.col("r_end"), width)
    keys = [*(on or []), "_bin"]
    if salts > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*left.columns[:1], "l_start", "l_end"), F.lit(salts)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        keys = [*keys, "_salt"]
    later = F.floor(F.greatest("l_start", "r_start") / F.lit(width))
    pairs = a.join(b, keys).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_bin") == later))
    return pairs.drop("_bin", "_salt")


def containing(cuts: DataFrame, spans: DataFrame, width: int, on: list[str] | None = None, salts: int = 1) -> DataFrame:
    """Pairs of a cut and a span that covers all of it."""
    return overlap_join(cuts, spans, width, on, salts).where("r_start <= l_start AND r_end >= l_end")


def merged(df: DataFrame, keys: list[str], slice_width: int, tasks: int | None = None) -> DataFrame:
    """Overlapping and touching intervals of a key as one: keys, start, end, n_parts. Empty intervals are left out.

    A slice is merged by itself in one sorted pass. Of the slices before, only how far they reach and which island reaches there matter: what
    begins within that reach belongs to that island, and all else stands as it is. ``tasks``: over how many rows are dealt; without it they are counted.
    """
    tasks = tasks or tasks_for(df)
    # one struct names key and slice: in it nulls are equal, and rows are dealt once for windows, parts and join
    at = F.struct(*keys, F.floor(F.col("start") / slice_width).alias("_slice"))
    rows = df.where("start < end").select(at.alias("_at"), "start", "end").repartition(tasks, "_at")
    along = Window.partitionBy("_at").orderBy("start", "end")
    opened = rows.withColumn("_reach", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start")))
    opened = opened.withColumn("_island", F.max("_opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = opened.groupBy("_at", "_island").agg(F.max("end").alias("end"), F.count("*").alias("n_parts"))

    earlier = Window.partitionBy(*keys).orderBy("_at._slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = parts.groupBy("_at").agg(F.max("_island").alias("_last"), F.max("end").alias("_far")).withColumns({k: F.col("_at")[k] for k in keys}).repartition(tasks, *keys)
    slices = slices.withColumn("_reach", F.max("_far").over(earlier))
    slices = slices.withColumn("_since", F.max(F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))).over(earlier))

    joined = parts.join(slices.select("_at", "_reach", "_since").repartition(tasks, "_at"), "_at")
    island = F.when(F.col("_island") <= F.col("_reach"), F.col("_since")).otherwise(F.col("_island"))
    found = joined.select(*(F.col("_at")[k].alias(k) for k in keys), island.alias("start"), "end", "n_parts").repartition(tasks, *keys, "start")
    return found.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.sum("n_parts").alias("n_parts"))


def covered(df: DataFrame, keys: list[str], slice_width: int) -> DataFrame:
    """(keys, start, end): as few intervals as overlap what those of ``df`` overlap. Merged ones, and each empty interval once."""
    empty = df.where("start = end").select(*keys, "start", "end").distinct()
    return merged(df, keys, slice_width).select(*keys, "start", "end").unionByName(empty)


def removed_before(cuts: DataFrame, keys: list[str], slice_width: int) -> DataFrame:
    """Merged ``cuts`` with ``removed``: the length that the cuts before each take out."""
    tasks = tasks_for(cuts)
    spans = merged(cuts, keys, slice_width, tasks).withColumn("length", F.col("end") - F.col("start"))
    swept = with_running(spans, keys, ["start"], F.floor(F.col("start") / slice_width), tasks, removed=("sum", "length"))
    return swept.withColumn("removed", F.coalesce("removed", F.lit(0)))


def remapped(points: DataFrame, cuts: DataFrame, keys: list[str], slice_width: int) -> DataFrame:
    """``points`` (keys, t, …) with ``new_t``, their time once ``cuts`` are taken out; null inside a cut.

    One sweep over both: a cut takes out what lies beyond the reach of those before it, and a point loses the sum of that.
    """
    a = points.withColumns({"_side": F.lit(1), "_end": F.lit(None).cast(dict(cuts.dtypes)["end"]), "_row": F.struct(*points.columns)}).select(*keys, "t", "_side", "_end", "_row")
    b = cuts.where("start < end").select(*keys, F.col("start").alias("t"), F.lit(0).alias("_side"), F.col("end").alias("_end"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    at, order = F.floor(F.col("t") / slice_width), ["t", "_side", "_end"]
    tasks = tasks_for(a.unionByName(b))
    swept = with_running(a.unionByName(b), keys, order, at, tasks, _reach=("max", "_end"))
    takes = F.greatest(F.col("_end") - F.greatest("t", "_reach"), F.lit(0))
    swept = with_running(swept.withColumn("_takes", takes), keys, order, at, tasks, _removed=("sum", "_takes"))
    new_t = F.when(F.col("t") < F.col("_reach"), None).otherwise(F.col("t") - F.coalesce("_removed", F.lit(0)))
    return swept.where(F.col("_row").isNotNull()).select("_row.*", new_t.alias("new_t"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], slice_width: int, value: str, strict: bool = False) -> DataFrame:
    """``left`` with ``value`` of the latest ``right`` row of its keys with t at or before its own (before, if ``strict``).

    Both have integer t; among right rows of one t the largest value wins. One sorted pass over both sides; no pairs are made.
    """
    kind = dict(right.dtypes)[value]
    a = left.withColumns({"_side": F.lit(0 if strict else 1), value: F.lit(None).cast(kind), "_row": F.struct(*left.columns)})
    b = right.select(*keys, "t", F.col(value)).withColumns({"_side": F.lit(1 if strict else 0), "_row": F.lit(None).cast(a.schema["_row"].dataType)})
    both = a.select(*keys, "t", "_side", value, "_row").unionByName(b.select(*keys, "t", "_side", value, "_row"))
    both = both.withColumn("_tie", F.to_json(F.struct(F.col(value).alias("v"))))
    swept = with_running(both.withColumnRenamed(value, "_value"), keys, ["t", "_side", "_tie"], F.floor(F.col("t") / slice_width), _last=("last", "_value"))
    return swept.where(F.col("_row").isNotNull()).select("_row.*", F.col("_last").alias(value))
