"""Extremes and sums of what lies around points in time, without pairs of points and rows.

A window of a fixed length meets two blocks of that length at most: the end of one and the beginning of the next. So its least value is the lesser of a running one
taken backwards through the first block and one taken forwards through the second. Sums are differences of running sums. Running values are
carried from slice to slice, so a crowded block is split.

What covers a point is found through dyadic cells: an interval is made up of few cells whose lengths are powers of two, a point lies in one of each
length, and of each cell only the best interval is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.operators.running import with_running

#: Lengths of dyadic cells: 1, 2, 4, … up to this power of two; longer intervals take several of the longest.
LEVELS = 32
FIRST = {"min": F.min, "max": F.max}


def swept(points: DataFrame, rows: DataFrame, keys: list[str], at: Column, side: int, block: Column, order: Column, slice_width: int, **what: tuple[str, str]) -> DataFrame:
    """(id, what…): running aggregates of ``rows`` at the place ``at`` of each point, within ``block``, along ``order``; a point comes after rows of its place (``side`` 1) or before (-1)."""
    kinds = dict(rows.dtypes)
    columns = [c for _, c in what.values()]
    a = rows.withColumns({"_at": F.col("t"), "_side": F.lit(0), "_id": F.lit(None).cast(dict(points.dtypes)["id"])}).select(*keys, "_at", "_side", "_id", *columns)
    b = points.withColumns({"_at": at, "_side": F.lit(side), "_id": F.col("id"), **{c: F.lit(None).cast(kinds[c]) for c in columns}}).select(*keys, "_at", "_side", "_id", *columns)
    both = a.unionByName(b).where("_at IS NOT NULL").withColumns({"_block": block, "_order": order})
    found = with_running(both, [*keys, "_block"], ["_order", "_side"], F.floor(F.col("_order") / slice_width), **{f"_r_{n}": w for n, w in what.items()})
    return found.where("_side <> 0").select(F.col("_id").alias("id"), *(F.col(f"_r_{n}").alias(n) for n in what))


def around(points: DataFrame, rows: DataFrame, keys: list[str], reach: int, slice_width: int, **what: tuple[str, str]) -> DataFrame:
    """(id, what…) of ``points`` (keys, id, t): for each ``name=(min or max, column)`` the extreme over the ``rows`` (keys, t, …) at most ``reach`` away.

    Times are integers and ids unique. Null where no row is near; points and rows without a time take no part.
    """
    length = 2 * reach + 1
    block, at = F.floor(F.col("_at") / length), F.col("t")
    head = swept(points, rows, keys, at + reach, 1, block, F.col("_at"), slice_width, **what)
    tail = swept(points, rows, keys, at - reach, 1, block, -F.col("_at"), slice_width, **what)
    return head.unionByName(tail).groupBy("id").agg(*(FIRST[kind](name).alias(name) for name, (kind, _) in what.items()))


def sums_around(points: DataFrame, rows: DataFrame, keys: list[str], reach: int, slice_width: int, **what: str) -> DataFrame:
    """(id, what…) of ``points`` (keys, id, t): for each ``name=column`` the sum over the ``rows`` (keys, t, …) at most ``reach`` away; 0 where none is."""
    sums = {n: ("sum", c) for n, c in what.items()}
    whole, at = F.lit(0), F.col("t")
    upto = swept(points, rows, keys, at + reach, 1, whole, F.col("_at"), slice_width, **sums)
    before = swept(points, rows, keys, at - reach, -1, whole, F.col("_at"), slice_width, **sums)
    zero = lambda df, sign: df.select("id", *((sign * F.coalesce(n, F.lit(0))).alias(n) for n in what))
    return zero(upto, 1).unionByName(zero(before, -1)).groupBy("id").agg(*(F.sum(n).alias(n) for n in what))


def cells(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The dyadic cells (level, cell) that make up the closed integer interval from ``start`` to ``end``."""
    found, nothing = [], F.array().cast("array<struct<level: int, cell: bigint>>")
    cell = lambda level, n: F.struct(F.lit(level).alias("level"), n.alias("cell"))
    for level in range(levels + 1):
        low, high = F.ceil(start / (1 << level)), F.floor((end + 1) / (1 << level))
        if level < levels:
            found += [F.when((low < high) & (low % 2 != 0), F.array(cell(level, low))), F.when((low < high) & (high % 2 != 0), F.array(cell(level, high - 1)))]
        else:
            found.append(F.when(low < high, F.transform(F.sequence(low, high - 1), lambda n: cell(levels, n))))
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(f, nothing) for f in found))))


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], best: Column, levels: int = LEVELS) -> DataFrame:
    """(id, best) of ``points`` (keys, id, t): the least ``best`` of the ``spans`` (keys, start, end, …) that hold t, both ends included. Points in no span are left out."""
    dealt = spans.select(*keys, F.explode(cells(F.col("start"), F.col("end"), levels)).alias("_c"), best.alias("best"))
    table = dealt.groupBy(*keys, "_c").agg(F.min("best").alias("best"))
    own = F.array(*(F.struct(F.lit(level).alias("level"), F.floor(F.col("t") / (1 << level)).alias("cell")) for level in range(levels + 1)))
    return points.select(*keys, "id", F.explode(own).alias("_c")).join(table, [*keys, "_c"]).groupBy("id").agg(F.min("best").alias("best"))
