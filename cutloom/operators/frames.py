"""Sliding frames that no hot key holds up.

A window over a key is one task. Here a key's rows are sliced along a number, and a slice borrows the rows within reach on both sides of it (its
halo), so a frame of a bounded reach sees all it needs within one slice. Borrowed rows are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(rows: DataFrame, keys: list[str], along: str, width: int, back: int, ahead: int) -> DataFrame:
    """``rows`` with ``_slice`` and ``_own``: each row in the slice it lies in (``_own``), and lent to those whose rows lie up to ``ahead`` before or ``back`` after it.

    A row that is nowhere along (null) is in a slice of its key's own.
    """
    at = F.col(along)
    cut = lambda x: F.floor(x / width)
    lent = rows.withColumn("_slice", F.explode_outer(F.sequence(cut(at - ahead), cut(at + back))))
    return lent.withColumn("_own", F.col("_slice").eqNullSafe(cut(at)))


def sliding(rows: DataFrame, keys: list[str], along: str, width: int, by_rows: bool = False, order: tuple[str, ...] = (), **what: tuple[Column, int, int]) -> DataFrame:
    """``rows`` with a column for each ``name=(aggregate, low, high)`` over the rows of its keys whose ``along`` lies from ``low`` to ``high`` away (-5, 5: five before to five after).

    With ``by_rows`` they are counted in rows instead, in the order of ``along`` and ``order``; ``along`` must then not skip numbers. ``width``
    is that of a slice, best many times the reach.
    """
    back, ahead = max(0, *(-low for _, low, _ in what.values())), max(0, *(high for _, _, high in what.values()))
    own = Window.partitionBy(*keys, "_slice").orderBy(along, *order)
    frame = lambda low, high: own.rowsBetween(low, high) if by_rows else own.rangeBetween(low, high)
    framed = with_halo(rows, keys, along, width, back, ahead).withColumns({name: made.over(frame(low, high)) for name, (made, low, high) in what.items()})
    return framed.where("_own").select(*rows.columns, *what)


def peaks(frames: DataFrame, keys: list[str], along: str, level: str, reach: int, times: float, width: int) -> DataFrame:
    """``frames`` whose ``level`` is at least ``times`` the median of those within ``reach`` of it, with ``median``: what stands out of its surroundings, however loud they are."""
    found = sliding(frames, keys, along, width, median=(F.percentile(level, F.lit(0.5)), -reach, reach))
    return found.where(F.col(level) >= times * F.col("median"))
