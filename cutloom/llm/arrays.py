"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and deep inside lambdas it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def indices(n: Column) -> Column:
    """0 to n - 1; no element where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def at(array: Column, i: Column) -> Column:
    """The element with zero-based index ``i``; null outside."""
    return F.get(array, i)


def run_starts(sorted_pairs: Column, n: Column) -> Column:
    """Indices at which a new ``h`` begins in an array of structs (h, i) sorted by h."""
    return F.filter(indices(n), lambda q: (q == 0) | (at(sorted_pairs, q)["h"] != at(sorted_pairs, q - 1)["h"]))
