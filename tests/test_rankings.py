"""Ranks that run over a whole tier or nation."""

from collections import defaultdict
from functools import reduce

import pytest

from cutloom.plans import registry


@pytest.mark.parametrize(("name", "key", "place"), [("q44_priority_pages", "tier", "place"), ("q58_preference_order", "c_nationkey", "shown_at")])
def test_places_count_through_the_whole_key(spark, name, key, place):
    found = defaultdict(list)
    for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect():
        found[r[key]].append(r[place])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in found.values())


def test_likings_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Two customers with the same prices in different orders are liked alike, so the smaller id comes first; a price without a decimal of ten places counts too."""
    prices = [17525.49, 325997.98, 260481.71, 125528.7, 119398.56, 141111.19, 130182.95, 299430.66]
    orders = [(c, x) for c, xs in ((2, prices), (9, prices[::-1]), (5, sorted(prices)), (1, [1e300]), (3, [500.0]), (4, [float("inf")])) for x in xs]
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, 7) for c in (9, 2, 5, 1, 3, 4, 8)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert reduce(float.__add__, prices) < reduce(float.__add__, prices[::-1])
    found = registry.QUERIES["q58_preference_order"](spark, str(tmp_path)).collect()
    assert [r["c_custkey"] for r in sorted(found, key=lambda r: r["shown_at"])] == [4, 1, 2, 5, 9, 3, 8]
