"""What lies around points in time, by sweeps, against plain loops over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cutloom.operators import candidates, extremes, media


def made(seed):
    pick = random.Random(seed)
    points = [(i, pick.choice("aab"), pick.randint(-60, 400)) for i in range(150)] + [(900, "a", None), (901, None, 5), (902, "c", 5)]
    dense = [("a", pick.randint(100, 120), float(pick.randint(0, 9))) for _ in range(300)]
    rows = dense + [(pick.choice("ab"), pick.randint(-100, 450), float(pick.randint(-9, 9))) for _ in range(80)] + [("a", None, 1.0), (None, 6, 2.0)]
    return points, rows


@pytest.mark.parametrize("reach,width", [(1, 7), (13, 5), (40, 1000)])
def test_extremes_and_sums(spark, reach, width):
    points, rows = made(reach)
    a, b = spark.createDataFrame(points, "id long, k string, t long"), spark.createDataFrame(rows, "k string, t long, v double")
    best = b.select("k", "t", "v", F.struct("v", "t").alias("low"))
    least = {r["id"]: (r["low"], r["top"]) for r in extremes.around(a, best, ["k"], reach, width, low=("min", "low"), top=("max", "v")).collect()}
    sums = {r["id"]: r["v"] for r in extremes.sums_around(a, b, ["k"], reach, width, v="v").collect()}
    for i, k, t in points:
        if t is None:
            assert i not in least and i not in sums
            continue
        near = [(v, u) for own, u, v in rows if own == k and u is not None and abs(u - t) <= reach]
        assert (tuple(least[i][0]) if near else None, least[i][1]) == (min(near, default=None), max((v for v, _ in near), default=None))
        assert sums[i] == pytest.approx(sum(v for v, _ in near))


@pytest.mark.parametrize("levels", [2, 6, 20])
def test_dyadic_cells_cover_an_interval_once(spark, levels):
    spans = [(s, e) for s in range(-9, 20) for e in range(s - 1, 24)] + [(-1000, 3000)]
    for r in spark.createDataFrame(spans, "start long, end long").withColumn("c", extremes.cells(F.col("start"), F.col("end"), levels)).collect():
        held = [x for c in r["c"] for x in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"])]
        assert sorted(held) == list(range(r["start"], r["end"] + 1))


@pytest.mark.parametrize("seed,reach", [(1, 30), (2, 5), (3, 200)])
def test_quiet_spots(spark, seed, reach):
    pick = random.Random(seed)
    spans = [(s, s + pick.choice([0, 1, 3, 8, 40])) for s in (pick.randint(0, 900) for _ in range(60))]
    spans += spans[:3] + [(400, 400 + i) for i in range(30)]
    cuts = [(i, pick.randint(-50, 1000)) for i in range(200)]
    got = {r["id"]: (r["tone_start"], r["tone_end"]) for r in candidates.quiet_spot(spark.createDataFrame(cuts, "id long, t long"), spark.createDataFrame(spans, "start long, end long"), reach, 50).collect()}
    for i, t in cuts:
        near = [(max(s - t, t - e, 0), s - e, s, e) for s, e in spans if s < t + reach + 1 and t - reach < e]
        assert got.get(i) == (min(near)[2:] if near else None)


@pytest.mark.parametrize("width", [9, 5000])
def test_snapping_and_levels(spark, width):
    points, rows = made(4)
    own = [(i, t) for i, k, t in points if k == "a" and t is not None]
    frames = [(t, v) for k, t, v in rows if k == "a" and t is not None]
    a, b = spark.createDataFrame(own, "id long, t long"), spark.createDataFrame(frames, "t long, value double")
    moved = {r["id"]: r["snapped_t"] for r in candidates.snapped(a, b.withColumnRenamed("value", "energy"), 12, width).collect()}
    level = {r["id"]: r for r in media.edge_levels(a, b, 12, width).collect()}
    for i, t in own:
        near = [(v, u) for u, v in frames if abs(u - t) <= 12]
        assert moved[i] == (min(near)[1] if near else t)
        assert (i in level) == bool(near)
        if near:
            assert (level[i]["n"], level[i]["peak"]) == (len(near), max(abs(v) for v, _ in near)) and level[i]["mean_square"] == pytest.approx(sum(v * v for v, _ in near) / len(near))


def test_a_dense_hour_is_split(spark):
    """All rows of one block are dealt over slices, whose rows are few."""
    rows = spark.range(4000).select(F.lit("a").alias("k"), (F.col("id") % 1000).alias("t"))
    sizes = [r["count"] for r in rows.groupBy(F.floor(F.col("t") / 50)).count().collect()]
    assert max(sizes) <= 4000 / 8
    points = rows.where("t % 100 = 0").select("k", (F.monotonically_increasing_id()).alias("id"), "t")
    found = extremes.sums_around(points, rows.withColumn("one", F.lit(1)), ["k"], 1000, 50, n="one")
    assert {r["n"] for r in found.collect()} == {4000}
