"""Edit ratios, sliding frames on hot tracks and unmatched clocks against plain loops."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cutloom.functions.sequences import common_length, edit_ratio
from cutloom.operators import candidates, frames, sequence, sync


def common(a, b):
    """The length of the longest common subsequence by the usual table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(row[-1], above[j + 1], above[j] + (x == y)))
    return row[-1]


@pytest.mark.parametrize("most", [4, 59, 60, 61, 130])
def test_common_subsequences(spark, most):
    pick = random.Random(most)
    pairs = [(pick.choices("abcdef", k=pick.randint(0, most)), pick.choices("abcdeg", k=pick.randint(0, most + 9))) for _ in range(60)]
    pairs += [(["a"] * most, ["a"] * most), (list("ab") * (most // 2), list("ba") * (most // 2)), ([], []), ([None, "a"], [None, "b"])]
    df = spark.createDataFrame([(i, a, b, common(a, b)) for i, (a, b) in enumerate(pairs)], "id int, a array<string>, b array<string>, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", common_length(F.col("a"), F.col("b"), most)).collect())


def test_edit_ratio(spark):
    rows = [(list("怎么保证"), list("怎么确保"), 0.75), (["a"], ["a"], 1.0), ([], [], 1.0), (["a"], ["b"], 0.0), (None, ["a"], None), (list("abcd"), list("bcde"), 0.75)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", edit_ratio(F.col("a"), F.col("b"), 4)).collect())


@pytest.mark.parametrize("k,least,gap,width", [(4, 0.75, None, 50), (6, 0.5, 200, 7), (70, 0.55, 100, 400)])
def test_restarts_with_pauses(spark, k, least, gap, width):
    pick = random.Random(k)
    words, t = [], 0
    for pos, word in enumerate(pick.choices("abcdef", k=400), 1):
        t += pick.choice([20, 120, 250])
        words.append((1, pos, word, t, t + 50))
        t += 50
    found = candidates.restarts(spark.createDataFrame(words, "d int, pos int, word string, start long, end long"), ["d"], k, least, gap, width).collect()
    w, want = [x[2] for x in words], {}
    for i in range(k, len(w) - k + 1):
        pause = words[i][3] - words[i - 1][4]
        if common(w[i - k : i], w[i : i + k]) / k >= least and (gap is None or pause >= gap):
            want[i + 1] = (common(w[i - k : i], w[i : i + k]) / k, pause)
    assert want and {r["pos"]: (r["ratio"], pause) for r in found for pause in [r["gap"] if gap is not None else want[r["pos"]][1]]} == want


def made_frames():
    pick = random.Random(8)
    rows = [("hot", t, pick.choice([1.0, 2.0, 3.0, 9.0])) for t in pick.sample(range(-500, 4000), 2000)] + [("cold", 5, 1.0), ("cold", 7, 9.0), (None, 3, 4.0)]
    return rows + rows[:20] + [("hot", None, 5.0)]


@pytest.mark.parametrize("width", [10, 64, 100_000])
def test_rolling_median_is_one_window_over_the_track(spark, width):
    rows = made_frames()
    df = spark.createDataFrame(rows, "track string, t long, level double")
    found = frames.sliding(df, ["track"], "t", width, median=(F.percentile("level", F.lit(0.5)), -6, 6), before=(F.count("*"), -9, -1)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["t"] is not None:
            own = [x[2] for x in rows if x[0] == r["track"] and x[1] is not None and abs(x[1] - r["t"]) <= 6]
            assert r["median"] == statistics.median(own)
            assert r["before"] == sum(x[0] == r["track"] and x[1] is not None and -9 <= x[1] - r["t"] <= -1 for x in rows)
    high = frames.peaks(df, ["track"], "t", "level", 6, 2.0, width).where("t IS NOT NULL").collect()
    assert len(high) == sum(r["level"] >= 2 * r["median"] for r in found if r["t"] is not None)


def test_a_track_of_all_rows_is_split(spark):
    n = 8000
    df = spark.range(n).select(F.lit("hot").alias("track"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("level"))
    lent = frames.with_halo(df, ["track"], "t", 500, 6, 6)
    sizes = [r["count"] for r in lent.groupBy("track", "_slice").count().collect()]
    assert max(sizes) <= n / 8 and sum(sizes) <= 1.05 * n and lent.where("_own").count() == n


def test_frames_counted_in_rows(spark):
    words = spark.createDataFrame([(d, p, f"w{p % 5}") for d in (1, 2, None) for p in range(1, 60)], "d int, pos int, word string")
    for width in (3, 8, 1000):
        for r in sequence.around(words, ["d"], 4, width).collect():
            assert r["pre"] == [f"w{p % 5}" for p in range(max(1, r["pos"] - 4), r["pos"])] and r["post"] == [f"w{p % 5}" for p in range(r["pos"], min(60, r["pos"] + 4))]
        near = sequence.with_near_any(words, ["d"], "near", F.col("word") == "w0", 2, width).collect()
        assert all(r["near"] == any(p % 5 == 0 and 1 <= p < 60 for p in range(r["pos"] - 2, r["pos"] + 3) if p != r["pos"]) for r in near)


def clocks(pick, n, offset, ppm, missing, spurious):
    """Two clocks' points: each misses some of what happens and hears some that does not."""
    times, t = [], 1_000_000
    for _ in range(n):
        t += pick.randint(200, 4000)
        times.append(t)
    a = [x for x in times if pick.random() >= missing]
    b = [round(x + offset + (x - times[0]) * ppm / 1e6) for x in times if pick.random() >= missing]
    extra = lambda: [pick.randint(times[0], times[-1]) for _ in range(int(n * spurious))]
    return a + extra(), b + extra()


def test_offset_and_drift_by_votes(spark):
    pick, a, b = random.Random(5), [], []
    for key, offset, ppm in (("x", 120, 35), ("y", -900, -80), ("z", 0, 0)):
        left, right = clocks(pick, 1500, offset, ppm, 0.25, 0.25)
        a += [(key, t) for t in left]
        b += [(key, t) for t in right]
    noise = [pick.randint(0, 3_000_000) for _ in range(1500)], [pick.randint(0, 3_000_000) for _ in range(1500)]
    a += [("noise", t) for t in noise[0]] + [("x", None), ("alone", 5), (None, 7)]
    b += [("noise", t) for t in noise[1]] + [("x", None), ("few", 6)]
    kind = "pair string, t long"
    for salts in (1, 3):
        found = {r["pair"]: r for r in sync.clock_fit(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["pair"], 2_000, 300_000, 20, salts=salts).collect()}
        for key, offset, ppm in (("x", 120, 35), ("y", -900, -80), ("z", 0, 0)):
            assert abs(found[key]["offset_ms"] - offset) < 5 and abs(found[key]["drift_ppm"] - ppm) < 3 and found[key]["decision"] == "CORRECT"
        assert found["noise"]["decision"] == "REFUSE" and "alone" not in found and "few" not in found
