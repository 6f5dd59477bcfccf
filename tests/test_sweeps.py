"""Sweeps over intervals against plain loops, on random rows with long reaches, ties, empty intervals and one key that holds most rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import AnalysisException

from cutloom.operators import candidates, intervals, registry_checks, running, sequence
from cutloom.sources import logs


def rows(seed: int) -> list[tuple[int | None, int, int]]:
    draw = random.Random(seed)
    found = []
    for _ in range(120):
        start = draw.randrange(-40, 300)
        found.append((draw.choice([1, 1, 1, 2, None]), start, start + draw.choice([-3, 0, 1, 2, 3, 3, 5, 40])))
    return found + found[:5]


def islands(spans: list[tuple[int, int]]) -> list[list[int]]:
    made: list[list[int]] = []
    for start, end in sorted(s for s in spans if s[0] < s[1]):
        if made and start <= made[-1][1]:
            made[-1][1] = max(made[-1][1], end)
            made[-1][2] += 1
        else:
            made.append([start, end, 1])
    return made


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("width", [4, 25, 1000])
def test_merged_and_remapped(spark, seed, width):
    spans = rows(seed)
    df = spark.createDataFrame(spans, "k int, start bigint, end bigint")
    wanted = {k: islands([s[1:] for s in spans if s[0] == k]) for k in {s[0] for s in spans}}
    got = sorted(((r["k"] or 0, r["start"], r["end"], r["n_parts"]) for r in intervals.merged(df, ["k"], width).collect()))
    assert got == sorted((k or 0, *i) for k, found in wanted.items() for i in found)

    points = [(k, t) for k in (1, 2, None, 3) for t in range(-50, 350, 3)] + [(1, 7), (1, 7), (1, None)]
    moved = intervals.remapped(spark.createDataFrame(points, "k int, t bigint"), df, ["k"], width).collect()
    assert len(moved) == len(points)
    for r in moved:
        if r["t"] is None:
            assert r["new_t"] is None
            continue
        own = wanted.get(r["k"], [])
        inside = any(s <= r["t"] < e for s, e, _ in own)
        assert r["new_t"] == (None if inside else r["t"] - sum(e - s for s, e, _ in own if e <= r["t"])), r


@pytest.mark.parametrize("reach,width", [(5, 100), (5, 5), (7, 3), (1, 1)])
def test_answered(spark, reach, width):
    draw = random.Random(reach * 100 + width)
    words = [(i, draw.choice("aaab"), draw.randrange(-30, 200)) for i in range(80)] + [(80, "a", None), (81, None, 5)]
    others = [(draw.choice("aaaaabc"), draw.randrange(-30, 200)) for _ in range(60)] + [(None, 3), ("b", None)] + [("a", 50)] * 40
    got = candidates.answered(spark.createDataFrame(words, "id int, track string, t bigint"), spark.createDataFrame(others, "track string, t bigint"), "track", reach, width)
    wanted = [i for i, k, t in words if None not in (k, t) and any(None not in (o, u) and o != k and abs(u - t) <= reach for o, u in others)]
    assert sorted(r["id"] for r in got.collect()) == wanted


@pytest.mark.parametrize("width", [4, 60, 1000])
def test_with_neighbours(spark, width):
    spans = [(k, s, e, i) for i, (k, s, e) in enumerate(rows(9))] + [(1, None, 4, 900), (1, 20, None, 901)]
    got = sequence.with_neighbours(spark.createDataFrame(spans, "k int, start bigint, end bigint, id int"), ["k"], width).collect()
    assert len(got) == len(spans)
    found = {r["id"]: (r["prev_end"], r["next_start"]) for r in got}
    for key in {s[0] for s in spans}:
        own = sorted((s for s in spans if s[0] == key), key=lambda s: (s[1] is not None, s[1] or 0, s[3]))
        for at, (_, start, _, number) in enumerate(own):
            ends = [s[2] for s in own[:at] if s[2] is not None]
            after = own[at + 1][1] if at + 1 < len(own) and start is not None else None
            assert found[number] == (ends[-1] if ends else None, after)


def test_sentences_and_restarts(spark):
    said = "we go home. we go home now. why ? yes".split(" ")
    words = spark.createDataFrame([("a", i + 1, w) for i, w in enumerate(said)] + [(None, 1, "alone")], "k string, pos int, word string")
    for width in (1, 3, 100):
        found = sequence.gathered_sentences(words, ["k"], width)
        rows = {(r["k"], r["sentence"]): (r["first_pos"], r["last_pos"], r["text"]) for r in found.collect()}
        assert rows == {("a", 0): (1, 3, "we go home."), ("a", 1): (4, 7, "we go home now."), ("a", 2): (8, 9, "why ?"), ("a", 3): (10, 10, "yes"), (None, 0): (1, 1, "alone")}
    # we, go of we, go, home., home, now.
    assert [(r["k"], r["sentence"], r["overlap"]) for r in sequence.sentence_restarts(found, ["k"], 0.4).collect()] == [("a", 1, 0.4)]
    assert sequence.sentence_restarts(found, ["k"]).count() == 0


def test_checks_in_order(spark):
    some, none = spark.range(3), spark.range(0)
    said = registry_checks.in_order({"a": (none, "FAIL"), "b": (some, "WARN"), "c": (some, "FAIL"), "d": (none, "FAIL")}).orderBy("place").collect()
    assert [(r["place"], r["layer"], r["n_bad"], r["verdict"]) for r in said] == [(1, "a", 0, "PASS"), (2, "b", 3, "WARN"), (3, "c", 3, "FAIL")]
    assert registry_checks.in_order({"a": (none, "FAIL"), "b": (some, "WARN")}).count() == 2


def test_word_transcripts_and_versions(spark, tmp_path):
    words = [{"word": "so", "start": 0.1, "end": 0.35, "probability": 0.9}, {"word": "", "start": 1, "end": 2}, {"word": "x", "start": 2, "end": 1.5, "probability": 1}, {"word": "y", "start": None, "end": 3}, {"word": "z", "start": 3, "end": 3, "probability": 1.2}, {"word": "w", "start": 4, "end": 5}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.json").write_text(json.dumps({"track": "host", "words": words}))
    (tmp_path / "in" / "odd.json").write_text("[no transcript")
    found = logs.words(spark, str(tmp_path / "in")).orderBy("pos").collect()
    assert [(r["track"], r["pos"], r["word"], r["start"], r["end"], r["fault"]) for r in found] == [(None, None, None, None, None, "no_document"), ("host", 1, "so", 100, 350, None), ("host", 2, "", 1000, 2000, "no_word"), ("host", 3, "x", 2000, 1500, "order"), ("host", 4, "y", None, 3000, "no_time"), ("host", 5, "z", 3000, 3000, "probability"), ("host", 6, "w", 4000, 5000, None)]

    root = str(tmp_path / "versions")
    logs.write_version(spark.range(3), root, 1)
    number, held = logs.frozen(spark, root)
    logs.write_version(spark.range(5), root, 2)
    assert (number, held.count()) == (1, 3) and logs.frozen(spark, root)[0] == 2 and logs.frozen(spark, root, 1)[1].count() == 3
    with pytest.raises(AnalysisException):
        logs.write_version(spark.range(1), root, 2)


def test_covered_overlaps_the_same(spark):
    spans = [s for s in rows(4) if s[1] <= s[2]]
    cover = intervals.covered(spark.createDataFrame(spans, "k int, start bigint, end bigint"), ["k"], 50).collect()
    for k in {s[0] for s in spans}:
        own = [(s, e) for key, s, e in spans if key == k]
        few = [(r["start"], r["end"]) for r in cover if r["k"] == k]
        assert len(few) <= len(own)
        for a in range(-60, 360, 3):
            for b in (a, a + 1, a + 9):
                assert any(s < b and a < e for s, e in own) == any(s < b and a < e for s, e in few), (k, a, b)


def test_sweeps_take_more_tasks_for_more_rows(spark, monkeypatch):
    """Rows of a task are bounded: 1,000 rows at 50 a task are 20 tasks, whatever the session's number; null keys are one key."""
    monkeypatch.setattr(running, "ROWS_A_TASK", 50)
    cuts = spark.range(1_000).selectExpr("IF(id % 50 = 7, NULL, id % 50) AS k", "id * 3 AS start", "id * 3 + 2 + id % 200 AS end")
    swept = intervals.removed_before(cuts, ["k"], 365)
    assert intervals.merged(cuts, ["k"], 365).rdd.getNumPartitions() == swept.rdd.getNumPartitions() == 20
    want, rows = [], sorted(((-1 if r["k"] is None else r["k"]), r["start"], r["end"]) for r in cuts.collect())
    for k, start, end in rows:
        if want and want[-1][0] == k and start <= want[-1][2]:
            want[-1][2:4] = max(want[-1][2], end), want[-1][3] + 1
        else:
            want.append([k, start, end, 1, want[-1][4] + want[-1][2] - want[-1][1] if want and want[-1][0] == k else 0])
    assert sorted([-1 if r["k"] is None else r["k"], r["start"], r["end"], r["n_parts"], r["removed"]] for r in swept.collect()) == want
