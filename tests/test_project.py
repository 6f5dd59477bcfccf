"""A project end to end: reuse of frozen candidates, only approved and kept cuts, digests, roles and backchannels against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cutloom.operators import candidates, gates, intervals, project, sequence
from cutloom.plans import project_queries


def test_reuse_keeps_the_frozen_candidates(spark, sf, tmp_path):
    root = str(tmp_path / "p")
    one = project_queries.finished(spark, sf, root)
    again = project_queries.finished(spark, sf, root, reuse=True)
    assert (one.version, again.version) == (0, 0) and one.digest == again.digest
    assert sorted(map(tuple, one.report.collect())) == sorted(map(tuple, again.report.collect()))
    newer = project_queries.finished(spark, sf, root)
    assert newer.version == 1 and newer.digest == one.digest
    report = one.report.collect()
    assert any(r["applied"] for r in report) and all(r["verdict"] == "APPROVE" and r["id"] % 3 == 1 for r in report if r["applied"])
    assert sorted(r["id"] for r in one.edl.collect()) == sorted(r["id"] for r in report if r["applied"])
    # the times are what taking the edit list's cuts out leaves
    cut = {(r["id"]): r for r in one.edl.collect()}
    spans = {r["id"]: r for r in spark.read.parquet(f"{root}/checked/version=0").collect()}
    taken = spark.createDataFrame([(spans[i]["track"], spans[i]["cut_start"], spans[i]["cut_end"]) for i in cut], "track long, start long, end long")
    points = one.words.select("id", "track", "t")
    assert sorted(map(tuple, one.words.collect())) == sorted(map(tuple, intervals.remapped(points, taken, ["track"], 1000).collect()))
    assert gates.verdict_or_review is not None


def test_only_kept_and_approved_cuts_enter(spark):
    fade = "struct<crossfade_ms: int>"
    cuts = spark.createDataFrame([(i, "a", v, 0, 100, (50,)) for i, v in enumerate(["APPROVE", "APPROVE", "APPROVE", "APPROVE", "REJECT", "HUMAN_REVIEW"])], f"id long, track string, verdict string, cut_start long, cut_end long, params {fade}")
    verdicts = spark.createDataFrame([(0, "KEEP_CUT"), (1, "REJECT_KEEP"), (2, "odd"), (4, "KEEP_CUT"), (5, "KEEP_CUT")], "id long, judged string")
    assert [tuple(r) for r in project.edit_list(cuts, verdicts, ["track"]).collect()] == [(0, "a", 0, 4800, 2400)]


@pytest.mark.parametrize("reach", [5, 60])
def test_backchannels(spark, reach):
    pick = random.Random(reach)
    found = [(i, pick.choice(["uh", "yes", "so", None]), pick.randint(0, 900), pick.choice(["h", "g", "x"])) for i in range(120)] + [(500, "yes", None, "h")]
    speech = [(pick.randint(0, 900), pick.choice(["h", "g", "x"])) for _ in range(40)]
    roles = spark.createDataFrame([("h", "host"), ("g", "guest")], "track string, role string")
    got = candidates.without_backchannel(spark.createDataFrame(found, "id long, token string, t long, track string"), spark.createDataFrame(speech, "t long, track string"), roles, ("yes", "uh"), "track", reach=reach, width=30)
    want = [i for i, token, t, k in found if not (token in ("yes", "uh") and k == "h" and t is not None and any(o != k and abs(u - t) <= reach for u, o in speech))]
    assert sorted(r["id"] for r in got.collect()) == want


def test_roles(spark):
    rows = [(1, "a", "yes", 0, 10)] * 6 + [(1, "a", "x", 0, 10)] * 2 + [(1, "b", "yes", 0, 10)] + [(1, "b", "x", 0, 100)] * 9 + [(2, "a", "yes", 0, 1), (2, "b", "yes", 0, 1), (3, "a", "x", 0, 5), (4, "a", "yes", 0, 5)]
    got = project.speaker_roles(spark.createDataFrame(rows, "rec int, track string, token string, start long, end long"), ["rec"], "track", ("yes",))
    assert {(r["rec"], r["track"]): r["role"] for r in got.collect()} == {(1, "a"): "host", (1, "b"): "guest", (2, "a"): "undecided", (2, "b"): "undecided", (3, "a"): "undecided", (4, "a"): "host"}
    timed = project.speaker_roles(spark.createDataFrame(rows, "rec int, track string, token string, start long, end long"), ["rec"], "track", ("yes",), F.lit(2000))
    assert {r["track"]: r["speaking_fraction"] for r in timed.where("rec = 1").collect()} == {"a": 0.04, "b": 0.455}


@pytest.mark.parametrize("width", [3, 1000])
def test_sentences_by_gap(spark, width):
    pick, words, want = random.Random(3), [], []
    for key in (1, 2):
        heard, own = None, []
        t = 0
        for pos in range(1, 60):
            t += pick.choice([0, 100, 700])
            start, end = (None, None) if pick.random() < 0.1 else (t, t + pick.choice([50, 900]))
            if start is not None and heard is not None and start - heard >= 600:
                want.append((key, len([w for w in want if w[0] == key]), own))
                own = []
            own.append(f"w{pos}")
            heard = max(x for x in (heard, end, -1) if x is not None) if heard is not None or end is not None else None
            words.append((key, pos, f"w{pos}", start, end))
        want.append((key, len([w for w in want if w[0] == key]), own))
    got = sequence.sentences_by_gap(spark.createDataFrame(words, "k int, pos long, word string, start long, end long"), ["k"], 600, width).collect()
    assert sorted((r["k"], r["sentence"], r["words"]) for r in got) == want


@pytest.mark.parametrize("width", [1, 7, 400])
def test_review_package(spark, width):
    """Cuts and words of all lengths, turned, empty and without times or a track, against plain loops; pairs are not gathered by cut."""
    pick = random.Random(width)

    def span():
        start = pick.randint(-300, 900)
        return pick.choice(["a", "b"]), start, start + pick.choice([-6, 0, 1, 5, 30, 64, 1000])

    cuts = [(i, "x", *span()) for i in range(80)] + [(100, "x", None, 0, 9), (101, "x", "a", None, 9), (102, "x", "a", 0, None)]
    words = [(*span()[:1], 500 - i, f"w{i}", *span()[1:]) for i in range(150)] + [(None, 1, "n", 0, 9), ("a", 2, "n", None, 9), ("a", 3, "n", 0, None)]
    want = {}
    for i, _, track, start, end in cuts:
        near = [w for w in words if None not in (track, start, end, w[0], w[3], w[4]) and w[0] == track and w[3] < end + 4 and start - 4 < w[4]]
        want[i] = ([w[2] for w in sorted(near, key=lambda w: w[1])], sum(w[3] >= start and w[4] <= end for w in near))
    got = project.review_package(spark.createDataFrame(words, "track string, pos long, word string, start long, end long"), spark.createDataFrame(cuts, "id long, kind string, track string, start long, end long"), F.lit("r"), 4, width, ["track"])
    rows = got.collect()
    assert {r["id"]: (r["heard"], r["n_taken"]) for r in rows} == want and len(rows) == len(cuts)
    assert {r["id"]: r["beside"] for r in rows if r["id"] < 100} == {c[0]: sum(d[2] == c[2] and d[3] is not None and abs(d[3] - c[3]) <= 4 for d in cuts) - 1 for c in cuts[:80]}
    assert "keys=[id#" not in got._jdf.queryExecution().toString()
