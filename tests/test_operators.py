"""Operators against golden values and plain code."""

import random

import pytest
from pyspark.sql import functions as F

from cutloom.functions import scalars
from cutloom.operators import candidates, gates, intervals, lake, media, params, registry_checks, rules, running, sequence, verification


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def spans(spark):
    pick = random.Random(1)
    made = [(i, f"k{i % 3}", s := pick.randint(0, 1000), s + pick.choice([0, 1, 5, 60, 400])) for i in range(150)]
    return made, spark.createDataFrame(made, "id long, k string, start long, end long").repartition(4)


def test_overlap_join_gives_each_pair_once(spark, spans):
    made, df = spans
    other = df.select(F.col("id").alias("other"), "k", "start", "end")
    want = sorted((a[0], b[0]) for a in made for b in made if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    for width, salts in ((7, 1), (100, 1), (5000, 4)):
        pairs = intervals.overlap_join(df, other, width, ["k"], salts)
        assert rows(pairs.select("id", "other")) == sorted(want, key=repr)


def test_merge_and_remap(spark, spans):
    made, df = spans
    covered = {}
    for _, k, s, e in made:
        covered.setdefault(k, set()).update(range(s, e))
    merged = intervals.merged(df, ["k"], 50)
    by = {}
    for k, s, e, _ in rows(merged):
        assert not by.setdefault(k, set()) & set(range(s, e))
        by[k] |= set(range(s, e))
    assert by == covered
    assert rows(merged) == rows(intervals.merged(df, ["k"], 100_000))
    assert sum(r[3] for r in rows(merged)) == sum(s < e for _, _, s, e in made)
    points = spark.createDataFrame([(k, t) for k in covered for t in range(0, 1500, 7)], "k string, t long")
    last = {}
    for k, t, new in sorted(rows(intervals.remapped(points, df, ["k"], 50)), key=lambda r: r[:2]):
        assert new == (None if t in covered[k] else t - sum(x < t for x in covered[k]))
        if new is not None:
            assert new >= last.get(k, -1)
            last[k] = new


def test_total_removed(spark):
    cuts = spark.createDataFrame([("e", 1000, 1680), ("e", 5000, 5680), ("e", 9000, 9720)], "k string, start long, end long")
    assert intervals.merged(cuts, ["k"], 1000).agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 2080


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    pick = random.Random(3)
    left = [(i, pick.choice(["a", "b", None]), pick.randint(0, 100)) for i in range(80)]
    right = [(pick.choice(["a", "b", None]), pick.randint(0, 100), i) for i in range(40)]
    found = intervals.asof(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), ["k"], 10, "v", strict)
    for i, k, t, v in rows(found):
        times = [r[1] for r in right if r[0] == k and (r[1] < t or r[1] == t and not strict)]
        assert (v is None) == (not times) and (v is None or v in [r[2] for r in right if r[0] == k and r[1] == max(times)])
    assert found.count() == 80


def test_running_equals_one_window(spark, spans):
    made, df = spans
    got = running.with_running(df, ["k"], ["start", "id"], F.floor(F.col("start") / 40), total=("sum", "end"), most=("max", "end"), least=("min", "end"), latest=("last", "id"))
    for i, k, s, _, total, most, least, latest in rows(got):
        before = sorted((r for r in made if r[1] == k and (r[2], r[0]) < (s, i)), key=lambda r: (r[2], r[0]))
        ends = [r[3] for r in before]
        assert (total, most, least, latest) == ((sum(ends), max(ends), min(ends), before[-1][0]) if before else (None,) * 4)


def test_containment_widens_only_covered_cuts(spark):
    words = spark.createDataFrame([(1, 354080, 354760), (2, 2268210, 2268930)], "w long, start long, end long")
    cuts = spark.createDataFrame([(1, 354230, 354616), (2, 2268361, 2268786), (3, 2268000, 2268500)], "id long, start long, end long")
    got = rows(intervals.containing(cuts, words, 1000).select("id", "r_start", "r_end"))
    assert got == [(1, 354080, 354760), (2, 2268210, 2268930)]


def test_runs_and_pauses(spark):
    words = sequence.tokens(spark.createDataFrame([(1, "a a b b b a a"), (2, None), (3, ""), (4, "x")], "d long, text string"), ["d"])
    assert rows(sequence.runs(words, ["d"]).select("word", "start_pos", "n")) == [("a", 1, 2), ("a", 6, 2), ("b", 3, 3)]
    never = spark.createDataFrame([("b",)], "word string")
    assert {r[1] for r in candidates.repetitions(words, ["d"], never).select("d", "word").collect()} == {"a"}
    frame = spark.createDataFrame([(1, False, 80), (1, True, 260), (3, False, 180), (8, False, 480), (9, False, 500)], "n int, sep boolean, want long")
    assert all(r["want"] == r["p"] for r in frame.withColumn("p", candidates.pause_ms(F.col("n"), F.col("sep"))).collect())


def test_restarts_in_order_find_common_subsequences(spark):
    pick = random.Random(4)
    text = " ".join(pick.choices("a b c d e f".split(), k=300))
    words = sequence.tokens(spark.createDataFrame([(1, text)], "d long, text string"), ["d"])
    w = text.split(" ")

    def common(a, b):
        return 0 if not a or not b else 1 + common(a[1:], b[1:]) if a[0] == b[0] else max(common(a[1:], b), common(a, b[1:]))

    want = [(1, i + 1, common(w[i - 4 : i], w[i : i + 4]) / 4) for i in range(4, len(w) - 3) if common(w[i - 4 : i], w[i : i + 4]) >= 3]
    assert sorted(map(tuple, candidates.restarts_in_order(words, ["d"]).collect())) == want


def test_neighbours_are_never_eaten(spark, spans):
    made, _ = spans
    flat = spark.createDataFrame([(i, "k", 100 * i, 100 * i + 70) for i in range(20)], "id long, k string, start long, end long")
    cut = {r["id"]: r for r in candidates.widened(flat, ["k"], 180, 500).collect()}
    for i in range(1, 19):
        assert cut[i]["cut_start"] >= cut[i - 1]["end"] + 20 and cut[i]["cut_end"] <= cut[i + 1]["start"] - 20
    assert cut[0]["cut_start"] == -180 and cut[19]["cut_end"] == 1970 + 180


def test_shared_pauses_need_every_track_silent(spark):
    made = [(1, "a", 0, 100), (2, "a", 3000, 3100), (3, "a", 9000, 9100), (4, "b", 4000, 4100), (5, "b", 20000, 20001)]
    df = spark.createDataFrame(made, "id long, track string, start long, end long")
    assert rows(candidates.shared_pauses(df, "track", 2000, 1000).select("id", "start", "end")) == [(1, 100, 3000)]


def test_backchannel_reach(spark):
    own = spark.createDataFrame([(1, "a", 10_000), (2, "a", 50_000)], "id long, track string, t long")
    others = spark.createDataFrame([("b", 12_900), ("b", 53_100), ("a", 50_001)], "track string, t long")
    assert [r["id"] for r in candidates.answered(own, others, "track", 3000, 5000).collect()] == [1]


def test_chain_extent(spark):
    words = spark.createDataFrame([("c", 0, 10), ("c", 20, 30), ("c", 40, 55), ("d", 1, 2)], "k string, start long, end long")
    assert rows(candidates.chain_extent(words, ["k"])) == [("c", 0, 30, 3)]


def test_cascade_is_the_and_of_its_evidence(spark):
    frame = spark.createDataFrame([(True, True), (True, False), (None, True), (None, None)], "a boolean, b boolean")
    got = [tuple(r)[-2:] for r in gates.cascade(frame, [("g1", F.col("a")), ("g2", F.col("b"))]).collect()]
    assert got == [(None, True), ("g2", False), ("g1", False), ("g1", False)]


def test_router_priorities(spark):
    low, negative, tight = "REJECT_LOW_PROB_HALLUCINATION", "RHYTHM_INVALID_NEGATIVE_GAP", "RHYTHM_TOO_TIGHT"
    cases = [
        (low, negative, "CUT_IN_SILENCE", "REMOVE_FROM_EDL"), ("KEEP", negative, "CUT_IN_SILENCE", "REMOVE_FROM_EDL"), ("KEEP", tight, "CUT_IN_SILENCE", "NEEDS_HUMAN_REVIEW"), ("KEEP", "RHYTHM_OK", "CUT_IN_SILENCE", "BUTT_SPLICE"),
        ("KEEP", "RHYTHM_DRAGGING", "CUT_SPANS_BOUNDARY", "CROSSFADE_50MS"), ("NO_WORD", "RHYTHM_OK", "CUT_IN_CONTENT_ZONE", "CROSSFADE_100MS_HUMAN_REVIEW"), ("KEEP", "RHYTHM_OK", None, "CROSSFADE_50MS"), (None, None, None, "CROSSFADE_50MS"),
    ]
    got = spark.createDataFrame(cases, "heard string, rhythm string, location string, want string").withColumn("got", gates.splice_strategy(*(F.col(c) for c in ("heard", "rhythm", "location"))))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_probability_and_tolerances(spark):
    frame = spark.createDataFrame([("filler", 0.4876, "REJECT"), ("filler", 0.46, "REJECT"), ("filler", 0.75, "KEEP"), ("filler", 0.6, "KEEP"), ("pause", 0.1, "KEEP"), ("filler", None, "KEEP")], "k string, p double, want string")
    assert all(r["want"] == r["got"] for r in frame.withColumn("got", gates.reject_improbable(F.col("k"), F.col("p"), ("filler", "repetition"))).collect())
    one = spark.range(1).select(gates.tolerance(F.lit(-22.77), -22.2, 1.0).alias("l"), (F.lit(-1.29) <= -1.0).alias("p"), gates.tolerance(F.lit(6.3), 7.9, 1.0).alias("r")).first()
    assert tuple(one) == ("PASS", True, "FAIL")
    levels = spark.createDataFrame([(-60.0, "OK"), (-50.0, "HUMAN_REVIEW"), (-25.0, "BLOCK"), (None, "HUMAN_REVIEW")], "d double, want string")
    assert all(r["want"] == r["got"] for r in levels.withColumn("got", gates.artifact_risk(F.col("d"))).collect())


def test_rule_order_and_strictness(spark):
    kind = "rule_id int, tokens array<string>, reasons array<string>, context string, verdict string, priority int, ts string"
    known = spark.createDataFrame([(1, ["uh"], [], None, "never_cut", 9, "2026-01-01"), (2, ["uh"], [], None, "pause_shorter", 1, "2026-09-01"), (3, [], ["filler"], None, "policy", 99, None), (4, ["uh"], [], "other", "never_cut", 100, None)], kind)
    cases = spark.createDataFrame([(1, "uh", "filler", None), (2, "er", "filler", "x"), (3, "er", "none", None)], "case_id int, token string, reason string, context string")
    got = rows(rules.matched_rules(cases, known, 2).select("case_id", "place", "rule_id", "exact"))
    assert got == [(1, 1, 1, True), (1, 2, 2, True), (2, 1, 3, False)]


def test_lake_totals_and_fallback(spark):
    made = [("filler", "uh", "a", True)] * 5 + [("filler", "uh", "b", False)] * 3 + [("repetition", None, "c", True)] * 10 + [("repetition", "x", "d", False)] * 14 + [("long_pause", None, None, True), ("long_pause", None, None, None)]
    built = lake.label_lake(spark.createDataFrame(made, "reason_key string, subtype string, filler_token string, accepted boolean"))
    top = {r["reason_key"]: (r["accept"], r["reject"], r["total"], r["accept_rate"]) for r in built.where("level = 1").collect()}
    assert top == {"filler": (5, 3, 8, 0.625), "repetition": (10, 14, 24, 0.417), "long_pause": (1, 0, 1, 1.0)}
    total = built.where("level = 0").first()
    assert (total["accept"], total["reject"], total["total"]) == (16, 17, 33)
    for level in (1, 2, 3):
        assert built.where(f"level = {level}").agg(F.sum("total")).first()[0] == 33
    cases = spark.createDataFrame([("filler", "uh", "a"), ("filler", "uh", "z"), ("filler", "q", "z"), ("new", "q", "z"), ("long_pause", None, None)], "reason_key string, subtype string, filler_token string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in lake.looked_up_rate(cases, built).collect()}
    assert got == {("filler", "uh", "a"): (1.0, 3), ("filler", "uh", "z"): (0.625, 2), ("filler", "q", "z"): (0.625, 1), ("new", "q", "z"): (None, 0), ("long_pause", None, None): (1.0, 3)}


def test_confusion_of_eight_reviewed_cases(spark):
    cut, picked = {"C007", "C034", "C044"}, {"C007", "C034", "C023"}
    frame = spark.createDataFrame([(c, c in picked, c in cut) for c in ("C007", "C034", "C044", "C023", "C001", "C002", "C003", "C004")], "c string, p boolean, a boolean")
    assert tuple(lake.confusion(frame, F.col("p"), F.col("a")).first()) == (2, 1, 1, 4)


def test_changes(spark):
    old, new = spark.createDataFrame([(1, True), (2, False), (3, True)], "id int, v boolean"), spark.createDataFrame([(2, True), (3, True), (4, False)], "id int, v boolean")
    assert {r["id"]: r["change"] for r in lake.changed(old, new, "id", "v").collect()} == {1: "removed", 2: "changed", 3: "same", 4: "added"}


def test_dependency_gaps(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    aliases = spark.createDataFrame([("yaml", "PyYAML")], "import_name string, package string")
    found = registry_checks.dependency_gaps(names("PyYAML", "num_py", "idle", "pip"), names("yaml", "num-py", "json"), names("pyyaml"), aliases, names("pip", "json"))
    assert rows(found) == [("idle", "unused"), ("num-py", "undeclared")]
    assert registry_checks.verdict(found).first()["verdict"] == "FAIL"
    assert registry_checks.verdict(found.where("problem = 'unused'")).first()["verdict"] == "WARN"
    assert registry_checks.verdict(found.limit(0)).first()["verdict"] == "PASS"


def test_a_whitelist_excuses_no_undeclared_name(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    aliases = spark.createDataFrame([], "import_name string, package string")
    found = registry_checks.dependency_gaps(names("idle", "tool", "json"), names("tool", "json"), names("other"), aliases, names("json"), names("idle", "tool"))
    assert rows(found) == [("tool", "undeclared")]


def test_registered_and_allowed_paths(spark):
    tools = spark.createDataFrame([("/opt/x/scripts/a.py", None), (None, "scripts/b.py"), ("c/opt/x/d.py", "e.py"), (None, None)], "full_path string, script string")
    assert [r[0] for r in rows(registry_checks.registered_paths(tools, ["full_path", "script"], "/opt/x/"))] == ["c/opt/x/d.py", "e.py", "scripts/a.py", "scripts/b.py"]
    lists = spark.sql("SELECT map('one', named_struct('files', array('p', 'q')), 'two', named_struct('files', array('q', 'r'))) AS buckets")
    assert [r[0] for r in rows(registry_checks.allowed_paths(lists))] == ["p", "q", "r"]


def test_the_first_name_wins_of_equal_levels(spark):
    made = [(1, "abc", 2.0), (1, "ab", 2.0), (2, "a", 1.0), (2, "B", 1.0), (3, "x", None), (3, "y", -1.0), (4, "track10", 3.0), (4, "track2", 3.0)]
    found = media.dominant(spark.createDataFrame(made, "w int, track string, level double"), "w", "track", "level")
    assert [r[:2] for r in rows(found)] == [(1, "ab"), (2, "B"), (3, "y"), (4, "track10")]


def test_verification(spark):
    """Probabilities of the golden rows: 0.4876 and 0.46 are rejected, 0.75 is kept. Words and silences of track b never decide a cut of track a."""
    cuts = spark.createDataFrame([(1, "filler", "a", 0, 100), (2, "filler", "a", 1000, 1100), (3, "filler", "a", 2000, 2100), (4, "noise", "a", 3000, 3100), (5, "filler", "a", 9000, 9100), (6, "filler", "c", 0, 100)], "id long, kind string, track string, start long, end long")
    own = [(50, 80, 0.4876), (1000, 1050, 0.9), (1050, 1200, 0.46), (2000, 2100, 0.75), (3000, 3100, 0.1), (3100, 3200, None)]
    words = spark.createDataFrame([("a", *w) for w in own] + [("b", 0, 9000, 0.01), ("b", 9000, 9100, 0.2)], "track string, start long, end long, probability double")
    found = verification.word_evidence(cuts, words, ["track"], 500, ("filler",))
    assert rows(found.select("id", "n_words", "min_probability", "heard")) == [
        (1, 1, 0.4876, "REJECT_LOW_PROB_HALLUCINATION"), (2, 2, 0.46, "REJECT_LOW_PROB_HALLUCINATION"), (3, 1, 0.75, "KEEP"), (4, 1, 0.1, "KEEP"), (5, 0, None, "NO_WORD"), (6, 0, None, "NO_WORD")]
    levels = spark.createDataFrame([("a", 0, 50, -60.0), ("a", 50, 120, -50.0), ("a", 1000, 1100, -30.0), ("a", 1950, 2050, -70.0), ("b", 2900, 9999, -70.0)], "track string, start long, end long, level double")
    silence = verification.silences(levels, ["track"], 1000, -40.0, 100)
    assert rows(silence) == [("a", 0, 120), ("a", 1950, 2050), ("b", 2900, 9999)]
    located = rows(verification.located(cuts, silence, ["track"], 500).select("id", "location"))
    assert [r[1] for r in located] == ["CUT_IN_SILENCE", "CUT_IN_CONTENT_ZONE", "CUT_SPANS_BOUNDARY", "CUT_IN_CONTENT_ZONE", "CUT_IN_CONTENT_ZONE", None]


def test_gaps_are_to_the_words_that_stay(spark):
    pick = random.Random(6)
    cuts = [(i, pick.choice("ab"), s, s + pick.randint(1, 60)) for i, s in enumerate(pick.choices(range(1500), k=80))]
    words = [(pick.choice("abc"), s, s + pick.randint(0, 40)) for s in pick.choices(range(1500), k=90)]
    got = verification.word_gaps(spark.createDataFrame(cuts, "id long, track string, start long, end long"), spark.createDataFrame(words, "track string, start long, end long"), ["track"], 100)
    for r in got.collect():
        own = [(s, e, (s + e) // 2) for k, s, e in words if k == r["track"]]
        before, after = [e for s, e, m in own if m < r["start"]], [s for s, e, m in own if m >= r["end"]]
        assert (r["gap_before"], r["gap_after"]) == (r["start"] - max(before) if before else None, min(after) - r["end"] if after else None)


def test_rhythm_parameters_and_expansion(spark):
    made = [(10, -1, None, "RHYTHM_INVALID_NEGATIVE_GAP"), (40, 200, "CUT_IN_CONTENT_ZONE", "RHYTHM_REJECT"), (40, 200, None, "RHYTHM_REJECT"), (40, 200, "CUT_IN_SILENCE", "RHYTHM_TOO_TIGHT"), (60, 200, None, "RHYTHM_TOO_TIGHT"),
            (120, 119, None, "RHYTHM_TOO_TIGHT"), (300, 450, None, "RHYTHM_OK"), (301, None, None, "RHYTHM_DRAGGING"), (None, 451, None, "RHYTHM_DRAGGING"), (None, None, None, "RHYTHM_OK")]
    frame = spark.createDataFrame(made, "b long, a long, location string, want string")
    assert all(r["want"] == r["got"] for r in frame.withColumn("got", verification.rhythm(F.col("b"), F.col("a"), F.col("location"))).collect())
    kinds = spark.createDataFrame([("BUTT_SPLICE", "filler_hesitation"), ("CROSSFADE_50MS", "pause"), ("NEEDS_HUMAN_REVIEW", "other")], "s string, k string")
    assert [tuple(r[0]) for r in kinds.select(verification.recommended(F.col("s"), F.col("k"))).collect()] == [(0, 10, 210, 110), (50, 0, 100, 120), (None, None, None, None)]
    # golden: 385 to 680 ms and 426 to 720 ms by the word around; a cut that no word holds stays
    cuts = spark.createDataFrame([(7, "filler", "a", 354_230, 354_616), (34, "filler", "a", 1_743_490, 1_744_170), (44, "filler", "a", 2_268_361, 2_268_786), (1, "pause", "a", 354_230, 354_616)], "id long, kind string, track string, start long, end long")
    words = spark.createDataFrame([("a", 354_080, 354_760), ("a", 1_743_500, 1_744_300), ("a", 2_268_210, 2_268_930), ("b", 0, 9_000_000)], "track string, start long, end long")
    assert {r["id"]: r["cut_end"] - r["cut_start"] for r in verification.expanded(cuts, words, ["track"], ("filler",), 60_000).collect()} == {7: 680, 34: 680, 44: 720, 1: 386}


def test_guards_and_order_of_checks(spark):
    made = [("a", True, 0.9, True), ("a", False, 0.4, True), ("a", False, 0.9, False), ("a", False, None, False), ("ab", True, 0.1, False)]
    frame = spark.createDataFrame(made, "word string, near boolean, p double, want boolean")
    assert all(r["want"] == r["g"] for r in frame.withColumn("g", gates.single_character_guard(F.col("word"), F.col("near"), F.col("p"))).collect())


def test_imports_and_declarations(spark):
    text = "import os, numpy.linalg\nfrom  pandas.core import x\n  import re\nprint('import no')\n"
    sources = spark.createDataFrame([("/a/b.py", text), ("/a/venv/c.py", "import hidden")], "path string, text string")
    assert {r[0] for r in registry_checks.imported_names(sources, ["venv"]).collect()} == {"os", "numpy", "pandas", "re"}
    top = spark.createDataFrame([("Scikit-Learn",), ('{"name": "NumPy", "version": "2"}',), ('{"version": "2"}',), (None,)], "entry string")
    entries = spark.createDataFrame([("Torch>=2.0",), ("python 3 ffmpeg: 6",), (None,)], "entry string")
    assert {r[0] for r in registry_checks.declared_names(top, entries, ["python"]).collect()} == {"scikit-learn", "numpy", "torch", "2.0", "ffmpeg"}


def test_unregistered_needs_no_match_at_all(spark):
    paths = lambda *xs: spark.createDataFrame([(x,) for x in xs], "path string")
    assert rows(registry_checks.unregistered(paths("s/a.py", "s/b.py", "s/c.py", "s/d.py"), paths("s/a.py", "other/b.py"), paths("s/c.py"))) == [("s/d.py",)]


def test_parameters(spark):
    known = spark.createDataFrame([("default", "k", None, 50.0), ("class", "k", "long_pause", 200.0), ("profile", "k", "P", 120.0)], "scope string, key string, class string, value double")
    cases = spark.createDataFrame([(1, "long_pause", "P"), (2, "filler", "P"), (3, "filler", "Q"), (4, None, None)], "id int, class string, profile string")
    assert {r["id"]: r["v"] for r in params.looked_up(cases, known, "k", "v").collect()} == {1: 200.0, 2: 120.0, 3: 50.0, 4: 50.0}
    fade = spark.range(1).select(params.crossfade_samples(F.lit(50), F.lit(10_000)), params.crossfade_samples(F.lit(50), F.lit(1000)), params.crossfade_samples(F.lit(50), F.lit(10))).first()
    assert tuple(fade) == (2400, 872, 0)


def test_times_and_lists(spark):
    spelled = ["2026-08-17T10:00:00", "2026-08-17T10:00:00.123Z", "2026-08-17T10:00:00.123456Z", "2026-08-17T12:00:00+02:00", "2026-08-17", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in spelled], "t string").select(F.date_format(scalars.parsed_time(F.col("t")), "dd HH:mm:ss")).collect()]
    assert got == ["17 10:00:00"] * 4 + ["17 00:00:00", None, None]
    lists = spark.createDataFrame([("uh",), ('["a", "b"]',), (None,)], "x string").select(scalars.as_list(F.col("x"))).collect()
    assert [r[0] for r in lists] == [["uh"], ["a", "b"], None]


def test_paths_below_the_first_root_that_has_them(spark):
    paths = spark.createDataFrame([(1, "x.py"), (2, "y.py"), (3, "z.py"), (4, "/abs/a.py"), (5, None), (6, "x.py")], "id int, path string")
    files = spark.createDataFrame([("b/x.py",), ("a/x.py",), ("b/y.py",), ("/abs/a.py",), ("a/abs/a.py",)], "path string")
    got = {r["id"]: r["file"] for r in registry_checks.resolved(paths, files, ["a/", "b/"]).collect()}
    assert got == {1: "a/x.py", 2: "b/y.py", 3: None, 4: "/abs/a.py", 5: None, 6: "a/x.py"}


def test_rules_take_more_tasks_for_more_cases(spark, monkeypatch):
    """Cases of one token are dealt over tasks by their number, and do not meet in the token's one task."""
    monkeypatch.setattr(running, "ROWS_A_TASK", 50)
    cases = spark.range(1_000).selectExpr("id AS case_id", "'so' AS token", "'few' AS reason", "IF(id % 2 = 0, 'low', 'high') AS context")
    kind = "rule_id int, tokens array<string>, reasons array<string>, context string, verdict string, priority int, ts string"
    known = spark.createDataFrame([(1, ["so"], [], None, "a", 1, None), (2, ["so"], [], "low", "b", 2, None), (3, [], ["few"], None, "c", 9, None)], kind)
    found = rules.matched_rules(cases, known, 1)
    assert found.rdd.getNumPartitions() == 50  # 2,500 hits
    sizes = [len(part) for part in found.rdd.glom().collect()]
    assert max(sizes) < 100 and sum(sizes) == 1_000
    assert {(r["case_id"] % 2, r["rule_id"], r["exact"], r["place"]) for r in found.collect()} == {(0, 2, True, 1), (1, 1, True, 1)}


def test_runs_take_more_tasks_for_more_cases(spark, sf, monkeypatch):
    from cutloom.plans import registry

    monkeypatch.setattr(running, "ROWS_A_TASK", 200)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert all(run.rdd.getNumPartitions() == -(-rows // 200) for run in registry.decision_queries.auto_cuts(spark, sf))
