"""Readers, sinks and streams over files that the tests write."""

import json
import struct
import wave

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cutloom.operators import lake, rules
from cutloom.sources import logs, wav
from cutloom.streaming import refresh
from cutloom.tables import table


def test_feedback_log(spark, tmp_path):
    lines = [
        {"schema_version": "session-feedback-v1", "timestamp": "2026-08-17T18:00:00", "kind": "k", "candidate_pattern": {"filler_token": "uh"}, "verdict": "never_cut"},
        {"kind": "k", "candidate_pattern": {"filler_token": ["a", "b"], "reason_key": ["filler"], "context": "c"}, "verdict": "policy"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    got = logs.feedback(spark, str(tmp_path / "a.jsonl")).cache().select("tokens", "reasons", "context", "ts", "_corrupt_record").collect()
    assert [r["tokens"] for r in got] == [["uh"], ["a", "b"], None]
    assert got[1]["reasons"] == ["filler"] and got[1]["ts"] is None and got[0]["ts"] is not None and got[2]["_corrupt_record"] == "{broken"


def test_lake_document_decisions_and_tools(spark, tmp_path):
    leaf = {"accept": 2, "reject": 1, "total": 3, "accept_rate": 0.667, "case_ids": ["x"]}
    (tmp_path / "lake.json").write_text(json.dumps({"by_reason_key": {"filler": {"_subtypes": {"s": {"_tokens": {"uh": leaf}}}}}}, indent=1))
    assert tuple(logs.lake_rows(spark, str(tmp_path / "lake.json")).first())[:5] == ("filler", "s", "uh", 2, 1)
    for run in ("r1", "r2"):
        (tmp_path / run / "deep").mkdir(parents=True)
        (tmp_path / run / "deep" / "human_decisions.json").write_text(json.dumps({"run_id": run, "reviewer": "R1", "decisions": [{"clip_id": "C1", "verdict": "accept", "decided_at": "2026-08-17T10:00:00.123Z"}]}, indent=1))
    assert {r["run_id"] for r in logs.decisions(spark, str(tmp_path)).collect()} == {"r1", "r2"}
    (tmp_path / "tools.json").write_text(json.dumps({"tools": [{"name": "a", "full_path": "/x"}, {"name": "b", "script": "y"}, {"name": "c", "wraps_script": "z"}]}))
    assert {r["name"]: r["path"] for r in logs.tools(spark, str(tmp_path / "tools.json")).collect()} == {"a": "/x", "b": "y", "c": None}
    note = json.dumps({"reason_key": "filler", "risk": None, "episode": "E"})
    (tmp_path / "meta.jsonl").write_text(json.dumps({"row": 0, "case_id": "E::r::C1", "start": 1.5, "end": 2.0, "note": note}))
    assert logs.cases(spark, str(tmp_path / "meta.jsonl")).first()["reason_key"] == "filler"
    assert logs.files(spark, str(tmp_path), "*.json").count() == 4
    assert logs.texts(spark, str(tmp_path), "meta*").first()["text"].startswith("{")


def test_sinks(spark, sf, tmp_path):
    nation = table(spark, sf, "nation")
    logs.append_log(nation, str(tmp_path / "log"))
    logs.append_log(nation, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 50
    logs.write_run(nation, str(tmp_path / "run"))
    with pytest.raises(AnalysisException):
        logs.write_run(nation, str(tmp_path / "run"))
    logs.write_current(nation.limit(3), str(tmp_path / "now"), str(tmp_path / "also"))
    logs.write_current(nation, str(tmp_path / "now"), str(tmp_path / "also"))
    assert spark.read.parquet(str(tmp_path / "also")).count() == 25
    logs.report(nation.limit(2), str(tmp_path / "report"), "Nations")
    assert spark.read.text(str(tmp_path / "report")).first()[0] == "# Nations"
    with pytest.raises(ValueError):
        logs.report(nation, str(tmp_path / "r2"), "x", most=5)


def test_manifest_does_not_depend_on_order(spark, sf):
    nation = table(spark, sf, "nation")
    whole = lambda df: logs.manifest(df, "n_nationkey").where("key = '*'").first()["sha256"]
    assert whole(nation) == whole(nation.orderBy(F.desc("n_name")).repartition(5)) != whole(nation.where("n_nationkey > 0"))


def test_refresh_equals_a_full_rebuild(spark, tmp_path):
    """Late, changed, replayed and undone decisions: after each batch the lake is what a rebuild from all decisions gives."""
    place = {name: str(tmp_path / name) for name in ("in", "lake", "check")}
    kind = "case_id int, reason_key string, subtype string, accepted boolean, decided_at timestamp"
    levels, seen, arrived = ["reason_key", "subtype"], [], []
    as_rows = lambda df: sorted((r["level"], r["reason_key"] or "", r["subtype"] or "", r["accept"], r["reject"], r["total"], r["accept_rate"]) for r in df.collect())

    def arrive(rows):
        arrived.extend(rows)
        made = lambda rs: spark.createDataFrame(rs, "case_id int, reason_key string, subtype string, accepted boolean, t string").withColumn("decided_at", F.to_timestamp("t")).drop("t")
        made(rows).write.mode("append").parquet(place["in"])
        refresh.refresh_on_decisions(refresh.as_stream(spark, place["in"], kind), place["lake"], place["check"], ["case_id"], levels, lambda df: seen.append(as_rows(df))).awaitTermination(120)
        newest = rules.latest(made(arrived), ["case_id"], [F.desc_nulls_last("decided_at"), F.desc("accepted")])
        want = as_rows(lake.label_lake(newest, levels))
        assert seen[-1] == want == as_rows(refresh.rolled_up(refresh.published(spark, place["lake"]), levels))

    assert refresh.published(spark, place["lake"]) is None
    arrive([(1, "filler", "a", True, "2026-01-02"), (2, "filler", "a", False, "2026-01-02"), (3, "pause", None, True, "2026-01-02"), (None, "noise", "x", True, None)])
    arrive([(1, "filler", "a", False, "2026-01-03"), (2, "filler", "a", True, "2026-01-01"), (4, "filler", "b", True, "2026-01-03"), (4, "filler", "b", True, "2026-01-03")])
    arrive([(1, "filler", "a", False, "2026-01-03"), (3, "stop", "c", False, "2026-01-04"), (2, "filler", "a", None, "2026-01-05"), (4, "filler", "b", False, "2026-01-03")])
    # a version that was not finished is not seen, and the batch that made it is made again from the one before
    versions = refresh.whole_versions(spark, place["lake"])
    assert versions == [0, 1, 2]
    (tmp_path / "lake" / "version=2" / "_SUCCESS").unlink()
    assert refresh.whole_versions(spark, place["lake"]) == [0, 1]


def test_refresh_keeps_its_state_without_a_call_for_each_key(spark, tmp_path):
    """Many keys, ties and nulls: each batch the lake of all decisions, by an aggregate of Spark's with a row of state a key and no Python in its plan."""
    place = {name: str(tmp_path / name) for name in ("in", "lake", "check")}
    kind, levels = "case_id int, reason_key string, accepted boolean, decided_at timestamp", ["reason_key"]
    n = F.col("id")
    at = F.timestamp_micros(F.lit(1_767_225_600_000_000) + n % 3)
    for start in (0, 4_000):
        key = F.when(n % 11 != 0, (n % 2_000).cast("int")).alias("case_id")
        reason = F.when(n % 5 == 0, "unknown").when(n % 5 > 1, F.concat(F.lit("r"), n % 5)).alias("reason_key")
        made = spark.range(start, start + 6_000).select(key, reason, F.when(n % 7 < 3, n % 7 < 2).alias("accepted"), F.when(n % 13 != 0, at).alias("decided_at"))
        made.write.mode("append").parquet(place["in"])
        query = refresh.refresh_on_decisions(refresh.as_stream(spark, place["in"], kind), place["lake"], place["check"], ["case_id"], levels)
        query.awaitTermination(120)
        arrived = spark.read.schema(kind).parquet(place["in"])
        best = rules.latest(arrived.fillna("unknown", levels), ["case_id"], [F.desc_nulls_last("decided_at"), F.desc_nulls_last("accepted"), F.desc("reason_key")])
        want = {r["reason_key"]: (r["accept"], r["reject"]) for r in lake.label_lake(best, levels).where("level = 1").collect()}
        assert {r["reason_key"]: (r["accept"], r["reject"]) for r in refresh.published(spark, place["lake"]).collect()} == want and len(want) == 4
        state = query.lastProgress["stateOperators"][0]
        assert (state["operatorName"], state["numRowsTotal"]) == ("stateStoreSave", arrived.select("case_id").distinct().count())
        assert "Python" not in query._jsq.explainInternal(False) and "Pandas" not in query._jsq.explainInternal(False)


def test_regate_diff(spark):
    old, new = spark.createDataFrame([(1, True), (2, False)], "case_id int, auto_cut boolean"), spark.createDataFrame([(1, True), (2, True)], "case_id int, auto_cut boolean")
    assert [tuple(r) for r in refresh.regate_diff(old, new).collect()] == [(2, False, True, "changed")]


def run_stream(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect()


def test_streamed_windows_equal_the_batch(spark, sf, tmp_path):
    table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    count = lambda df: refresh.counted_by_window(df, "ts", "1 hour", "1 day", None, ["event_type"])
    stream = refresh.as_stream(spark, str(tmp_path / "e"), "event_type string, ts timestamp")
    assert sorted(map(tuple, run_stream(spark, count(stream), "daily", "complete"))) == sorted(map(tuple, count(batch).collect()))


def test_streamed_sessions(spark, tmp_path):
    at = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    for n, times in enumerate(([("a", 0), ("a", 5), ("b", 3)], [("a", 60), ("b", 61)], [("z", 600)], [("z", 601)])):
        spark.createDataFrame([(u, at(s)) for u, s in times], "user string, t string").select("user", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = sorted((r["user"], r["n"]) for r in run_stream(spark, refresh.sessions(stream, "user", "ts", 10_000, "5 seconds"), "sessions", "append"))
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]


def test_lake_excludes_reviewers(spark):
    made = spark.createDataFrame([("r", "s", "t", True, "R1"), ("r", "s", "t", False, "bot")], "reason_key string, subtype string, filler_token string, accepted boolean, reviewer string")
    got = lake.label_lake(made, excluded=spark.createDataFrame([("bot",)], "reviewer string")).where("level = 0").first()
    assert (got["accept"], got["reject"]) == (1, 0)


def chunk(name, body, size=None):
    return name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)


def form(codec, channels, rate, bits, rest=b""):
    return struct.pack("<HHIIHH", codec, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + rest


def test_wav_files_by_chunk(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(3), w.setframerate(48_000)
        w.writeframes(b"\0" * 6 * 24_000)
    second = b"\1" * 96_000
    extensible = form(0xFFFE, 1, 48_000, 16, struct.pack("<HHI", 22, 16, 4) + struct.pack("<H", 3) + b"\0" * 14)
    riff = lambda *chunks, name=b"RIFF", size=None: chunk(name, b"WAVE" + b"".join(chunks), size)
    made = {
        "list.wav": riff(chunk(b"LIST", b"INFOodd"), chunk(b"JUNK", b"\0" * 28), chunk(b"fmt ", form(1, 1, 48_000, 16)), chunk(b"data", second)),
        "after.wav": riff(chunk(b"data", second), chunk(b"fmt ", form(1, 1, 48_000, 16))),
        "extensible.wav": riff(chunk(b"fmt ", extensible), chunk(b"fact", b"\0" * 4), chunk(b"data", second)),
        "large.wav": riff(chunk(b"ds64", struct.pack("<QQQI", 0, 96_000, 0, 0)), chunk(b"fmt ", form(1, 1, 48_000, 16)), chunk(b"data", second, 0xFFFFFFFF), name=b"RF64", size=0xFFFFFFFF),
        "cut.wav": riff(chunk(b"fmt ", form(1, 1, 48_000, 16)), chunk(b"data", second, 5_000_000)),
        "none.wav": b"no wave at all", "empty.wav": b"", "bare.wav": riff(chunk(b"data", second)), "silent.wav": riff(chunk(b"fmt ", form(1, 1, 8_000, 8))),
    }
    (tmp_path / "below").mkdir()
    for name, body in made.items():
        (tmp_path / ("below/" * (name[0] == "e") + name)).write_bytes(body)
    (tmp_path / "notes.txt").write_text("no sound")
    spark.dataSource.register(wav.WavSource)
    want = {
        "a.wav": (1, 2, 48_000, 24, 144_000, 0.5, None), "list.wav": (1, 1, 48_000, 16, 96_000, 1.0, None), "after.wav": (1, 1, 48_000, 16, 96_000, 1.0, None), "extensible.wav": (3, 1, 48_000, 16, 96_000, 1.0, None),
        "large.wav": (1, 1, 48_000, 16, 96_000, 1.0, None), "cut.wav": (1, 1, 48_000, 16, 96_000, 1.0, None), "none.wav": (None,) * 6 + ("no_wave",), "empty.wav": (None,) * 6 + ("no_wave",),
        "bare.wav": (None, None, None, None, 96_000, None, "no_format"), "silent.wav": (1, 1, 8_000, 8, None, None, "no_data"),
    }
    read = lambda df: {r["path"].rsplit("/", 1)[1]: tuple(r)[2:] for r in df.collect()}
    assert read(spark.read.format("wav_facts").option("path", str(tmp_path)).option("suffix", ".WAV").load()) == want
    assert read(spark.read.format("wav_facts").option("path", f"file://{tmp_path}/a.wav").load()) == {"a.wav": want["a.wav"]}
    del want["empty.wav"]  # Spark's listing passes over files of no length
    assert read(wav.wav_facts(logs.files(spark, str(tmp_path), "*.wav"))) == want
    assert wav.read_facts(str(tmp_path / "gone.wav"))[-1] == "unreadable: FileNotFoundError"


def test_drift_of_matched_points(spark):
    from cutloom.operators import media

    fit = media.offset_and_drift(media.drift_fixture(spark, 500, 120.0, 35.0)).first()
    assert fit["offset_ms"] == pytest.approx(120, abs=1e-3) and fit["drift_ppm"] == pytest.approx(35, abs=1e-3) and fit["decision"] == "CORRECT"
