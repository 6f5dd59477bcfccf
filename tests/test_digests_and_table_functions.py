"""Digest trees against whole comparisons, and table functions against plain loops."""

from __future__ import annotations

import hashlib
import inspect
import random

import pytest
from pyspark.sql import functions as F

from cutloom.functions import table_functions
from cutloom.operators import digests
from cutloom.operators.lake import changed


def stored(spark, tmp_path, name, rows, files=1):
    path = str(tmp_path / name)
    return path, digests.store_run(spark.createDataFrame(rows, "case_id long, auto_cut boolean"), path, "case_id", files)


def test_runs_are_compared_by_going_down(spark, tmp_path):
    old = [(i, i % 3 == 0) for i in range(2000)]
    new = [(i, v != (i in (7, 500, 1999))) for i, v in old if i not in (11, 12)] + [(5000, True)]
    (a, root_a), (b, root_b), (c, root_c) = stored(spark, tmp_path, "a", old), stored(spark, tmp_path, "b", new), stored(spark, tmp_path, "c", random.Random(1).sample(old, 2000), 3)
    assert root_a == root_c != root_b and root_a == digests.root(spark, a)
    got = digests.compared(spark, a, b, "case_id", "auto_cut")
    kinds = {r["case_id"]: r["change"] for r in got.collect()}
    whole = changed(*(spark.read.parquet(f"{p}/rows").drop("part") for p in (a, b)), "case_id", "auto_cut").where("change <> 'same'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and kinds == {7: "changed", 500: "changed", 1999: "changed", 11: "removed", 12: "removed", 5000: "added"}
    trees = [spark.read.parquet(f"{p}/tree") for p in (a, b)]
    parts = digests.unequal(*trees)
    keys = spark.createDataFrame([(k,) for k in kinds], "k long").select(digests.key_range(F.col("k")).alias("p")).distinct().collect()
    assert parts == sorted(r["p"] for r in keys)  # no range is opened that holds no change
    plan = digests.rows_of(spark, a, parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan  # the other ranges' folders are not opened
    assert digests.compared(spark, a, c, "case_id", "auto_cut").count() == 0


def test_an_empty_run_and_a_run_that_is_there(spark, tmp_path):
    (a, none), (b, _) = stored(spark, tmp_path, "a", []), stored(spark, tmp_path, "b", [(1, True), (2, None)])
    assert none is None
    assert sorted(map(tuple, digests.compared(spark, a, b, "case_id", "auto_cut").collect())) == [(1, None, True, "added"), (2, None, None, "added")]
    with pytest.raises(Exception, match="(?i)exists"):
        stored(spark, tmp_path, "b", [(1, True)])


def test_every_table_function_is_registered(spark):
    """A function that a module defines and the list lacks, or that SQL doesn't know after ``register``, fails."""
    made = {name.lower() for name, x in inspect.getmembers(table_functions) if type(x).__name__ == "UserDefinedTableFunction"}
    assert made == {*table_functions.register(spark)}
    for name in made:
        assert spark.catalog.functionExists(name) or spark.sql(f"DESCRIBE FUNCTION {name}").count()


def test_clauses_and_frames(spark):
    pick = random.Random(2)
    words, want = [], []
    for key in ("a", "b", "c"):
        t, open_ = 0, []
        for pos in range(1, 80):
            word, pause = pick.choice(["we", "go.", "so?", "", None, "now"]), pick.choice([0, 100, 600, 900])
            start, end = t + pause, t + pause + 80
            start = None if pick.random() < 0.05 else start
            if open_ and start is not None and start - open_[-1][4] >= 600:
                want.append(open_)
                open_ = []
            open_.append((key, pos, word, start, end))
            if (word or "").endswith((".", "?", "!")):
                want.append(open_)
                open_ = []
            t = end
            words.append((key, pos, word, start, end))
        if open_:
            want.append(open_)
    table_functions.register(spark)
    df = spark.createDataFrame(pick.sample(words, len(words)), "key string, pos long, word string, start long, end long")
    got = spark.sql("SELECT * FROM clauses(TABLE({df}) PARTITION BY key ORDER BY pos)", df=df).collect()
    assert sorted((r["key"], r["first_pos"], r["last_pos"], r["start"], r["end"], r["words"]) for r in got) == sorted((c[0][0], c[0][1], c[-1][1], c[0][3], c[-1][4], [w[2] for w in c]) for c in want)
    assert all(sorted(r["clause"] for r in got if r["key"] == k) == list(range(sum(c[0][0] == k for c in want))) for k in "abc")
    framed = spark.sql("SELECT * FROM frames(TABLE({df}))", df=df).collect()
    plain = [(k, f, min(e, f * 100 + 100) - max(s, f * 100)) for k, _, _, s, e in words if s is not None for f in range(s // 100, -(-e // 100))]
    assert sorted(map(tuple, framed)) == sorted(plain)


def test_few_ranges_meet_in_one_task(spark):
    """The 32 ranges of a run are written by more tasks than the session's eight, a fifth of the rows in one at most."""
    dealt = digests.by_range(spark.range(20_000).toDF("case_id"), "case_id", 1, 5)
    sizes = [len(part) for part in dealt.rdd.glom().collect()]
    assert len(sizes) == 128 and sum(sizes) == 20_000 and max(sizes) < 4_000
    # sums of 32-bit parts as longs give what decimals gave
    one = spark.createDataFrame([(1, True), (1, True), (1, False)], "case_id long, auto_cut boolean")
    hashes = [hashlib.sha256(f'{{"auto_cut":{x},"case_id":1}}'.encode()).hexdigest() for x in ("true", "true", "false")]
    sums = [str(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes)) for i in range(8)]
    assert [(r["n"], r["sha256"]) for r in digests.leaves(one, "case_id").collect()] == [(3, hashlib.sha256(":".join(["3", *sums]).encode()).hexdigest())]
