"""Patterns, exact quantiles and the similarity index against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom.operators import patterns, quantiles, rules, similar
from cutloom.tables import table


def test_patterns_are_a_like_join(spark, sf):
    pick = random.Random(1)
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").limit(60).collect()] + [(900, None), (901, ""), (902, "aaa é東京東 x"), (902, "aaa")]
    made = {t[i : i + pick.randint(1, 9)] for _, t in texts for i in [pick.randrange(max(1, len(t or "")))] for _ in range(40) if t} | {"aa", "a", "東京", "é", "nowhere at all", "", None}
    while len(made) < 10_000:
        made.add("".join(pick.choices("abcdefghij klmnop", k=pick.randint(2, 4))))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame([(p,) for p in [*made, "aa"]], "pattern string")
    want = sorted((d, p) for d, t in texts for p in made if t and p and p in t)
    for most in (patterns.MOST_CHARS, 9_000):  # in one automaton, and dealt out over several
        assert sorted(map(tuple, patterns.pattern_hits(docs, known, ["doc_id"], most_chars=most).collect())) == want
    assert patterns.pattern_hits(docs, known.limit(0), ["doc_id"]).count() == 0


def test_rules_with_patterns_need_a_hit(spark):
    cases = spark.createDataFrame([(1, "uh", "few", "host", "well I mean it"), (2, "no", "few", "guest", "I mean"), (3, "no", "few", "host", None), (4, "no", "many", "host", "nothing")], "case_id long, token string, reason string, context string, text string")
    made = [("pattern", [], ["few"], ["I mean"], None, "keep", 1, None), ("token", ["uh"], [], [], None, "cut", 9, None), ("reason", [], ["few"], [], None, "ask", 5, None), ("context", [], [], ["mean"], "guest", "keep", 7, None), ("neither", None, ["few"], ["absent"], None, "cut", 99, None)]
    known = spark.createDataFrame(made, "rule_id string, tokens array<string>, reasons array<string>, patterns array<string>, context string, verdict string, priority int, ts string")
    found = [(r["case_id"], r["rule_id"], r["exact"], r["place"]) for r in rules.matched_rules(cases, known, 3).orderBy("case_id", "place").collect()]
    assert found == [(1, "token", True, 1), (1, "pattern", True, 2), (1, "reason", False, 3), (2, "context", True, 1), (2, "pattern", True, 2), (2, "reason", False, 3), (3, "reason", False, 1)]


@pytest.mark.parametrize("cells", [2, 16, 4096])
def test_exact_quantiles(spark, cells):
    pick = random.Random(cells)
    rows = [("hot", pick.choice([pick.random() * 1e9, 5.0, -3.25, pick.random()])) for _ in range(3000)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("ties", 7.0), ("ties", 7.0), ("none", None), ("hot", float("nan")), ("hot", None)]
    shares = {"low": 0.0, "p25": 0.25, "median": 0.5, "p999": 0.999, "top": 1.0}
    found = {r["k"]: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", shares, cells).collect()}
    assert set(found) == {"hot", "one", None, "ties"}
    for k, r in found.items():
        own = [v for c, v in rows if c == k and v is not None and not math.isnan(v)]
        assert r["n"] == len(own)
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.quantile(own, share), rel=1e-12, abs=1e-12)


def test_quantiles_of_whole_numbers_and_without_classes(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_CLASSES", 0)  # rows meet their intervals in a plain join
    values = [3 * 10**15 + i * i for i in range(500)]
    row = quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v long"), [], "v", {"m": 0.5}, 8).first()
    assert (row["n"], row["m"]) == (500, (values[249] + values[250]) / 2)
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v long"), [], "v", {"m": 0.5}).count() == 0


def made_cases(n=3000, seed=2):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(25, 16))
    vectors = centres[pick.integers(0, 25, n)] + 0.35 * pick.normal(size=(n, 16))
    rows = [(i, int(i % 3), v.tolist()) for i, v in enumerate(vectors)]
    return [*rows, (n, 0, [0.0] * 16), (n + 1, 0, None), (n + 2, None, rows[5][2]), (n + 3, 2, rows[5][2]), (n + 4, 2, rows[5][2]), (n + 5, 1, [1.0, 2.0])]


def brute(rows, queries, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    held = [(i, b, unit(v)) for i, b, v in rows if v is not None and len(v) == 16 and any(v)]
    out = {}
    for q, b, v in held:
        if q in queries and b is not None:
            alike = sorted((-round(float(v @ w), 10), i) for i, c, w in held if c == b and i != q)
            out[q] = [i for _, i in alike[:k]]
    return out


@pytest.fixture(scope="module")
def cases(spark):
    rows = made_cases()
    return rows, spark.createDataFrame(rows, "id long, b int, embedding array<double>").repartition(5).cache()


def test_the_index_finds_most_and_with_bounds_all(spark, cases, monkeypatch):
    rows, df = cases
    monkeypatch.setattr(similar, "PART_ROWS", 40)  # crowded cells are dealt into parts
    index = similar.built(df, "b", cells=40)
    assert index.lists.count() == 3000 + 3 and index.cells.agg(F.max("parts")).first()[0] > 1
    queries = df.where("id % 20 = 0 OR id >= 3000")
    want = brute(rows, {r["id"] for r in queries.collect()}, 5)
    gathered = lambda found: {q: [x[1] for x in sorted((r["place"], r["case_id"]) for r in rs)] for q, rs in _by(found.collect()).items()}
    exact = gathered(similar.similar(queries, index, "b", probes=2, exact=True))
    assert exact == want
    near = gathered(similar.similar(queries, index, "b", probes=8))
    recall = sum(len({*near.get(q, [])} & {*ids}) for q, ids in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall_on_the_given_vectors(spark):
    """Against the exact search on the largest table: at least 0.9 of the five most similar, in as many cells as other queries need for 0.95."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("all"), "embedding")
    index, queries = similar.built(df, "all"), df.where("id % 100 = 0")
    pairs = lambda found: {(r["query_id"], r["case_id"]) for r in found.collect()}
    want = pairs(similar.similar(queries, index, "all", exact=True))
    probes = similar.probes_for(df.where("id % 100 = 50"), index, "all")
    assert 1 <= probes < len(index.centroids)
    assert len(pairs(similar.similar(queries, index, "all", probes=probes)) & want) >= 0.9 * len(want)


def test_few_and_no_cases(spark, cases):
    _, df = cases
    assert similar.similar(df.where("id < 3"), similar.built(df.limit(0), "b"), "b").count() == 0
    one = similar.built(df.where("id IN (3, 6)"), "b")
    assert [(r["query_id"], r["case_id"]) for r in similar.similar(df.where("id = 3"), one, "b", exact=True).collect()] == [(3, 6)]
    said = spark.createDataFrame([(6, "reject", "too short")], "id long, verdict string, note string")
    row = similar.remembered(similar.similar(df.where("id = 3"), one, "b"), said, -1.0).first()
    assert (row["n"], row["rejects"], row["notes"], row["priority"], row["match_reason"]) == (1, 1, ["too short"], "review_first", "near_case")
