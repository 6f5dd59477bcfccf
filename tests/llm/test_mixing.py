import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cutloom.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "w " * (1 + i % 13), "big" if i % 3 else f"s{i % 4}") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def tokens(corpus):
    got = Counter()
    for r in corpus.collect():
        got[r["source"]] += len(r["text"].split())
    return got


def test_flattest_mixture_under_the_limit(corpus):
    total = tokens(corpus)
    mix = mixing.mixture(mixing.counted(corpus), max_repeats=3.0)
    plan = {r["source"]: r for r in mix.sources.collect()}
    assert sum(r["weight"] for r in plan.values()) == pytest.approx(1)
    share = {s: n / sum(total.values()) for s, n in total.items()}
    norm = sum(p**mix.exponent for p in share.values())
    for s, r in plan.items():
        assert r["weight"] == pytest.approx(share[s] ** mix.exponent / norm)
        assert r["quota"] >= total[s] * 0.999999
    assert max(r["quota"] / r["tokens"] for r in plan.values()) == pytest.approx(3, abs=0.01)


def test_target_entropy(corpus):
    share = [n / sum(tokens(corpus).values()) for n in tokens(corpus).values()]
    natural, flat = -sum(p * math.log(p) for p in share), math.log(len(share))
    target = (natural + flat) / 2
    weights = [r["weight"] for r in mixing.mixture(mixing.counted(corpus), None, target).sources.collect()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(target, abs=1e-4)
    assert mixing.mixture(mixing.counted(corpus), None, natural / 2).exponent == 1
    assert mixing.mixture(mixing.counted(corpus), None, flat * 2).exponent == 0


def test_blocks_hold_sources_by_weight(corpus):
    rows = mixing.mix_blocks(corpus, max_repeats=3.0, block_tokens=2000).collect()
    plan = {r["source"]: r for r in mixing.mixture(mixing.counted(corpus), 3.0).sources.collect()}
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["n_tokens"]
    for s, n in taken.items():
        assert 0 <= n - plan[s]["quota"] < 13  # whole documents: over by less than one
    blocks = Counter((r["block"], r["source"]) for r in rows)
    n = len({b for b, _ in blocks})
    assert n == -(-sum(r["quota"] for r in plan.values()) // 2000)
    for b in range(n):
        own = sum(r["n_tokens"] for r in rows if r["block"] == b and r["source"] == "big")
        assert own == pytest.approx(plan["big"]["quota"] / n, abs=14)
        assert sorted(r["position"] for r in rows if r["block"] == b) == list(range(1, sum(c for (x, _), c in blocks.items() if x == b) + 1))
    each = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert set(each.values()) == {1} and {d for d, _ in each} == set(range(900))


def test_copies_follow_the_blocks(corpus):
    copies = Counter(r["doc_id"] for r in mixing.mixed(corpus, 3.0).collect())
    assert copies == Counter(r["doc_id"] for r in mixing.mix_blocks(corpus, 3.0).collect())


def test_budget_can_leave_documents_out(corpus):
    rows = mixing.mix_blocks(corpus, None, None, budget=1000).collect()
    assert 1000 <= sum(r["n_tokens"] for r in rows) < 1000 + 5 * 13


def test_salted_plan_gives_the_same(corpus, monkeypatch):
    want = Counter(r["doc_id"] for r in mixing.mixed(corpus, 2.0).collect())
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert Counter(r["doc_id"] for r in mixing.mixed(corpus, 2.0).collect()) == want


def test_odd_documents(odd, nothing):
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns
    want, got = Counter(map(tuple, odd.collect())), Counter(map(tuple, kept.collect()))
    assert set(want) == set(got) and all(got[k] >= n for k, n in want.items())
    assert {r["source"] for r in mixing.mix_blocks(odd).collect()} == {"", "s0", "s1", "s2"}
    assert mixing.mix_blocks(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    blank = odd.where("text IS NULL")
    assert mixing.mixed(blank).count() == blank.count()
    assert mixing.mix_blocks(odd.withColumn("text", F.lit(None).cast("string"))).count() == odd.count()


def test_clashing_names(corpus):
    docs = corpus
    for name in ("_of", "_full", "_last", "_copies", "_copy", "__full", "_salt"):
        docs = docs.withColumn(name, F.lit(1))
    assert mixing.mixed(docs, 2.0).count() == mixing.mixed(corpus, 2.0).count()


def test_rows_without_an_id_are_dealt_like_others(spark):
    rows = [(None, "w " * (1 + i % 3), "a") for i in range(60)] + [(i, "w w", "b") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix_blocks(docs, max_repeats=2.0, block_tokens=20).collect()
    assert sum(r["source"] == "a" for r in found) == 60 and sum(r["source"] == "b" for r in found) == 10
    assert all(sum(r["n_tokens"] for r in found if r["block"] == b) <= 30 for b in {r["block"] for r in found})
