import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from cutloom.llm import toxicity
from cutloom.tables import table


def test_finds_the_sentence_that_labels_only_hint_at(spark):
    pick = random.Random(0)
    plain = [f"word{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(400):
        sentences = [" ".join(pick.choices(plain, k=8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            sentences[2] = f"you {pick.choice(['grobian', 'grobianer', 'lump'])} there"
        texts.append(". ".join(sentences))
        toxic.append(int(bad))
    model = toxicity.fit(texts, np.array(toxic))
    chunks = toxicity.ChunkScores(model)
    for text, bad in zip(texts[:80], toxic, strict=False):
        found = toxicity.sentence_scores(text, chunks)
        assert (toxicity.noisy_or(text, found) >= 0.3) == bool(bad)
        if bad:
            a, e, _ = max(found, key=lambda x: x[2])
            assert text[a:e].startswith("you ")
    assert toxicity.noisy_or("you grobianisch", toxicity.sentence_scores("you grobianisch", chunks)) > 0.3  # shares its beginning


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").where("toxic IS NOT NULL")
    report = toxicity.toxicity_report(table(spark, sf, "documents"), labels)
    rows = report.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9


def test_held_out_labels_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(toxicity.toxicity_report(docs, labels)) == key(toxicity.toxicity_report(docs, flipped))


def test_odd_documents(spark, odd, nothing):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(odd, labels).collect()
    assert len(rows) == odd.count()
    same = {}
    for r in rows:
        assert 0 <= r["score"] <= 1
    model = toxicity.learn(odd, labels)
    judged = toxicity.scored(odd, model)
    assert judged.columns == odd.columns  # it has both names already
    clashing = odd.selectExpr("*", "concat('j', n_chars) AS __judged", "concat('k', n_chars) AS _judged")
    named = toxicity.scored(clashing, model, score="s", offending="o")
    assert named.columns == [*clashing.columns, "s", "o"]
    plain = lambda df, *also: sorted((repr(tuple(r)) for r in df.select(*clashing.columns, *also).collect()))
    assert plain(named) == plain(clashing)
    for r in judged.collect():
        assert same.setdefault(r["text"], r["score"]) == r["score"]
        if not (r["text"] or "").strip():
            assert r["score"] == 0
    assert toxicity.toxicity_report(nothing, labels).count() == 0
    assert toxicity.toxicity_report(odd, labels.limit(0)).count() == odd.count()


def plain_score(text, weight, bias):
    """Noisy-or over distinct sentences by plain loops; ``weight`` gives a feature's weight."""
    clean = 1.0
    for sentence in {s.strip() for s in re.split(r"[.!?\n]+", text or "")} - {""}:
        z = bias
        for chunk in set(sentence.split()):
            for word in re.findall(r"[^\W\d_]+", chunk.lower()):
                z += sum(weight.get(zlib.crc32(part.encode()) >> 14, 0.0) for part in [*(word[:n] for n in range(3, min(len(word), 10) + 1)), word + " "])
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_a_plain_noisy_or(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.learn(docs, table(spark, sf, "labels"))
    weight = {i: w for i, w in enumerate(model.weights) if w}
    assert len(weight) > 20
    for r in toxicity.scored(docs, model).collect():
        assert abs(r["score"] - plain_score(r["text"], weight, model.bias)) < 1e-6


def test_the_steps_follow_the_likelihood(monkeypatch):
    """Fitting with the gradient of a plain likelihood, taken by differences, comes to the same weights."""
    for name, value in (("STEPS", 3), ("LEAST_DOCS", 1)):
        monkeypatch.setattr(toxicity, name, value)
    texts, toxic = ["aba lump. cde fgh", "cde fgh aba", "lump! aba. cde", "fgh fgh. cde", "aba cde"], np.array([1, 0, 1, 0, 0])
    got = toxicity.fit(texts, toxic)
    names = sorted({f for t in texts for w in re.findall(r"\w+", t) for f in toxicity.features(w)})
    n_sentences = sum(len({s.strip() for s in re.split(r"[.!?]", t)} - {""}) for t in texts)
    x = np.r_[np.zeros(len(names)), math.log(toxic.mean() / (1 - toxic.mean())) - math.log(n_sentences / len(texts))]

    def likelihood(x):
        scores = [plain_score(t, dict(zip(names, x)), x[-1]) for t in texts]
        return np.mean([math.log(s if t else 1 - s) for s, t in zip(scores, toxic)])

    m, v = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, 4):
        grad = np.array([(likelihood(x + d) - likelihood(x - d)) / 2e-6 for d in np.eye(len(x)) * 1e-6])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        size = toxicity.RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        x = x + size * m / (1 - 0.9**step)
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - size[:-1] * toxicity.L1, 0)
    assert np.allclose(got.weights[names], x[:-1], atol=1e-4) and abs(got.bias - x[-1]) < 1e-4
