"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is logistic in the sum of its distinct words' weights; a document is toxic if any of its distinct
sentences is (noisy-or). Only document labels are known: the gradient of their likelihood says how much each sentence
answers for its document's label. A word has the features of its beginnings and of the whole word, hashed, so
inflected and compounded forms of a word share what was learnt of it.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.llm.common import ChunkCache, free_names

#: Labelled documents that the model is fitted on at most; fewer if there are fewer.
SAMPLE_DOCS = 8_000
#: Characters that these documents have together at most; those that come after in the order of the sample are not fitted.
SAMPLE_CHARS = 100_000_000
HASH_BITS = 18
#: Beginnings of a word that are features, in characters.
SHORTEST, LONGEST = 3, 10
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 3
STEPS, RATE, L1 = 150, 0.1, 5e-5
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
CACHE_CHUNKS = 300_000

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """The hashed features of a lower-case word."""
    parts = [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
    return [zlib.crc32(p.encode()) >> (32 - HASH_BITS) for p in [*parts, f"{word} "]]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


class ChunkScores(ChunkCache):
    """The summed word weights of a chunk between spaces."""

    def __init__(self, model: Model, most: int = CACHE_CHUNKS):
        super().__init__(most)
        self.model = model

    def make_new(self, chunk: str) -> float:
        return sum(map(self.model.word, LETTERS.findall(chunk.lower())))


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Word of each occurrence, its sentence, the document of each sentence, and the words."""
    words: dict[str, int] = {}
    word_of, sizes, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for sentence in dict.fromkeys(x.strip() for x in SENTENCE.findall(text.lower())):
            if found := [w for chunk in dict.fromkeys(sentence.split()) for w in LETTERS.findall(chunk)]:
                word_of.extend(words.setdefault(w, len(words)) for w in found)
                sizes.append(len(found))
                doc_of.append(d)
    flat = lambda numbers: np.array(numbers, np.int32)
    return flat(word_of), np.repeat(np.arange(len(sizes), dtype=np.int32), flat(sizes)), flat(doc_of), list(words)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """The model that makes the document labels likely, with an L1 penalty on its weights; the same for the same rows in any order of a run."""
    word_of, sentence_of, doc_of, words = bags(texts)
    n_docs, n_sentences, n_words = len(texts), len(doc_of), len(words)
    weights = np.zeros(1 << HASH_BITS)
    if not n_sentences or not 0 < toxic.sum() < n_docs:  # nothing to learn: the base rate for every sentence
        rate = (toxic.sum() + 0.5) / (n_docs + 1)
        return Model(weights, math.log(rate / (1 - rate)) - math.log(max(1.0, n_sentences / max(1, n_docs))))
    flat, sizes = array("i"), array("i")
    for word in words:
        own = features(word)
        flat.extend(own)
        sizes.append(len(own))
    feature_word = np.repeat(np.arange(n_words, dtype=np.int32), np.array(sizes, np.int32))
    feature, back = np.unique(np.array(flat, np.int32), return_inverse=True)
    # documents of each feature, counted once a document
    in_doc = np.unique(doc_of[sentence_of].astype(np.int64) * n_words + word_of)
    word_docs = np.bincount(in_doc % n_words, minlength=n_words)
    seen = np.bincount(back, weights=word_docs[feature_word], minlength=len(feature))
    keep = seen >= LEAST_DOCS
    number = np.cumsum(keep) - 1
    used = keep[back]
    feature_word, back, feature = feature_word[used], number[back[used]], feature[keep]
    n = len(feature)
    w, b = np.zeros(n), math.log(toxic.mean() / (1 - toxic.mean())) - math.log(n_sentences / n_docs)
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):
        word_score = np.bincount(feature_word, weights=w[back], minlength=n_words)
        z = b + np.bincount(sentence_of, weights=word_score[word_of], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
        pull = np.where(toxic == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)  # of a document on its sentences
        grad_z = pull[doc_of] * p / n_docs
        grad_word = np.bincount(word_of, weights=grad_z[sentence_of], minlength=n_words)
        grad, grad_b = np.bincount(back, weights=grad_word[feature_word], minlength=n), grad_z.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        size = RATE / (np.sqrt(v / fix2) + 1e-5)
        w += size * (m / fix)
        w = np.sign(w) * np.maximum(np.abs(w) - size * L1, 0)  # the penalty's proximal step
        b += RATE / (math.sqrt(vb / fix2) + 1e-5) * (mb / fix)
    weights[feature] = w
    return Model(weights, float(b))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The model fitted on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of their id, as many of them as have
    ``sample_chars`` characters together at most.

    Rows with a null doc_id, text or label are no examples; of repeated rows each is one; ties of the hash go by doc_id, text and label. Without
    examples of both labels the model gives every document the base rate. Whole texts are fitted. The model is fitted when the function is called.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "toxic")
    there = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct()
    chosen = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # a bounded table
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    # bounded in rows, then over those in characters
    order = ["_hash", "doc_id", "text", "toxic"]
    first = rows.withColumn("_hash", F.xxhash64("doc_id")).where(F.char_length("text") <= sample_chars).orderBy(*order).limit(sample)
    up_to = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = first.withColumn("_chars", F.sum(F.char_length("text")).over(up_to)).where(F.col("_chars") <= sample_chars).select("text", "toxic")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        texts = [t for b in whole for t in b.column("text").to_pylist()]
        model = fit(texts, np.array([t for b in whole for t in b.column("toxic").to_pylist()], np.int64))
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict({"feature": pa.array([used.tolist()], pa.list_(pa.int32())), "weight": pa.array([model.weights[used].tolist()], pa.list_(pa.float64())), "bias": [model.bias]})

    # one task fits the model to a sample of bounded size; its weights, at most 2 ** HASH_BITS, come to the driver
    found = held.coalesce(1).mapInArrow(fitted, "feature array<int>, weight array<double>, bias double").first()
    weights = np.zeros(1 << HASH_BITS)
    if found is None:
        return fit([], np.zeros(0, np.int64))
    weights[found["feature"]] = found["weight"]
    return Model(weights, found["bias"])


def sentence_scores(text: str, chunks: ChunkScores) -> list[tuple[int, int, float]]:
    """(start, end, log-odds) of each sentence, without the blanks around it. A word counts once in a sentence."""
    bias, known, out = chunks.model.bias, {}, []
    for found in SENTENCE.finditer(text):
        said = found[0].strip()
        if not said:
            continue
        if (z := known.get(said)) is None:
            known[said] = z = bias + sum(map(chunks.__getitem__, dict.fromkeys(said.split())))
        start = found.start() + found[0].index(said)
        out.append((start, start + len(said), z))
    return out


def noisy_or(text: str, sentences: list[tuple[int, int, float]]) -> float:
    """The chance that any of the distinct sentences is toxic; 0 without sentences."""
    distinct = {text[a:e]: z for a, e, z in sentences}
    return 1 - math.exp(-sum(z if z > 30 else math.log1p(math.exp(z)) for z in distinct.values()))


def scored(documents: DataFrame, model: Model, threshold: float = THRESHOLD, score: str = "score", offending: str = "offending") -> DataFrame:
    """``documents`` with columns ``score`` (0 to 1) and ``offending``: array of (start, end, score) of the sentences that reach ``threshold`` alone, one that
    just reaches it too.

    Null, empty and wordless texts score 0; whole texts are read; repeated rows score alike; an empty table stays
    empty; other columns pass through (ones with the two names are replaced; ask for other names to keep them).
    """
    (judged,) = free_names(documents, "judged")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS weights, whatever the input
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])
    least = math.log(threshold / (1 - threshold))

    @F.arrow_udf(kind)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = ChunkScores(shared.value)
        for batch in batches:
            rows = []
            for text in batch:
                said = text.as_py() or ""
                sentences = sentence_scores(said, chunks)
                bad = [{"start": a, "end": e, "score": 1 / (1 + math.exp(-min(z, 30)))} for a, e, z in sentences if z >= least]
                rows.append({"score": noisy_or(said, sentences), "offending": bad})
            yield pa.array(rows, pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]))

    both = documents.withColumn(judged, judge(F.col("text")))
    return both.withColumn(score, F.col(judged)["score"]).withColumn(offending, F.col(judged)["offending"]).drop(judged)


def toxicity_report(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE_DOCS) -> DataFrame:
    """For each row: doc_id, held_out, score, predicted (1 from ``threshold`` on), n_offending (sentences that reach ``threshold`` alone).

    Null, empty and wordless texts score 0; rows without an id are in the fold of an empty one; repeated rows score alike; an empty table gives no
    rows; other columns are ignored."""
    judged = scored(documents.select("doc_id", "text"), learn(documents, labels, sample), threshold)
    return judged.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("offending").cast("bigint").alias("n_offending"))
