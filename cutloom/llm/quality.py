"""Quality rules: counts over words and lines, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams (tokens and pairs of neighbouring tokens, in lower
case): one of the trusted documents, one of the whole corpus. A document's score is the mean log
ratio of its n-grams, so length does not matter; every document is held against one fixed threshold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm.arrays import WORD, at, indices, let, run_starts

BUCKETS = 10_000
THRESHOLD = -0.3
#: Bits of the Bloom filter of trusted ids: 8 MB to every executor, whatever the input.
FILTER_BITS = 1 << 26
MIN_WORDS = 50
#: More repeated words than this share (in percent) fail.
MAX_REPEATED = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
#: Letters, digits or other signs in a row.
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+"


def ngrams(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's tokens and neighbouring pairs of tokens."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: F.concat(F.transform(t, lambda x: bucket(x)), F.transform(indices(F.size(t) - 1), lambda i: bucket(at(t, i), at(t, i + 1)))))


def bloom_bits(ids: DataFrame) -> DataFrame:
    """(page, bits) of a Bloom filter of FILTER_BITS bits over ``ids`` (doc_id): at most FILTER_BITS / 32,768 rows of 4 kB, whatever the input."""
    places = ids.select(F.explode(F.array(*filter_places(F.col("doc_id")))).alias("place")).withColumn("page", F.expr("place div 32768"))
    # places are moved, not each task's bits of all pages
    return places.repartition("page").groupBy("page").agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))


def filter_places(doc_id: Column) -> list[Column]:
    """The two bits of an id."""
    return [F.pmod(F.xxhash64(doc_id, F.lit(i)), F.lit(FILTER_BITS)) for i in (1, 2)]


def maybe_trusted(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) whose id may be among ``ids``: all that are, and few others while the filter is not full."""
    pages, found = F.broadcast(bloom_bits(ids)), documents
    for i, place in enumerate(filter_places(F.col("doc_id"))):
        found = found.withColumn("_place", place)
        found = found.join(pages.select(F.col("page").alias("_page"), F.col("bits").alias("_bits")), F.expr("_place div 32768") == F.col("_page"))
        byte = F.conv(F.hex(F.substring("_bits", (F.expr("(_place % 32768) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found.where(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1).select(*documents.columns)
    return found


def log_ratios(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket: ``trusted`` (doc_id) documents against all.

    All documents and all trusted ids count. All documents are counted where they lie; for the trusted counts only texts that pass a Bloom filter
    of the trusted ids are moved, to be merged with the ids, which decide. ``buckets`` numbers come to the driver, whatever the
    input. All zero where no document is trusted. The counts are taken when the function is called.
    """
    known = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    text = documents.select("doc_id", "text").where("text IS NOT NULL")
    counted = lambda df: {r["b"]: r["count"] for r in df.select(F.explode(ngrams(F.col("text"), buckets)).alias("b")).groupBy("b").count().collect()}
    raw_counts = counted(text)
    target_counts = counted(maybe_trusted(text.where("doc_id IS NOT NULL"), known).join(known.hint("merge"), "doc_id", "left_semi"))
    raw, target = ([counts.get(b, 0) for b in range(buckets)] for counts in (raw_counts, target_counts))
    if not sum(target):
        return [0.0] * buckets
    # the trusted counts are smoothed towards the corpus by one count a bucket: without evidence the ratio is 0
    whole, good = sum(raw), sum(target) + buckets
    return [math.log((t * whole / r + buckets) / good) if r else 0.0 for t, r in zip(target, raw, strict=True)]


def score(text: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a text's n-grams; 0 for a text without any."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    return let(ngrams(text, len(ratios)), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda total, b: total + F.get(table, b)) / F.size(g)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which the text has twice or more."""

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        of_run = lambda starts: F.flatten(F.transform(starts, lambda s, j: F.when(F.coalesce(at(starts, j + 1), n) - s > 1, F.transform(F.slice(pairs, s + 1, F.coalesce(at(starts, j + 1), n) - s), lambda p: p["i"])).otherwise(F.array().cast("array<int>"))))
        places = F.sort_array(let(run_starts(pairs, n), of_run))
        return let(places, lambda p: F.aggregate(indices(F.size(p)), F.lit(0).cast("bigint"), lambda total, j: total + F.least(F.lit(window), F.coalesce(at(p, j + 1) - at(p, j), F.lit(window)))))

    hashes = F.transform(indices(F.size(words) - (window - 1)), lambda i: F.xxhash64(*(at(words, i + j) for j in range(window))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)))


def quality_report(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    ``trusted`` has the doc_ids of trusted documents (null and repeated ids count once or not at all). A null text
    counts as empty and fails the base rules, as do texts under MIN_WORDS words. A score equal to the threshold is kept.
    Rows with one doc_id each give a row, very long texts are read whole; an empty table gives an empty result; other columns are ignored.
    """
    ratios = log_ratios(documents, trusted, buckets)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        score(F.col("text"), ratios).alias("llr"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")
