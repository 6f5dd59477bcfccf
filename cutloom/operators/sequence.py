"""Words in order: tokens, neighbours, runs and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.frames import sliding
from cutloom.operators.running import same, with_running


def tokens(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a word: keys, pos (from 1), word. Words are what single spaces part; a null text has none."""
    return texts.select(*keys, F.posexplode(F.split(text, " ")).alias("p", "word")).select(*keys, (F.col("p") + 1).alias("pos"), "word")


def runs(words: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Chains of ``least`` or more equal neighbours: keys, word, start_pos, n. Row numbers by word keep their distance to positions along a chain."""
    by_word = Window.partitionBy(*keys, "word").orderBy("pos")
    islands = words.withColumn("island", F.col("pos") - F.row_number().over(by_word))
    return islands.groupBy(*keys, "word", "island").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


#: Positions of a slice of words.
WORDS = 4_096


def with_near_any(words: DataFrame, keys: list[str], out: str, test: Column, reach: int = 2, slice_width: int = WORDS) -> DataFrame:
    """``words`` (keys, pos, …) with boolean ``out``: whether any of the ``reach`` words before or after, the word itself aside, meets ``test``."""
    hit = F.max("_hit")
    found = sliding(words.withColumn("_hit", test.cast("int")), keys, "pos", slice_width, True, _before=(hit, -reach, -1), _after=(hit, 1, reach))
    return found.withColumn(out, F.coalesce(F.greatest("_before", "_after"), F.lit(0)) == 1).drop("_hit", "_before", "_after")


def with_neighbours(spans: DataFrame, keys: list[str], slice_width: int) -> DataFrame:
    """``spans`` (keys, start, end, id) with ``prev_end`` and ``next_start`` of the spans before and after of their keys; null at the ends.

    Neighbours are found within slices of time; only the first start and the last end of a slice go on to the slices beside it. Null starts come first and have no
    next; a null end is passed over for the one before.
    """
    cut = spans.withColumn("_slice", F.floor(F.col("start") / slice_width))
    along = Window.partitionBy(*keys, "_slice").orderBy("start", "id")
    own = cut.withColumns({"_prev": F.last("end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead("start").over(along)})
    last = F.max(F.when(F.col("end").isNotNull(), F.struct("start", "id", "end")))["end"]
    slices = cut.groupBy(*keys, "_slice").agg(F.min("start").alias("_first"), last.alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    beside = slices.select(*(F.col(k).alias(f"_k_{k}") for k in [*keys, "_slice"]), F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_first").over(order).alias("_after"))
    joined = own.join(beside, same(own, beside, [*keys, "_slice"], "_k_"))
    return joined.select(*spans.columns, F.coalesce("_prev", "_before").alias("prev_end"), F.when(F.col("start").isNotNull(), F.coalesce("_next", "_after")).alias("next_start"))


def gaps(spans: DataFrame, keys: list[str], slice_width: int) -> DataFrame:
    """``spans`` (keys, start, end, id) with gap_before and gap_after to the neighbours of a key; null at its ends."""
    found = with_neighbours(spans, keys, slice_width)
    return found.withColumns({"gap_before": F.col("start") - F.col("prev_end"), "gap_after": F.col("next_start") - F.col("end")}).drop("prev_end", "next_start")


def sentences(points: DataFrame, keys: list[str], gap: int, slice_width: int) -> DataFrame:
    """``points`` (keys, t, id) with ``sentence`` from 0: a new one begins where more than or just ``gap`` passes."""
    along = F.floor(F.col("t") / slice_width)
    swept = with_running(points, keys, ["t", "id"], along, _prev=("last", "t"))
    flagged = swept.withColumn("_new", F.when(F.col("t") - F.col("_prev") >= gap, 1).otherwise(0))
    counted = with_running(flagged, keys, ["t", "id"], along, _count=("sum", "_new"))
    return counted.withColumn("sentence", (F.coalesce("_count", F.lit(0)) + F.col("_new")).cast("bigint")).drop("_prev", "_new", "_count")


def around(words: DataFrame, keys: list[str], k: int, slice_width: int = WORDS) -> DataFrame:
    """``words`` with ``pre``, the k words before, and ``post``, the word and the k - 1 after it."""
    listed = F.collect_list("word")
    return sliding(words, keys, "pos", slice_width, True, pre=(listed, -k, -1), post=(listed, 0, k - 1))


def gathered_sentences(words: DataFrame, keys: list[str], slice_width: int = 1000) -> DataFrame:
    """Sentences of (keys, pos, word), each closed by a word that ends in a sign: keys, sentence (from 0), first_pos, last_pos, text, words.

    Sentence numbers are counted by slices of positions; a sentence is one value.
    """
    closes = F.when(F.substring("word", -1, 1).isin(".", "?", "!"), 1).otherwise(0)
    counted = with_running(words.withColumn("_closes", closes), keys, ["pos"], F.floor(F.col("pos") / slice_width), sentence=("sum", "_closes"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    found = counted.groupBy(*keys, F.coalesce("sentence", F.lit(0)).cast("bigint").alias("sentence")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.transform(ordered, lambda x: x["word"]).alias("words"))
    return found.withColumn("text", F.array_join("words", " "))


def sentences_by_gap(words: DataFrame, keys: list[str], gap: int, slice_width: int) -> DataFrame:
    """Sentences of timed words (keys, pos, word, start, end) that a pause of ``gap`` or more parts: keys, sentence (from 0), first_pos, last_pos, start, end, words.

    A pause is counted from the latest end so far. A word without times goes with the one before it.
    """
    along = F.floor(F.col("pos") / slice_width)
    heard = with_running(words, keys, ["pos"], along, _heard=("max", "end"))
    opened = heard.withColumn("_opens", F.when(F.col("start") - F.col("_heard") >= gap, 1).otherwise(0))
    counted = with_running(opened, keys, ["pos"], along, _before=("sum", "_opens"))
    number = (F.coalesce("_before", F.lit(0)) + F.col("_opens")).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return counted.groupBy(*keys, number.alias("sentence")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("start").alias("start"), F.max("end").alias("end"), F.transform(ordered, lambda x: x["word"]).alias("words"))


def sentence_restarts(sentences: DataFrame, keys: list[str], least: float = 0.75) -> DataFrame:
    """Sentences that share at least so much of both word sets with the sentence before: keys, sentence, overlap.

    The sentence before is found by its number, so no key's sentences are gathered.
    """
    before = sentences.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.col("sentence") + 1).alias("_k_sentence"), F.col("words").alias("_before"))
    both = sentences.join(before, same(sentences, before, [*keys, "sentence"], "_k_"))
    overlap = F.size(F.array_intersect("words", "_before")) / F.size(F.array_union("words", "_before"))
    return both.select(*keys, "sentence", overlap.alias("overlap")).where(F.col("overlap") >= least)
