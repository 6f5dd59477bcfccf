"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to owners. Documents are read once into blocks, each an inverted list of the items' terms for a few
thousand documents, with a part for each owner. Items travel in bundles: a bundle carries its terms, their weights and a
sparse accumulator of scores by item and document of a block, and meets the postings of one owner after another in a cogroup, which adds what
its terms give. All sums are integers, so their order does not matter. The last owner's stage keeps the best of each block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.common import written

#: Stages that a bundle passes, each with its own terms.
OWNERS = 4
#: Items of a bundle, about; documents and postings of a block, at most (a longer document is a block of its own).
BUNDLE_ITEMS, BLOCK_DOCS, BLOCK_POSTINGS = 64, 4_096, 2_000_000
#: Terms that items searched for together have at most, as tasks hold them; more items are searched for in several passes.
MOST_TERMS = 500_000
#: Terms of items, counted by item, up to which bundles are broadcast to the blocks.
MOST_ENTRIES = 2_000_000
#: Bytes of a text as they count: letters a to z for A to Z, a space for every ASCII sign that is neither letter nor digit.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
POSTINGS = ("tids", "counts", "docs", "tfs")


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and all other characters; null has none."""
    return text.translate(FOLD).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of ``items`` (item_id, text); rows of one id are one item."""

    @F.arrow_udf("array<string>")
    def listed(texts: pa.Array) -> pa.Array:
        return pa.array([[t.decode() for t in terms_of(x.as_py())] for x in texts], pa.list_(pa.string()))

    each = items.select("item_id", F.explode(listed(F.col("text").cast("binary"))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def owner_of(term: bytes, owners: int) -> int:
    return crc32(term) % owners


def block_schema(owners: int) -> str:
    parts = ", ".join(f"{name}{o} array<int>" for o in range(owners) for name in POSTINGS)
    return f"block string, n_docs long, n_terms long, doc_ids array<bigint>, lengths array<bigint>, {parts}"


def blocks(documents: DataFrame, vocabulary: list[bytes], owners: int) -> DataFrame:
    """The inverted blocks of ``documents`` for ``vocabulary``: n_docs with a term and their n_terms, ids and lengths of those with a term of the vocabulary, and
    for each owner its terms' numbers, how many documents have each, and these documents' places in the block and counts."""
    numbers = documents.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})
    owned = np.array([owner_of(t, owners) for t in vocabulary], np.int8)
    schema = pa.schema([("block", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "lengths")), *((f"{c}{o}", pa.list_(pa.int32())) for o in range(owners) for c in POSTINGS)])

    def packed(name: str, n_docs: int, n_terms: int, ids: list, lengths: list, tids: list, docs: list, tfs: list) -> pa.RecordBatch:
        tids, docs, tfs = (np.array(x, np.int32) for x in (tids, docs, tfs))
        row: dict = {"block": name, "n_docs": n_docs, "n_terms": n_terms, "doc_ids": ids, "lengths": lengths}
        order = np.lexsort((docs, tids))
        tids, docs, tfs = tids[order], docs[order], tfs[order]
        for o in range(owners):
            own = owned[tids] == o if len(tids) else np.zeros(0, bool)
            heads, counts = np.unique(tids[own], return_counts=True)
            row |= {f"tids{o}": heads, f"counts{o}": counts.astype(np.int32), f"docs{o}": docs[own], f"tfs{o}": tfs[own]}
        return pa.RecordBatch.from_pylist([row], schema)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, made = numbers.value, TaskContext.get().partitionId(), 0
        n_docs, n_terms, ids, lengths, tids, docs, tfs = 0, 0, [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                n_docs, n_terms, counts = n_docs + 1, n_terms + len(found), Counter(found)
                if shared := counts.keys() & known.keys():
                    tids += [known[t] for t in shared]
                    tfs += [counts[t] for t in shared]
                    docs += [len(ids)] * len(shared)
                    ids.append(doc_id.as_py())
                    lengths.append(len(found))
                if len(ids) >= BLOCK_DOCS or len(tids) >= BLOCK_POSTINGS:
                    yield packed(f"{task}-{made}", n_docs, n_terms, ids, lengths, tids, docs, tfs)
                    n_docs, n_terms, ids, lengths, tids, docs, tfs, made = 0, 0, [], [], [], [], [], made + 1
        if n_docs:
            yield packed(f"{task}-{made}", n_docs, n_terms, ids, lengths, tids, docs, tfs)

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(invert, block_schema(owners))


STATE = "bundle int, block string, items array<bigint>, tids array<int>, gains array<bigint>, acc_item array<int>, acc_doc array<int>, acc_score array<bigint>"
BEST = "item_id long, doc_id long, score long"


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each length, in whole numbers; in Python's where 64 bits might not do."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 25 + 75 * lengths * n_docs // n_terms


def column(table: pa.Table, name: str) -> np.ndarray:
    """The one row's array of a column."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def owner_stage(n_docs: int, n_terms: int, keep: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function that adds to a bundle's accumulator what an owner's postings of a block give. With ``keep`` it returns the best so many of each item,
    else the bundle as it travels on."""
    state = pa.schema([("bundle", pa.int32()), ("block", pa.string()), ("items", pa.list_(pa.int64())), ("tids", pa.list_(pa.int32())), ("gains", pa.list_(pa.int64())), ("acc_item", pa.list_(pa.int32())), ("acc_doc", pa.list_(pa.int32())), ("acc_score", pa.list_(pa.int64()))])
    best = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def add(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundle.num_rows or not postings.num_rows:
            return (best if keep else state).empty_table()
        items = bundle.column("items").combine_chunks().flatten().dictionary_encode(null_encoding="encode")
        names, item_at = items.dictionary.to_pylist(), items.indices.to_numpy()
        lengths = column(postings, "lengths")
        scores = np.zeros((len(names), len(lengths)), np.int64)
        scores[column(bundle, "acc_item"), column(bundle, "acc_doc")] = column(bundle, "acc_score")
        tids, docs, tfs = column(postings, "tids"), column(postings, "docs"), column(postings, "tfs").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(column(postings, "counts"))])
        gives = 1_000_000_000 * tfs // (1000 * tfs + 8 * damping(lengths, n_docs, n_terms)[docs])
        wanted, gains = column(bundle, "tids"), column(bundle, "gains")
        place = np.searchsorted(tids, wanted)
        for entry in np.flatnonzero((place < len(tids)) & (tids[np.minimum(place, len(tids) - 1)] == wanted)) if len(tids) else ():
            part = slice(ends[place[entry]], ends[place[entry] + 1])
            scores[item_at[entry], docs[part]] += gains[entry] * gives[part]
        if keep is None:
            at_item, at_doc = np.nonzero(scores)
            own = {c: bundle.column(c).combine_chunks().slice(0, 1) for c in ("bundle", "block", "items", "tids", "gains")}
            return pa.table([*own.values(), *(pa.array([x], t) for x, t in ((at_item.astype(np.int32), pa.list_(pa.int32())), (at_doc.astype(np.int32), pa.list_(pa.int32())), (scores[at_item, at_doc], pa.list_(pa.int64()))))], schema=state)
        ids, rows = postings.column("doc_ids").combine_chunks().flatten().to_pylist(), []
        for item, line in zip(names, scores, strict=True):
            docs = np.flatnonzero(line)
            if len(docs) > keep:  # ties with the last one stay until ids decide
                docs = docs[line[docs] >= np.partition(line[docs], -keep)[-keep]]
            by_id = sorted(docs, key=lambda d, line=line: (-line[d], ids[d] is None, ids[d] or 0))
            rows += [{"item_id": item, "doc_id": ids[d], "score": int(line[d])} for d in by_id[:keep]]
        return pa.Table.from_pylist(rows, best)

    return add


def searched(documents: DataFrame, terms: DataFrame, k: int, owners: int) -> DataFrame:
    """(item_id, doc_id, score): at least the best ``k`` documents of each item of ``terms`` (item_id, term, times), whose terms tasks can hold."""
    spark = documents.sparkSession
    vocabulary = sorted(r["term"].encode() for r in terms.select("term").distinct().collect())
    read = written(blocks(documents, vocabulary, owners), "search_blocks")
    every = F.arrays_zip(F.concat(*(F.col(f"tids{o}") for o in range(owners))).alias("tid"), F.concat(*(F.col(f"counts{o}") for o in range(owners))).alias("n"))
    held = written(read.select("block", F.explode(every).alias("x")).select("block", F.col("x")["tid"].alias("tid"), F.col("x")["n"].alias("n")), "search_terms")
    n_docs, n_terms = (int(x or 0) for x in read.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    numbers = spark.createDataFrame([(t.decode(), i) for i, t in enumerate(vocabulary)], "term string, tid int")
    weighed = held.groupBy("tid").agg(F.sum("n").alias("df")).withColumn("weight", weight).join(numbers, "tid")
    entries = written(terms.join(weighed, "term").select("item_id", "tid", (F.col("times") * F.col("weight")).alias("gain")), "search_entries")

    n_items, n_entries = entries.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("-"))), F.count("*")).first()
    dealt = entries.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // BUNDLE_ITEMS)))).cast("int"))
    pairs = written(held.join(dealt.select("tid", "bundle").distinct(), "tid").select("block", "bundle").distinct(), "search_pairs")
    own = F.sort_array(F.collect_list(F.struct("item_id", "tid", "gain")))
    bundles = dealt.groupBy("bundle").agg(own.alias("own")).select("bundle", *(F.col("own")[c].alias(n) for c, n in (("item_id", "items"), ("tid", "tids"), ("gain", "gains"))))
    travelling = pairs.join(F.broadcast(bundles) if n_entries <= MOST_ENTRIES else bundles, "bundle")
    state = travelling.select("bundle", "block", "items", "tids", "gains", *(F.array().cast(t).alias(c) for c, t in (("acc_item", "array<int>"), ("acc_doc", "array<int>"), ("acc_score", "array<bigint>"))))
    visits = pairs.select("block", F.col("bundle").alias("bundle"))  # a column of its own, apart from the travelling side's
    for o in range(owners):
        last = o == owners - 1
        met = read.select("block", "lengths", *(["doc_ids"] if last else []), *(F.col(f"{c}{o}").alias(c) for c in POSTINGS)).join(visits, "block")
        both = state.groupBy("bundle", "block").cogroup(met.groupBy("bundle", "block"))
        state = both.applyInArrow(owner_stage(n_docs, n_terms, k if last else None), BEST if last else STATE)
    return state


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, owners: int = OWNERS) -> DataFrame:
    """The ``k`` best of ``documents`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank from 1, doc_id, score.

    Equal scores rank by ascending id, null ids last; documents with a score of 0 are left out, and so are items without any other. Null and empty texts have no
    terms; rows of one item id are one item; a document that comes twice is ranked twice; very long texts are read whole; empty tables give no rows; other columns
    are ignored. Items whose terms are more than MOST_TERMS are searched for in several passes over the documents; a single item has its own terms in
    memory in any case. Calling it reads the documents and writes their blocks to the shared folder.
    """
    terms = written(item_terms(items), "search_items")
    passes = -(-terms.agg(F.count_distinct("term")).first()[0] // MOST_TERMS) or 1
    if passes == 1:
        found = searched(documents, terms, k, owners)
    else:
        turn = F.pmod(F.xxhash64("item_id"), F.lit(2 * passes))
        found = reduce(DataFrame.union, (searched(documents, terms.where(turn == i), k, owners) for i in range(2 * passes)))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH terms AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
), items AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), lengths AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY row),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
postings AS (SELECT row, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM items) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs),
scored AS (
  SELECT item_id, l.doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN lengths l USING (row), totals GROUP BY item_id, l.doc_id, row
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
