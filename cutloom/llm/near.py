"""SimHash near-dedup at a similarity of word sets: one document of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Such texts differ in about a sixth of a SimHash's bits, too many for the blocks of one 64-bit fingerprint (``simhash.links``). So a fingerprint has
many words here, and the trie self-join has as many turns as there are blocks in it: two texts meet in a turn in which they agree in a whole
block, the top of the turn's trie, and are a candidate pair if they differ in no more than a budget of the 128 bits after it, the levels below, which
the join goes down one by one. A pair at the least similarity meets in no turn with probability MISSED. Exact sets decide: within the components of candidates pairs are compared, a large component tile by
tile, and the components of the pairs found are the groups. Documents with one set are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import free_names, written
from cutloom.llm.simhash import GROUP_ROWS, SALTS, SEED, components, stars, trie_links

WIDTH = 5
#: Pairs count from a similarity of SHARED / WHOLE.
SHARED, WHOLE = 4, 5
#: The chance that a pair at that similarity meets in no turn.
MISSED = 0.0005
#: Bits that are compared where texts meet, and how many of them may differ: 19.4 are expected at the least similarity, with a deviation of 4.1.
CHECKED, BUDGET = 128, 33
#: Bits of a block at least; there are more in larger tables, so that a block value keeps about 256 texts or fewer.
LEAST_BITS, TEXTS_LOG2 = 14, 8
#: Pairs of trie nodes that a task follows at once.
NODES_AT_ONCE = 250_000
#: Nodes of a slice of a part, and the slices of a part at most; two slices meet in a tile.
SLICE, SLICES = 64, 32


def shape(n: int) -> tuple[int, int]:
    """(bits of a block, turns) for ``n`` texts."""
    bits = min(32, max(LEAST_BITS, math.ceil(math.log2(max(2, n))) - TEXTS_LOG2))
    share = 2 * SHARED / (SHARED + WHOLE)  # the cosine of two sets of one size
    agree = (1 - math.acos(share) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-agree))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes, sorted, of a UTF-8 text's shingles; of fewer than ``width`` words one, without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in each), np.uint64))


def words_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A SimHash of ``n`` 64-bit words of a set of hashes: every word counts the bits of the hashes mixed in its own way."""
    mixed = hashes[:, None] * (np.arange(n, dtype=np.uint64) * np.uint64(2 * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(0xBF58476D1CE4E5B9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    ones = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), 255):  # so many ones fit into a byte
        part = np.ascontiguousarray(mixed[at : at + 255])
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).ravel(), bitorder="little").reshape(len(part), -1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def with_sets(df: DataFrame, words: int) -> DataFrame:
    """``df`` with ``x``: ``node``, which names the set of a row's text, and ``words``, its SimHash (empty for a text without words)."""

    @F.arrow_udf("struct<node:bigint,words:array<bigint>>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shingles(x.as_py()) for x in batch]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            prints = [words_of(x, words).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in found]
            ends = np.cumsum([0, *map(len, prints)]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prints])))], ["node", "words"])

    return df.withColumn("x", sets(F.col("text").cast("binary")))


def merged_labels(label: np.ndarray, members: np.ndarray) -> np.ndarray:
    """``label`` with the classes of ``members`` as one."""
    classes = np.unique(label[members])
    return label if len(classes) == 1 else np.where(np.isin(label, classes), classes[0], label)


def meetings(block: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The star label of each text: texts are linked where they have one block and differ in at most BUDGET bits of ``one`` and ``two``.

    The block is the exact top of a trie whose further levels are the bits of ``one``, then of ``two``; the self-join goes down from it bit by bit.
    """
    n = len(block)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((two, one, block))
    rows = np.stack([block[order].astype(np.uint64), one[order], two[order]], axis=1)
    label = trie_links(rows, 64, BUDGET, pivots=True, at_once=NODES_AT_ONCE)
    return stars(order, order[label], n)


def candidates(nodes: DataFrame, n: int, bits: int, turns: int) -> DataFrame:
    """Edges (u, v) between ``nodes`` (node, words) that meet in some turn; a task hands on stars."""
    per_word = 64 // bits
    words = -(-turns // per_word)
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    placed = nodes.where(F.size("words") > 0).select("node", "words", turn)
    word = F.expr(f"turn div {per_word}").cast("int")
    block = F.expr(f"shiftrightunsigned(words[cast(turn div {per_word} as int)], {bits} * (turn % {per_word})) & {(1 << bits) - 1}L")
    dealt = placed.select("node", "turn", block.alias("block"), F.get("words", (word + 1) % words).alias("one"), F.get("words", (word + 2) % words).alias("two"))
    groups = max(1, -(-n * turns // GROUP_ROWS))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("turn", "block"), F.lit(groups)))

    def meet(table: pa.Table) -> pa.Table:
        node, turn, block, one, two = (table[c].to_numpy() for c in ("node", "turn", "block", "one", "two"))
        own = (turn.astype(np.int64) << 32) | block
        order = np.lexsort((node, own))
        label = meetings(own[order], one[order].view(np.uint64), two[order].view(np.uint64))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": node[order][moved], "v": node[order][label[moved]]})

    return dealt.groupBy("group").applyInArrow(meet, "u bigint, v bigint").distinct()


def pairs(table: pa.Table) -> pa.Table:
    """(u, v): stars of the linked pairs of one tile. ``table``: node, side, a, b, text; where the slices a and b differ, pairs within one are
    another tile's."""
    rows = {n: (s, t) for n, s, t in zip(table["node"].to_pylist(), table["side"].to_pylist(), table["text"].to_pylist(), strict=True)}
    nodes, across = np.array(list(rows), np.int64), table["a"][0] != table["b"][0]
    sides = np.array([s for s, _ in rows.values()])
    found = [shingles(t) for _, t in rows.values()]
    sizes = np.array([len(x) for x in found])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    ids, label = np.unique(np.concatenate(found), return_inverse=True)[1], np.arange(len(nodes))
    marked = np.zeros(len(ids) + 1, np.int64)
    for i in np.flatnonzero(sides == sides.min()) if across else range(len(nodes) - 1):
        if (label == label[0]).all():
            break  # all are connected: further pairs would change nothing
        own = ids[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        shared = np.add.reduceat(marked[ids], starts)
        marked[own] = 0
        near = WHOLE * shared >= SHARED * (sizes + sizes[i] - shared)
        near &= (sides != sides[i]) if across else (np.arange(len(nodes)) > i)
        label = merged_labels(label, np.r_[i, np.flatnonzero(near)])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": nodes[moved], "v": nodes[label[moved]]})


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest doc_id (null ids last), then the
    smallest text hash; of equal rows one.

    Texts without words, null ones too, are one group; texts of fewer than five words are one shingle. Very long texts are read whole. An empty
    table stays empty; other columns may have any names. A document is named by hashes of its id and text meanwhile. Candidates and groups are
    worked out, and written, when the function is called.
    """
    k1, k2 = free_names(documents, "k1", "k2")
    name = [F.xxhash64("doc_id", "text").alias(k1), F.hash("text", "doc_id").alias(k2)]
    n = documents.count()
    bits, turns = shape(n)
    prints = written(with_sets(documents.select("doc_id", "text", *name), -(-turns // (64 // bits))).select("doc_id", k1, k2, "x.*"), "shingle_sets")
    # copies are one node before anything is joined; all rows of a node have the same words
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", k1, k2)).alias("x")
    nodes = written(prints.groupBy("node").agg(low, F.any_value("words").alias("words")), "nodes")
    one = nodes.select("node", f"x.{k1}", f"x.{k2}")
    parts = written(components(candidates(nodes.select("node", "words"), n, bits, turns)), "parts")
    large = parts.groupBy("root").agg(F.count("*").alias("n")).where(f"n > {SLICE}")
    # a part may hold a third of all nodes: it is salted where they meet its size
    salt, salts = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sliced = parts.withColumn("salt", salt).join(large.withColumn("salt", salts), ["root", "salt"], "left").withColumn("k", F.least(F.ceil(F.coalesce("n", F.lit(1)) / SLICE), F.lit(SLICES)).cast("int"))
    sliced = sliced.withColumn("side", F.pmod(F.xxhash64("node", "root"), "k").cast("int")).join(one, "node")
    texts = documents.select("text", *name).join(sliced.select("node", "root", "k", "side", k1, k2), [k1, k2])
    tiles = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = tiles.select("node", "root", "side", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "text")
    linked = tiles.withColumn("text", F.col("text").cast("binary")).groupBy("root", "a", "b").applyInArrow(pairs, "u bigint, v bigint")
    roots = components(linked).select("node", "root")
    groups = nodes.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    first = groups.groupBy("group").agg(F.min("x").alias("x")).select(f"x.{k1}", f"x.{k2}")
    # equal rows are one before they are moved
    return documents.select("*", *name).join(first, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*documents.columns)
