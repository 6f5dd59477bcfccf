"""SimHash fingerprints, their near-duplicate links, and the components of those links.

Links come from a binary-trie self-join. Fingerprints that differ in at most ``budget`` bits agree
in at least one of ``budget + 1`` equal blocks of bits, so the fingerprints are dealt out once for
each block, by that block's value; the block is the top of the trie, where both nodes of a pair
are the same. Below it the join goes down level by level: a pair of nodes becomes its pairs of
children, those that part at the level differ in one bit more, and a pair over the budget is
pruned. A task hands on a spanning star of each connected group that it finds, never all pairs.
``near`` goes down the same trie with fingerprints of several words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.llm.common import free_names, written

SEED = 42
#: Fingerprints that one group of the trie join gets about.
GROUP_ROWS = 200_000
#: Node pairs that are followed at once; more are followed in turns.
PAIRS_AT_ONCE = 1_000_000
#: Linked pairs that are held before they are folded into stars.
LINKS_AT_ONCE = 2_000_000
#: Pairs of values below a pair of nodes up to which they are compared without going down.
SMALL = 16
#: Fingerprints of one block value that one task gets; more are dealt by further bits, MOST_BELOW at most.
CROWD, MOST_BELOW = 50_000, 10
#: Tasks that the fingerprints of one group are dealt over where they meet the group's row.
SALTS = 16
#: Pairs of trie nodes: a0, a1, b0, b1 (ranges of sorted values) and the bits in which they differ.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text as an unsigned number; 0 without words."""
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """``df`` with the fingerprint of each whole text as a signed long (null and wordless texts: 0)."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(x.as_py(), width) for x in batch], np.uint64).view(np.int64))

    return df.withColumn(out, fp(F.col(text).cast("binary")))


def stars(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links (left, right) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def trie_links(values: np.ndarray, exact_bits: int, budget: int, starts: Pairs | None = None, pivots: bool = False, at_once: int = PAIRS_AT_ONCE) -> np.ndarray:
    """The star label of each of the sorted unsigned ``values``, linked where they differ in at most ``budget`` bits. Values of several words are rows.

    ``starts`` are pairs of trie nodes at depth ``exact_bits`` (without them each node and itself): ranges [a0, a1) and [b0, b1) of values, and
    the bits in which the two nodes differ. The join goes down from them level by level, and prunes a pair of nodes when its bits
    exceed the budget; where few values are left below a pair they are compared at once. With ``pivots`` the values of a larger node are
    compared with its first one, and a pair of nodes whose values are all connected is pruned too: its links would change nothing.
    ``at_once`` pairs of nodes, and of values, are held at a time.
    """
    n = len(values)
    label = np.arange(n)
    words = [values] if values.ndim == 1 else [np.ascontiguousarray(w) for w in values.T]
    compared = words[exact_bits // 64 :]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal label
        held.append((np.arange(n), label))
        label = stars(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), n)
        held.clear()

    def keep(left: np.ndarray, right: np.ndarray) -> None:
        bits = np.bitwise_count(compared[0][left] ^ compared[0][right])
        for word in compared[1:]:
            bits = bits + np.bitwise_count(word[left] ^ word[right])
        near = bits <= budget
        if near.any():
            held.append((left[near], right[near]))
        if sum(len(x) for x, _ in held) > LINKS_AT_ONCE:
            fold()

    def all_of(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """Compares every value of each small pair of nodes, about ``at_once`` pairs of values at a time."""
        size = (a1 - a0) * (b1 - b0)
        if len(size) > 1 and size.sum() > at_once:
            half = len(size) // 2
            all_of(a0[:half], a1[:half], b0[:half], b1[:half])
            all_of(a0[half:], a1[half:], b0[half:], b1[half:])
            return
        which = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        wide = (b1 - b0)[which]
        left, right = a0[which] + at // wide, b0[which] + at % wide
        own = (a0 == b0)[which]
        once = ~own | (left < right)
        keep(left[once], right[once])

    def first_of(of0: np.ndarray, to0: np.ndarray, to1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left, right): for each node [to0, to1) the value ``of0`` and every value of the node."""
        size = to1 - to0
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(of0, size), np.repeat(to0, size) + at

    zeros: dict[int, np.ndarray] = {}
    todo = [(exact_bits, *(starts or pairs_of_nodes(words[0], exact_bits, 0)))]
    while todo:
        depth, a0, a1, b0, b1, bits = todo.pop()
        if len(a0) > at_once:
            half = len(a0) // 2
            todo += [(depth, *(x[:half] for x in (a0, a1, b0, b1, bits))), (depth, *(x[half:] for x in (a0, a1, b0, b1, bits)))]
            continue
        # few values below: compare them at once
        small = (a1 - a0) * (b1 - b0) <= SMALL
        if small.any():
            all_of(*(x[small] for x in (a0, a1, b0, b1)))
        a0, a1, b0, b1, bits = (x[~small] for x in (a0, a1, b0, b1, bits))
        if not len(a0):
            continue
        if depth == 64 * len(words):
            # no bits are left: both nodes are within the budget with all their values
            keep(*first_of(a0, a0, a1))
            keep(*first_of(a0, b0, b1))
            continue
        if pivots:
            own = a0 == b0
            keep(*first_of(a0[own], a0[own], a1[own]))
            fold()
            changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            open_ = (changes[a0] != changes[a1 - 1]) | (changes[b0] != changes[b1 - 1]) | (label[a0] != label[b0])
            a0, a1, b0, b1, bits = (x[open_] for x in (a0, a1, b0, b1, bits))
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum((words[depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1) == 0)]
        count = zeros[depth]
        am, bm, same = a0 + count[a1] - count[a0], b0 + count[b1] - count[b0], a0 == b0
        children = [
            (a0, am, b0, bm, bits, None),
            (am, a1, bm, b1, bits, None),
            (a0, am, bm, b1, bits + 1, None),
            (am, a1, b0, bm, bits + 1, ~same),  # of a node with itself this is the pair before
        ]
        parts = []
        for c0, c1, d0, d1, bit, which in children:
            ok = (c1 > c0) & (d1 > d0) & (bit <= budget)
            ok &= ~((c0 == d0) & (c1 - c0 == 1))
            if which is not None:
                ok &= which
            parts.append([x[ok] for x in (c0, c1, d0, d1, bit)])
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    fold()
    return label


def pairs_of_nodes(values: np.ndarray, depth: int, mask: int) -> Pairs:
    """Where the trie join of sorted ``values`` starts: at ``depth``, each node with itself or, with a ``mask``, every two nodes whose prefixes differ by it."""
    tops = values >> np.uint64(64 - depth) if depth < 64 else values
    starts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    ends = np.r_[starts[1:], len(values)]
    if not mask:
        many = ends - starts > 1
        starts, ends = starts[many], ends[many]
        return starts, ends, starts, ends, np.zeros(len(starts), np.int64)
    found = tops[starts]
    partner = found ^ np.uint64(mask)
    at = np.minimum(np.searchsorted(found, partner), len(found) - 1)
    both = (found[at] == partner) & (found < partner)
    return starts[both], ends[both], starts[at[both]], ends[at[both]], np.full(both.sum(), mask.bit_count())


def links(fingerprints: DataFrame, n: int, budget: int = 3, fp: str = "fp", crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct ``fp`` values (longs) that chains of links of at most
    ``budget`` differing bits connect. ``n``: how many values there are about.

    A block value with more than ``crowd`` fingerprints is no one task's: the trie is followed for some bits more before rows are
    dealt, and each pair of nodes there that is within the budget is a group of its own.
    """
    blocks = budget + 1
    width = 64 // blocks
    groups = max(1, -(-n * blocks // GROUP_ROWS))
    turned = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.when(F.lit(i == 0), F.col(fp)).otherwise(F.shiftleft(fp, i * width).bitwiseOR(F.shiftrightunsigned(fp, 64 - i * width))).alias("turned")) for i in range(blocks))))
    dealt = fingerprints.select(turned.alias("x")).select("x.*").withColumn("top", F.shiftrightunsigned("turned", 64 - width))
    # at most ``blocks`` times 2 ** ``width`` counts; only crowded ones are kept
    counts = dealt.groupBy("turn", "top").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    deeper = F.least(F.lit(MOST_BELOW), F.ceil(F.log2(F.col("n") / F.lit(crowd))) + 1).cast("int")
    dealt = dealt.join(F.broadcast(counts.select("turn", "top", deeper.alias("deeper"))), ["turn", "top"], "left")
    dealt = dealt.withColumn("below", F.coalesce("deeper", F.lit(0)))
    masks = F.array(*(F.lit(m) for m in range(1 << MOST_BELOW) if m.bit_count() <= budget))
    own = F.when(F.col("below") == 0, F.array(F.lit(0))).otherwise(F.filter(masks, lambda m: m < F.pow(F.lit(2.0), F.col("below"))))
    sub = F.when(F.col("below") > 0, F.expr(f"shiftrightunsigned(turned, {64 - width} - below) & (shiftleft(1L, below) - 1)")).otherwise(F.lit(0).cast("bigint"))
    dealt = dealt.withColumn("sub", sub).withColumn("mask", F.explode(own))
    crowded = F.xxhash64("turn", "top", "mask", F.least("sub", F.col("sub").bitwiseXOR(F.col("mask").cast("bigint"))))
    dealt = dealt.withColumn("group", F.when(F.col("below") == 0, F.pmod(F.xxhash64("turn", "top"), F.lit(groups))).otherwise(crowded)).select("turn", "turned", "below", "mask", "group")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (turn, below, mask), own in frame.groupby(["turn", "below", "mask"]):
            values = np.sort(own["turned"].to_numpy().view(np.uint64))
            label = trie_links(values, width + below, budget, pairs_of_nodes(values, width + below, mask))
            linked = np.flatnonzero(label != np.arange(len(values)))
            back = np.uint64(turn * width)
            whole = values if turn == 0 else (values >> back) | (values << (np.uint64(64) - back))
            found.append(pd.DataFrame({"u": whole[linked].view(np.int64), "v": whole[label[linked]].view(np.int64)}))
        return pd.concat(found)

    return dealt.groupBy("group").applyInPandas(join, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): alternating large and small stars until nothing changes."""

    def state(df: DataFrame) -> tuple:
        # one row, whatever the input
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def both(df: DataFrame) -> DataFrame:
        return df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(df: DataFrame, large: bool) -> DataFrame:
        around = both(df) if large else df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = around.join(least, "u").where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    now, seen = written(edges.where("u <> v").distinct(), "links"), None
    while (at := state(now)) != seen:
        seen = at
        if not at[0]:
            break
        now = written(star(star(now, large=True), large=False), "links")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def grouped(prints: DataFrame, budget: int) -> DataFrame:
    """(fp, root, low) of each fingerprint that has links: its group and its smallest doc_id. ``prints`` has doc_id, fp."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), nodes.count(), budget))
    return nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "low")


def near_duplicates(documents: DataFrame, budget: int = 3, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Null and wordless texts have fingerprint zero and link like others; texts of fewer than ``width`` words hash
    as one shingle; equal fingerprints are one node, so copies, however many, never make pairs. Rows with the same
    doc_id each give a row. A null doc_id is never the smallest; a group of null doc_ids alone has a null
    component_id. Very long texts are read whole. An empty table gives an empty result; other columns are ignored. Fingerprints, links
    and components are worked out, and written, when the function is called.
    """
    prints = written(with_fingerprints(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", width).drop("text"), "fingerprints")
    linked = grouped(prints, budget)
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a group may hold a third of all fingerprints: it is salted, and a left join streams the fingerprints, never the groups
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(lows, ["root", "salt"], "left").select("fp", "component_id")
    copies = prints.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    alone = copies.join(linked.select("fp"), "fp", "left_anti")
    found = prints.join(linked.union(alone).withColumn("_met", F.lit(True)), "fp", "left")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def deduplicated(documents: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """One document of each group of ``near_duplicates``, with all its columns: the one with the smallest doc_id (null ids
    last), then the smallest text hash; of equal rows one. A document is named by hashes of its id and text meanwhile.

    Nulls, short and very long texts are as in ``near_duplicates``; an empty table stays empty; other columns may have any names."""
    k1, k2 = free_names(documents, "k1", "k2")
    name = [F.xxhash64("doc_id", "text").alias(k1), F.hash("text", "doc_id").alias(k2)]
    texts = documents.select("doc_id", "text", *name)
    prints = written(with_fingerprints(texts, "text", "fp", width).drop("text"), "fingerprints")
    # copies are one row before groups are: no fingerprint, however many documents have it, is one task's
    low = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", k1, k2)).alias("x"))
    groups = low.join(grouped(prints, budget).select("fp", "root"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    first = groups.groupBy("group").agg(F.min("x").alias("x")).select(f"x.{k1}", f"x.{k2}")
    # equal rows are one before they are moved
    return documents.select("*", *name).join(first, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*documents.columns)
