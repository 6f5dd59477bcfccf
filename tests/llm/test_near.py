import random

import numpy as np
import pytest

import corpus_pipeline
from cutloom.llm import near, simhash
from cutloom.tables import table


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(docs):
    """The smallest doc_id of each group, by brute force over all pairs."""
    sets = [(d, plain_set(t)) for d, t in docs]
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def edited(words, n, pick):
    words = list(words)
    for at in pick.sample(range(len(words)), n):
        words[at] = f"new{pick.random()}"
    return words


def test_edited_copies_go(spark, monkeypatch):
    monkeypatch.setattr(near, "SLICE", 8)
    pick = random.Random(3)
    docs = []
    for group in range(12):
        base = [f"w{pick.randrange(500)}" for _ in range(pick.choice([30, 150, 400]))]
        docs += [" ".join(edited(base, pick.randrange(1 + len(base) // 40), pick)) for _ in range(30 if group == 0 else 6)]
    docs += [None, "", " \n", "one", "One", "one two", "a b c d e"]
    docs = list(enumerate(docs))
    pick.shuffle(docs)
    rows = near.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r["doc_id"] for r in rows) == plain_kept(docs)
    assert all(tuple(r) in docs for r in rows)


def test_candidates_meet(spark):
    """Pairs at the least similarity meet: their sets share eight of nine hashes, in sets of one size."""
    pick = np.random.default_rng(1)
    bits, turns = near.shape(1000)
    words = -(-turns // (64 // bits))
    met = 0
    for _ in range(200):
        own = pick.integers(0, 2**64, 200, dtype=np.uint64)
        one, two = np.r_[own[:160], own[160:180]], np.r_[own[:160], own[180:]]
        a, b = near.words_of(np.unique(one), words), near.words_of(np.unique(two), words)
        keys = [(int(w) >> bits * i) % (1 << bits) for w in a for i in range(64 // bits)], [(int(w) >> bits * i) % (1 << bits) for w in b for i in range(64 // bits)]
        met += any(x == y and sum((int(a[(t // (64 // bits) + d) % words]) ^ int(b[(t // (64 // bits) + d) % words])).bit_count() for d in (1, 2)) <= near.BUDGET for t, (x, y) in enumerate(zip(*keys, strict=True)))
    assert met >= 198


def test_a_crowded_block_is_connected_step_by_step():
    pick = np.random.default_rng(2)
    base = pick.integers(0, 2**64, (3, 2), dtype=np.uint64)
    which = np.arange(600) % 3
    one, two = base[which, 0] ^ (np.uint64(1) << (np.arange(600, dtype=np.uint64) % np.uint64(64))), base[which, 1]
    label = near.meetings(np.r_[np.zeros(300), np.ones(300)].astype(np.int64), one, two)
    assert sorted({(int(x), int(w), i >= 300) for i, (x, w) in enumerate(zip(label, which, strict=True))}) == [(0, 0, False), (1, 1, False), (2, 2, False), (300, 0, True), (301, 1, True), (302, 2, True)]


def plain_labels(rows, budget):
    """The least row that links connect each row with, by brute force: rows (top, one, two) are linked where they have one top and few other bits differ."""
    top, one, two = rows.T
    linked = (top[:, None] == top) & (np.bitwise_count(one[:, None] ^ one).astype(int) + np.bitwise_count(two[:, None] ^ two) <= budget)
    label = np.arange(len(rows))
    for _ in rows:
        label = np.where(linked, label, len(rows)).min(axis=1)
    return label.tolist()


def words_near_each_other(pick, n, flips):
    """Rows (top, one, two) of three tops: copies of four fingerprints with some bits turned, some of them equal."""
    base = pick.integers(0, 2**64, (4, 2), dtype=np.uint64)
    turned = np.packbits(pick.random((n, 2, 64)) < flips, axis=-1).view("<u8")[:, :, 0]
    turned[:: n // 5] = 0
    rows = np.c_[np.arange(n, dtype=np.uint64) % np.uint64(3), base[np.arange(n) % 4] ^ turned]
    return rows[np.lexsort(rows.T[::-1])]


@pytest.mark.parametrize("pivots", [False, True])
@pytest.mark.parametrize("flips", [0.0, 0.1, 0.16])
def test_the_trie_of_several_words_links_what_all_pairs_link(flips, pivots):
    rows = words_near_each_other(np.random.default_rng(4), 120, flips)
    assert simhash.trie_links(rows, 64, near.BUDGET, pivots=pivots, at_once=50).tolist() == plain_labels(rows, near.BUDGET)


def test_blocks_meet_by_the_trie(monkeypatch):
    """Below a block the join goes down the trie, and the order of the texts does not matter."""
    pick = np.random.default_rng(6)
    rows, went = words_near_each_other(pick, 90, 0.1), []
    trie = near.trie_links
    monkeypatch.setattr(near, "trie_links", lambda values, *a, **k: went.append(len(values)) or trie(values, *a, **k))
    mixed = pick.permutation(90)
    block, one, two = rows[mixed].T
    got = near.meetings(block.astype(np.int64), one, two)
    assert got.tolist() == plain_labels(rows[mixed], near.BUDGET) and went == [90]


def test_odd_rows(odd, nothing):
    docs = odd.collect()
    kept = near.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # by position, as ids repeat and are missing
    assert len(rows) == len(plain_kept(list(enumerate(r["text"] for r in docs))))
    assert all(r in docs for r in rows)
    assert near.deduplicated(nothing).count() == 0


def test_the_stage_takes_edited_copies(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    kept = corpus_pipeline.without_near_duplicates(spark, documents, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in kept) == plain_kept([(r["doc_id"], r["text"]) for r in documents.collect()])
