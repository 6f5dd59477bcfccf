import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cutloom.llm import bpe, packing
from cutloom.llm.common import TwoAgeCache, tokenizer_file

SIGNS = list("abcdeéèßZÀΣςİǅ'’ \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　stmdlrve0123²½٣漢字🙂#$%&<|>_-́") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "가", "ﬁ", "ſ", "K"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def strings(n, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choices(SIGNS, k=pick.randint(0, 50))) for _ in range(n)]


def test_counts_and_ids_equal_the_library(library):
    texts = ["", *strings(4000)]
    counter, ids = bpe.MergeCounter(tokenizer_file()), packing.ChunkIds(tokenizer_file())
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert counter.count(text) == len(known.ids), repr(text)
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == known.ids, repr(text)


def test_a_small_cache_changes_nothing():
    tight, wide = bpe.MergeCounter(tokenizer_file(), 3), bpe.MergeCounter(tokenizer_file())
    for text in strings(300, 2):
        assert tight.count(text) == wide.count(text)
    assert len(tight) <= 4 and isinstance(tight, TwoAgeCache)


def test_token_report_on_odd_documents(odd, nothing, library):
    rows = bpe.token_report(odd, limit=50).collect()
    assert len(rows) == odd.count()
    texts = [r["text"] or "" for r in odd.collect()]
    want = Counter((len(t.encode()), n, n > 50) for t, n in ((t, len(library.encode(t, add_special_tokens=False).ids)) for t in texts))
    assert Counter((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert bpe.token_report(nothing).count() == 0
    assert bpe.with_token_counts(odd).columns == odd.columns  # n_tokens was there and is replaced


def check_packed(rows, capacity):
    """Sequences are gapless and never over capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(odd, nothing, library):
    rows = packing.pack(odd, capacity=64, keep_ids=True).collect()
    sequences = check_packed(rows, 64)
    assert sequences <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.update((r["doc_id"], k, a, tuple(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in rows) == want
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_rounds_place_every_piece_once(seed):
    pick = random.Random(seed)
    capacity = pick.choice([1, 7, 100, 4096])
    counts = {pick.randint(1, capacity): pick.randint(1, 400) for _ in range(pick.randint(1, 60))}
    rows, ranks = [], Counter()
    for length, rank, k, first, offset in packing.plan_rounds(counts, capacity):
        assert rank == ranks[length]
        ranks[length] += k
        rows += [{"sequence_id": first + i, "offset": offset, "length": length} for i in range(k)]
    assert ranks == Counter(counts)
    used = check_packed(rows, capacity)
    # no worse than first-fit decreasing's bound
    assert used <= 11 / 9 * -(-sum(n * c for n, c in counts.items()) // capacity) + 1 or used <= sum(c for n, c in counts.items() if 2 * n > capacity) + 1


def test_many_equal_lengths_are_ranked_apart(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same text' AS text")
    rows = packing.pack(docs, capacity=8).collect()
    assert len(rows) == 5000 and check_packed(rows, 8) == 2500


@pytest.mark.parametrize("capacity", [40_000, 131_072])
def test_large_capacities(spark, capacity):
    texts = [(i, "word " * n) for i, n in enumerate([90_000, 140_000, 10, 10, 20_000, 39_000, 65_000, 1, 0, 30_000])]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), capacity=capacity).collect()
    assert check_packed(rows, capacity) <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert sum(r["length"] for r in rows) == sum(n + 1 for n in (len(bpe_ids(t)) for _, t in texts))


def bpe_ids(text):
    return Tokenizer.from_file(tokenizer_file()).encode(text, add_special_tokens=False).ids


def test_long_keys_are_not_kept():
    counter = bpe.MergeCounter(tokenizer_file())
    text = "漢字" * 400
    assert counter.count(text) == len(bpe_ids(text)) and text not in counter


def test_copies_of_a_document_are_apart(spark):
    docs = spark.createDataFrame([(5, "one two three"), (5, "one two three"), (None, "x")], "doc_id long, text string")
    rows = packing.pack(docs, capacity=2).collect()
    pieces = Counter((r["row_id"], r["piece"]) for r in rows)
    assert set(pieces.values()) == {1} and len({r["row_id"] for r in rows}) == 3
