import re

import numpy as np
import pytest
import xxhash

from cutloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, budget=3):
    """The smallest index that links reach, by comparing all pairs."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints(odd):
    for r in odd.collect():
        text = r["text"]
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_report_on_odd_documents(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    docs = odd.collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    groups = plain_groups(prints)
    low = {}
    for r, g in zip(docs, groups, strict=True):
        if r["doc_id"] is not None:
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    want = sorted(((r["doc_id"], f"{p:016x}", low.get(g)) for r, p, g in zip(docs, prints, groups, strict=True)), key=key)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=key) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(odd, nothing):
    docs = odd.collect()
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len(set(plain_groups([plain_fingerprint(r["text"]) for r in docs])))
    assert all(r in docs for r in rows)
    assert simhash.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_join_loses_no_link(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 20)
    pick = np.random.default_rng(seed)
    near = pick.integers(0, 2**64, 60, dtype=np.uint64)
    parts = [near]
    for _ in range(6):
        flipped = parts[-1].copy()
        for _ in range(pick.integers(1, 4)):
            flipped ^= np.uint64(1) << pick.integers(0, 64, len(flipped), dtype=np.uint64)
        parts.append(flipped)
    values = np.unique(np.concatenate([*parts, near[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    for turn in range(4):
        turned = np.sort((values << np.uint64(16 * turn)) | (values >> np.uint64(64 - 16 * turn)) if turn else values)
        label = simhash.trie_links(turned, 16, 3)
        assert (label <= np.arange(len(turned))).all()
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, len(values))).collect()}
    mine, plain = {}, {}
    for v, g in zip(values, plain_groups([int(x) for x in values]), strict=True):
        signed = int(np.uint64(v).view(np.int64))
        mine.setdefault(roots.get(signed, signed), set()).add(signed)
        plain.setdefault(g, set()).add(signed)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


@pytest.mark.parametrize("seed", [0, 1])
def test_crowded_blocks_lose_no_link(spark, seed):
    """All values share a block, so that it is dealt by further bits; chains of small steps go across them."""
    pick = np.random.default_rng(seed)
    base = pick.integers(0, 2**48, 150, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near = np.concatenate([near, base ^ (np.uint64(1) << pick.integers(30, 48, len(base), dtype=np.uint64)) ^ (np.uint64(1) << pick.integers(0, 48, len(base), dtype=np.uint64))])
    values = np.unique(near | (np.uint64(0xABCD) << np.uint64(48)))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, len(values), crowd=10)).collect()}
    mine, plain = {}, {}
    for v, g in zip(values, plain_groups([int(x) for x in values]), strict=True):
        signed = int(np.uint64(v).view(np.int64))
        mine.setdefault(roots.get(signed, signed), set()).add(signed)
        plain.setdefault(g, set()).add(signed)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))
