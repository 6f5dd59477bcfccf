import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cutloom.llm import alignment
from cutloom.llm.common import tokenizer_file
from cutloom.llm.queries import QUERIES
from cutloom.tables import table

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["a  b", "a \n b", "a\t b ", " lead", "tail  ", "\n", " ", "  ", "a  b", "x\x1c y", "<|endoftext|> <s> </s> <unk> <0x0A>", "Ünï 東京 です。 次", "😀 👩‍👩‍👧 é", "ﬁ ｆｕｌｌ", "a　 b", "don't we'll 12345 ,, ;;", "▁ x▁y", "a\r\n b", "a\x00b c", "x" * 300 + " y", "東京" * 200]


@pytest.fixture(scope="module")
def whole():
    """Tokens of whole texts by the libraries: (ids, bytes) of A and of B, or None where they do not spell the text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spare = iter(range(256, 512))
    byte_of = {chr(x) if x in (*range(33, 127), *range(161, 173), *range(174, 256)) else chr(next(spare)): x for x in range(256)}

    def tokens(text):
        if not text:
            return None
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        spelled = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == spelled == b"".join(t for _, t in right) else None

    return tokens


def plain(tokens) -> tuple:
    """Groups and links of one text by end offsets in dictionaries."""
    if tokens is None:
        return [], []
    ends = []
    for side in tokens:
        at, by_end = 0, {}
        for n, (_, x) in enumerate(side):
            at += len(x)
            by_end[at] = n
        ends.append(by_end)
    common = sorted(ends[0].keys() & ends[1].keys())
    groups, i, j = [], 0, 0
    for end in common:
        x, y = ends[0][end] + 1, ends[1][end] + 1
        groups.append(",".join(str(t) for t, _ in tokens[0][i:x]) + "|" + ",".join(str(t) for t, _ in tokens[1][j:y]))
        i, j = x, y
    return groups, [(tokens[0][ends[0][e]][0], tokens[1][ends[1][e]][0]) for e in common]


def expected(docs, tokens) -> list[tuple]:
    each = [(d, *plain(t := tokens(text)), t) for d, text in docs]
    counts = Counter(x for _, _, links, _ in each for x in links)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(d, len(t[0]) if t else 0, len(t[1]) if t else 0, len(g), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, g, links, t in each]


def rows(df):
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + r[1:]
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=key)


def in_order(found):
    return sorted(found, key=lambda r: ((r[0] is None, r[0] or 0), *r[1:]))


@given(st.lists(st.integers(1, 60), unique=True), st.lists(st.integers(1, 60), unique=True))
@settings(max_examples=300, deadline=None)
def test_galloping_finds_all_common_ends(a, b):
    a, b = sorted(a), sorted(b)
    assert [(a[i], b[j]) for i, j in alignment.common_ends(a, b)] == [(x, x) for x in sorted({*a} & {*b})]


@given(st.text(st.sampled_from(" \n\t 　ab,.1é東▁"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_as_the_whole(whole, text):
    known, tokens = alignment.aligner(A, B), whole(text)
    parts = alignment.pieces(text) if text else []
    found = [known.table({*parts})[p] for p in parts]
    groups, _ = plain(tokens)
    assert (";".join(x[3] for x in found) if found and None not in found else "") == ";".join(groups)


def test_against_whole_texts(spark, whole):
    pick = random.Random(3)
    docs = [(i, t) for i, t in enumerate([None, "", *ODD, *("".join(pick.choices("the naïve of cat, 東 é. \n  x", k=pick.randint(1, 200))) for _ in range(60))])]
    docs += [docs[5], (None, "the cat"), (None, None), (7, "other text of id 7"), docs[9]]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS pairs", "'y' AS times").repartition(5)
    assert rows(alignment.alignment_report(df)) == in_order(expected(docs, whole))


def test_beyond_the_broadcast_and_small_caches(spark, sf, whole, monkeypatch):
    docs = table(spark, sf, "documents").limit(60)
    held = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(alignment, "MOST_PAIRS", 10)
    monkeypatch.setattr(alignment, "STEP_DOCS", 7)
    monkeypatch.setattr(alignment, "JOINED", 3)
    assert rows(alignment.alignment_report(spark.createDataFrame(held, "doc_id long, text string"))) == in_order(expected(held, whole))


def test_the_query_against_whole_texts(spark, sf, whole):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows(QUERIES["op11_token_alignment"](spark, sf)) == in_order(expected(docs, whole))


def test_groups_kept_and_nothing(spark, odd, nothing):
    assert alignment.alignment_report(nothing).count() == 0
    kept = alignment.alignment_report(spark.createDataFrame([(1, "a cat")], "doc_id long, text string"), keep_groups=True).first()
    assert kept["groups"].count("|") == kept["n_groups"] == kept["n_links"] == 2
    assert alignment.alignment_report(odd).count() == odd.count()
