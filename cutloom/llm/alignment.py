"""Cross-tokenizer alignment: where two tokenizers end a token at the same byte.

Both tokenizers end a token wherever a word does, so a text is cut there and what recurs is aligned once for each worker. In a piece, the
shorter list of token ends drives a galloping search, steps that double and then a bisection, through the longer one. Common ends cut both into
groups; the differences of their ranks are the groups' ranges. How often two ids end together is counted over the whole corpus, and each text's links are
then met with those counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.bpe import byte_symbols
from cutloom.llm.common import LONGEST_KEY, tokenizer_file, written

#: Pieces that each of the two ages of a worker's cache holds at most; documents and characters that are aligned together, at most (a longer text is alone).
CACHE_PIECES, STEP_DOCS, STEP_CHARS = 250_000, 1_024, 4_000_000
#: Pieces that are encoded as one text.
JOINED = 512
#: Linked id pairs up to which their counts are broadcast; beyond, links meet them over SALTS salted copies.
MOST_PAIRS, SALTS = 1_000_000, 64
#: White space of the byte-level tokenizer's pattern.
SPACES = "\t-\r \x85\xa0  -     　"
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CROWDED = re.compile(f"[{SPACES}] ")
PIECE = re.compile(rf" .*?[^{SPACES}](?= )| .*\Z", re.DOTALL)
#: The sign that stands for a space in pieces.
BLANK = "▁"


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(i, j) for each a[i] = b[j] of two rising lists: the shorter one drives, and each search goes on where the last one ended."""
    short, long, turned = (a, b, False) if len(a) <= len(b) else (b, a, True)
    found, low, n = [], 0, len(long)
    for i, end in enumerate(short):
        step = 1
        while low + step < n and long[low + step] < end:
            step *= 2
        low = bisect_left(long, end, low + step // 2, min(low + step + 1, n))
        if low == n:
            break
        if long[low] == end:
            found.append((low, i) if turned else (i, low))
            low += 1
            if low == n:
                break
    return found


def pieces(text: str) -> list[str]:
    """``text`` with a space before it, cut before each space that follows a sign which is no white space; without the pieces' first space."""
    spaced = f" {text}"
    return [p[1:] for p in PIECE.findall(spaced)] if CROWDED.search(spaced) else text.split(" ")


class Aligner:
    """Aligned pieces, in a cache of two ages: (tokens of A, of B, groups, groups as text, links), or None where the bytes are not the piece's."""

    def __init__(self, path_a: str, path_b: str, most: int = CACHE_PIECES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.size_a = [0] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.size_a[i] = len(entry) if all(c in byte_of for c in entry) else 0
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.name_a, self.name_b = [str(i) for i in range(len(self.size_a))], [str(i) for i in range(len(names))]
        pattern = json.loads(self.a.to_str())["pre_tokenizer"]
        crossing = [p for i, p in enumerate(names) if BLANK in p.lstrip(BLANK) and not self.b.is_control(i)]
        if crossing or pattern["type"] != "ByteLevel" or not pattern["use_regex"] or pattern["add_prefix_space"]:
            raise ValueError("these tokenizers do not both end a token where a word ends")
        self.blank, self.most, self.young, self.old = self.b.piece_to_id(BLANK), most, {}, {}
        # signs that no piece of B ties to a letter before them are tokens of their own after a word, as they are of A
        single = {c: (self.a.token_to_id(c), self.b.piece_to_id(c)) for c in ".," if not any(c in p and any(x.isalpha() for x in p[: p.index(c)]) for i, p in enumerate(names) if not self.b.is_byte(i))}
        self.signs = {c: (f"{x}|{y}", x << 32 | y) for c, (x, y) in single.items() if x is not None and names[y] == c}

    def entry(self, piece: str, ids_a: list[int], ids_b: list[int]) -> tuple | None:
        in_b = [self.bytes_b[i] for i in ids_b]
        if b"".join(in_b) != f" {piece}".encode():
            return None
        left, right = [self.name_a[i] for i in ids_a], [self.name_b[i] for i in ids_b]
        n_a, n_b = len(left), len(right)
        if n_a == 1 or n_b == 1:  # both end with the piece, and there only
            return n_a, n_b, 1, f"{','.join(left)}|{','.join(right)}", (ids_a[-1] << 32 | ids_b[-1],)
        common = common_ends(list(accumulate([self.size_a[i] for i in ids_a])), list(accumulate(map(len, in_b))))
        groups, links, i, j = [], [], 0, 0
        for last_a, last_b in common:
            groups.append(f"{','.join(left[i : last_a + 1])}|{','.join(right[j : last_b + 1])}")
            links.append(ids_a[last_a] << 32 | ids_b[last_b])
            i, j = last_a + 1, last_b + 1
        return n_a, n_b, len(groups), ";".join(groups), tuple(links)

    def ids_of_a(self, pieces: list[str]) -> list[list[int]]:
        """A's tokens of each piece. Pieces that end in no white space are encoded as one text, a space before each, and its tokens are dealt out by their bytes."""
        texts = [f" {p}" for p in pieces]
        alone = [i for i, t in enumerate(texts) if t[-1] in WHITE]
        joined = [i for i, t in enumerate(texts) if t[-1] not in WHITE]
        found: list[list[int]] = [[] for _ in texts]
        for i, e in zip(alone, self.a.encode_batch([texts[i] for i in alone], add_special_tokens=False), strict=True):
            found[i] = e.ids
        starts = range(0, len(joined), JOINED)
        whole = self.a.encode_batch(["".join([texts[i] for i in joined[s : s + JOINED]]) for s in starts], add_special_tokens=False)
        for s, e in zip(starts, whole, strict=True):
            ids, at = e.ids, 0
            for i in joined[s : s + JOINED]:
                first, left = at, len(texts[i].encode())
                while left > 0:
                    left -= self.size_a[ids[at]]
                    at += 1
                if left:
                    raise ValueError("a token crosses the end of a word")
                found[i] = ids[first:at]
        return found

    def table(self, wanted: set[str]) -> dict[str, tuple | None]:
        """What is known of each piece; what is not known yet is encoded in one go. A word with a full stop or comma is the word's entry and the sign's."""
        found, fresh, signed = {}, set(), []
        for piece in wanted:
            known = self.young.get(piece, self)
            if known is self and (known := self.old.get(piece, self)) is not self:
                self.young[piece] = known
            if known is not self:
                found[piece] = known
            elif piece[-1:] in self.signs and piece[:-1].isalpha():
                signed.append(piece)
                if (stem := piece[:-1]) not in wanted and stem not in self.young:
                    fresh.add(stem)
            else:
                fresh.add(piece)
        pieces = list(fresh)
        # an empty piece is the space that a text ends with
        for piece, ids_a, ids_b in zip(pieces, self.ids_of_a(pieces), self.b.encode(pieces, num_threads=1), strict=True):
            found[piece] = made = self.entry(piece, ids_a, ids_b if piece else [self.blank])
            if len(piece) <= LONGEST_KEY:
                self.young[piece] = made
        for piece in signed:
            stem, sign = found[piece[:-1]] if piece[:-1] in found else self.young[piece[:-1]], self.signs[piece[-1]]
            found[piece] = made = stem and (stem[0] + 1, stem[1] + 1, stem[2] + 1, f"{stem[3]};{sign[0]}", (*stem[4], sign[1]))
            if len(piece) <= LONGEST_KEY:
                self.young[piece] = made
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        return found


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(path_a, path_b)


LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>"


def linked(documents: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """A row for each document, its distinct links in ``pairs`` (A's id times 2^32 and B's) with their ``times``. ``groups`` is the groups' text where it is to be kept,
    else its digest."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        step, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                step.append((doc_id.as_py(), text.as_py() or ""))
                size += len(step[-1][1])
                if len(step) >= STEP_DOCS or size >= STEP_CHARS:
                    yield step
                    step, size = [], 0
        if step:
            yield step

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for step in stepped(batches):
            cut = [pieces(text) if text else [] for _, text in step]
            table, rows = known.table(set(chain.from_iterable(cut))), []
            for (doc_id, _), parts in zip(step, cut, strict=True):
                found = [table[p] for p in parts]
                if not found or None in found:
                    rows.append((number, doc_id, 0, 0, 0, 0, "", [], []))
                else:
                    n_a, n_b, n_groups, texts, links = zip(*found, strict=True)
                    times = Counter(chain.from_iterable(links))
                    groups = ";".join(texts)
                    rows.append((number, doc_id, sum(n_a), sum(n_b), sum(n_groups), times.total(), groups if keep_groups else hashlib.sha256(groups.encode()).hexdigest(), list(times), list(times.values())))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(align, LINKED)


def linked_pairs(rows: DataFrame) -> DataFrame:
    """(pair, count, best) of every linked id pair: how many links hold it, and whether no other id of A has more with its id of B."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy(id_b))).cast("bigint"))


def alignment_report(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (or ``groups``, the text itself).

    A is a byte-level tokenizers file, B a sentencepiece model; A encodes the text with a space before it, B adds one by itself. Null and empty texts, and those
    whose tokens do not spell the text, have no tokens: zeros and ''. Repeated rows count each; equal counts are all the highest; very long texts are read whole, and one
    without spaces is a single piece; an empty table gives no rows; other columns are ignored. Calling it aligns all texts and writes their links to the shared folder.
    """
    rows = written(linked(documents, path_a or tokenizer_file("byte_bpe_50k.json"), path_b or tokenizer_file("piece_bpe_32k.model"), keep_groups), "links")
    counts = written(linked_pairs(rows), "link_counts")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= MOST_PAIRS:
        met = links.join(F.broadcast(counts), "pair")
    else:
        copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(copies, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    both = rows.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups" if keep_groups else "groups_sha256"))
