"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at spaces and line feeds into chunks, which no token crosses. A chunk is
normalised and cut into pre-tokens as the tokenizer file says; each pre-token is a linked list
of byte symbols, and a heap yields its lowest-rank adjacent pair until none is left. Its count
is the initial symbols minus the merges; no identifier is made. Counts of chunks are kept in a
bounded cache of the worker, as words recur.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import ChunkCache, tokenizer_file

#: Chunks that each of the two ages of a worker's cache holds at most.
CACHE_CHUNKS = 400_000
#: White space of the tokenizer's ``\s``.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeCounter(ChunkCache):
    """Tokens of a chunk, by chunk. Looking up a chunk that is not there counts it."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        super().__init__(most)
        spec = json.load(open(path, encoding="utf-8"))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None

    def make_new(self, chunk: str) -> int:
        """Special strings count one each; between them the text is normalised and merged."""
        parts = self.special.split(chunk) if self.special else [chunk]
        total = len(parts) - 1
        for part in parts:
            # lower case by code point: the rule for a final sigma is not applied
            plain = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            total += sum(self.merge(piece.encode()) for piece in self.pieces.findall(plain))
        return total

    def merge(self, piece: bytes) -> int:
        """Symbols of ``piece`` minus its merges."""
        symbols = [self.symbols[b] for b in piece]
        symbols[-1] += self.end
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, left, right = heapq.heappop(heap)
            if symbols[left] is None or after[left] != right or self.ranks.get((symbols[left], symbols[right])) != rank:
                continue  # one of the two has been merged since
            symbols[left] += symbols[right]
            symbols[right] = None
            merges += 1
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (r := self.ranks.get((symbols[left], symbols[following]))) is not None:
                    heapq.heappush(heap, (r, left, following))
            if (previous := before[left]) >= 0 and (r := self.ranks.get((symbols[previous], symbols[left]))) is not None:
                heapq.heappush(heap, (r, previous, left))
        return n - merges

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty."""
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One counter for each worker process and tokenizer file."""
    return MergeCounter(path)


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the tokens of each whole text as long column ``out``.

    Null and empty texts have 0 tokens; a very long text is read chunk by chunk; repeated rows
    count alike; an empty table stays empty; other columns pass through (one named ``out`` is
    replaced). No shuffle.
    """
    tokenizer = tokenizer or tokenizer_file()

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(tokenizer).count
        for batch in batches:
            yield pa.array([count(x.as_py()) for x in batch], pa.int64())

    return df.withColumn(out, tokens(F.col(text)))


def token_report(documents: DataFrame, limit: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """For each row of ``documents``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    counted = with_token_counts(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), tokenizer=tokenizer)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
