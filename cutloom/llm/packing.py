"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best-fit. Pieces and gaps are sorted by size; in each round a successor sweep
from the largest size down offers every piece the smallest gap that still holds it; where more
pieces want a gap than there are such gaps, the lower rank takes it and the others go on to the
next larger one; then gaps are updated and the next round begins. Sizes are whole numbers from 1
to the capacity, so pieces of one length are interchangeable, and so are neighbouring sequences
with one gap: the sweeps run over counts by length (at most ``capacity`` rows, whatever the
input) and say which ranks of a length go to which sequences. Spark tokenises, counts the
lengths, ranks the pieces of each length (a hot length over many tasks), and places each piece.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.llm.bpe import byte_symbols
from cutloom.llm.common import ChunkCache, tokenizer_file, written

#: Chunks that each of the two ages of a worker's cache of token ids holds at most.
CACHE_CHUNKS = 350_000
#: Rows that are ranked together within a length.
RANK_ROWS = 1_000


class ChunkIds(ChunkCache):
    """Token ids of a chunk without spaces or line feeds, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols = self.tokenizer.model, byte_symbols()

    def make_new(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk == chunk.lower() and unicodedata.is_normalized("NFC", chunk):
            # a plain word is one pre-token that the normaliser leaves alone: the merges are all there is to do
            bytes_of = chunk if chunk.isascii() else "".join([self.symbols[b] for b in chunk.encode()])
            return array("I", [token.id for token in self.model.tokenize(bytes_of)]).tobytes()
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def pieces_of(documents: DataFrame, capacity: int, end_id: int, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and ``end_id``, cut only where they exceed ``capacity``. ``row_id`` tells the
    rows of one doc_id apart."""
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("row_id", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, closing, width = chunk_ids(tokenizer).ids, np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, row_id in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = ids_of(text.as_py()) + closing
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id.as_py(), piece, row_id, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], schema.names)

    return documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id")).mapInArrow(cut, schema)


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, offset) for so many pieces of each length.

    A gap run is (gap, first sequence, sequences): neighbouring sequences with the same gap.
    """
    left = dict(sorted(counts.items(), reverse=True))
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int]] = []
    placed, opened = [], 0
    while left:
        smallest = min(left)
        runs = sorted((r for r in runs if r[0] >= smallest), key=lambda r: (-r[0], r[1]))
        joined: list[tuple[int, int, int]] = []
        for gap, first, n in runs:  # neighbours with one gap become one run
            if joined and joined[-1][0] == gap and joined[-1][1] + joined[-1][2] == first:
                joined[-1] = (gap, joined[-1][1], joined[-1][2] + n)
            else:
                joined.append((gap, first, n))
        offered, stack, after, matched = 0, [], [], False
        for length in list(left):
            while offered < len(joined) and joined[offered][0] >= length:
                stack.append(joined[offered])  # the successor of this length is now on top
                offered += 1
            while stack and left.get(length):
                gap, first, n = stack.pop()
                k = min(n, left[length])
                placed.append((length, ranks[length], k, first, capacity - gap))
                after.append((gap - length, first, k))
                if k < n:
                    stack.append((gap, first + k, n - k))
                ranks[length] += k
                left[length] -= k
                matched = True
            if not left[length]:
                del left[length]
        runs = after + stack + joined[offered:]
        if left and not matched:  # no gap holds any piece: open sequences for the largest tier, as many as it needs
            side_by_side = capacity // max(left)
            tier = sum(n for length, n in left.items() if capacity // length == side_by_side)
            more = -(-tier // side_by_side)
            runs.append((capacity, opened, more))
            opened += more
    return placed


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``rank`` from 0 within each length. A length is dealt over hash buckets of
    about RANK_ROWS rows; the offset of a bucket is the sum of those before it."""
    buckets = max(1, -(-rows // RANK_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("row_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("length", "_bucket").orderBy("row_id", "piece")
    numbered = dealt.withColumn("_n", F.row_number().over(within) - 1)
    return numbered.join(sizes, ["length", "_bucket"]).withColumn("rank", F.col("_offset") + F.col("_n")).drop("_bucket", "_offset", "_n")


def pack(documents: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, row_id, start, length, ids_crc32, sequence_id, offset (and ids as bytes with ``keep_ids``).

    Every document is packed whole: null and empty texts give one piece that holds ``end_id`` alone; only texts
    over ``capacity`` ids are cut, into full pieces and a rest. Rows with one doc_id, also null, are
    packed row by row: ``row_id``, a number of the row in this run's written pieces, tells them apart and with the piece breaks ties of
    length. An empty table gives an empty result; other columns are ignored, whatever their names. A call tokenises, writes the
    pieces and plans at once; the returned rows are placed when they are read.
    """
    spark = documents.sparkSession
    pieces = written(pieces_of(documents, capacity, end_id, tokenizer or tokenizer_file(), keep_ids), "pieces")
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(plan_rounds(counts, capacity), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared, names = spark.sparkContext.broadcast(plan), pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, sequences, offsets = shared.value.T
        # the plan is sorted by length, then rank: each length is a slice of it, within which a rank is searched
        known, starts = np.unique(lengths, return_index=True)
        ends = np.r_[starts[1:], len(lengths)]
        for batch in batches:
            rank, own = batch.column("rank").to_numpy(), np.searchsorted(known, batch.column("length").to_numpy())
            at = np.empty(len(rank), np.int64)
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else ():
                a, e = starts[own[part[0]]], ends[own[part[0]]]
                at[part] = a + np.searchsorted(ranks[a:e], rank[part], side="right") - 1
            found = [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], schema.names)

    return ranked(pieces, sum(counts.values())).select(*pieces.columns, "rank").mapInArrow(place, schema)
