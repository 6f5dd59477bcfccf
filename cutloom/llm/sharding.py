"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots; every shard stands on it as many virtual nodes, and a slot belongs to the first node
clockwise of it. A row's place is the hash of its text, so copies lie together (or of its id, where the id alone is to decide). A shard
takes no more than its bound: what overflows continues clockwise to the next shard with room.

Only loads by slot are planned on, a table of a fixed size; Spark finds each row's place within its slot, and a slot that many rows
fall on, as those of copies do, is dealt into parts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.common import written

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
#: Virtual nodes of a shard.
NODES = 128
#: Rows of a slot's part: a share of all rows, and never more than MOST_ROWS.
PART_SHARE, MOST_ROWS = 4_096, 1_000_000
LAWS = ("rows", "bytes", "key")


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise; of nodes on one slot the smaller shard comes first, so a new shard moves no old node."""
    if shards < 1 or nodes < 1 or shards * nodes > SLOTS:
        raise ValueError(f"{shards} shards of {nodes} nodes do not fit on {SLOTS} slots")
    digest = lambda name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest())
    return sorted((digest(f"{shard}:{node}") % SLOTS, shard) for shard in range(shards) for node in range(nodes))


def clockwise(stands: list[tuple[int, int]], slot: int) -> Iterator[int]:
    """The shards met from ``slot`` on, each once: its own first."""
    first, met = bisect_left(stands, (slot, -1)), set()
    for _, shard in (*stands[first:], *stands[:first]):
        if shard not in met:
            met.add(shard)
            yield shard


def spread(loads: dict[int, int], room: list[int], nodes: int = NODES) -> list[tuple[int, int, int, int]]:
    """(slot, low, high, shard): which part of each slot's load goes where, no shard getting more than its ``room``.

    In rounds: all that is not placed is offered to its next shard clockwise, which takes what it has room for in ring order. As the room of all
    holds all loads, everything has its place after as many rounds as there are shards.
    """
    if sum(room) < sum(loads.values()):
        raise ValueError("the shards' bounds are less than the load")
    stands, room, taken = ring(len(room), nodes), list(room), []
    waiting = [(slot, 0, loads[slot], clockwise(stands, slot)) for slot in sorted(loads)]
    while waiting:
        onward = []
        for slot, low, high, route in waiting:
            shard = next(route)
            most = min(high, low + room[shard])
            if most > low:
                taken.append((slot, low, most, shard))
                room[shard] -= most - low
            if most < high:
                onward.append((slot, most, high, route))
        waiting = onward
    return sorted(taken)


def bounds(total: int, shards: int, law: str, slack: float) -> list[int]:
    """What each shard may take. Without slack, rows are dealt so that shards differ by one at most."""
    if law == "key":
        return [total] * shards
    if slack <= 0:
        return [total // shards + (shard < total % shards) for shard in range(shards)]
    return [int(total * (1 + slack) / shards) + 1] * shards


def sharded(documents: DataFrame, shards: int = 16, law: str = "rows", slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` says what a shard's bound counts: ``rows``, ``bytes`` (UTF-8 bytes of the text and one more for the row), or nothing (``key``: the id and
    the number of shards decide). ``slack`` is the share that a bound lies above the mean; 0 gives shards whose rows differ by one at most, or whose bytes
    differ by no more than a row for each slot they share, and more slack moves fewer rows when a shard is added. ``slot`` numbers a shard's rows from
    0 without gaps. ``grown_shard`` is the shard with one more of them, for ``key`` only.

    A null text is an empty one; null ids are ids like others; repeated rows are placed each; equal texts lie in one shard or, where a bound cuts them,
    in shards that follow on the ring; very long texts are only hashed; an empty table gives no rows; other columns are ignored. The rows
    without texts are written to the shared folder twice.
    """
    if law not in LAWS:
        raise ValueError(f"{law} is none of {LAWS}")
    spark, text = documents.sparkSession, F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    facts = documents.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id" if law == "key" else text).alias("at"), F.xxhash64(F.monotonically_increasing_id()).alias("seed"))
    rows = written(facts.withColumn("place", F.shiftrightunsigned("at", 64 - SLOT_BITS).cast("int")), "shard_rows")
    load = F.col("size") if law == "bytes" else F.lit(1).cast("bigint")

    # at most SLOTS rows
    met = {r["place"]: r for r in rows.groupBy("place").agg(F.sum(load).alias("load"), F.count("*").alias("n")).collect()}
    total, n = sum(r["load"] for r in met.values()), sum(r["n"] for r in met.values())
    ranges: dict[int, list] = {place: [] for place in met}
    for place, low, high, shard in spread({p: r["load"] for p, r in met.items()}, bounds(total, shards, law, slack), nodes):
        ranges[place].append((low, high, shard))
    grown = ring(shards + 1, nodes) if law == "key" else []
    per = min(MOST_ROWS, -(-n // PART_SHARE)) or 1
    plan = spark.createDataFrame([(p, -(-met[p]["n"] // per), ranges[p], next(clockwise(grown, p), None)) for p in ranges], "place int, parts long, ranges array<struct<low: long, high: long, shard: int>>, grown_shard int")

    dealt = rows.join(F.broadcast(plan), "place").withColumn("part", F.pmod("seed", "parts"))
    parts = dealt.groupBy("place", "part").agg(F.sum(load).alias("load"))
    before = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("place", "part", F.coalesce(F.sum("load").over(before), F.lit(0)).alias("offset"))
    along = Window.partitionBy("place", "part").orderBy("at", "doc_id", "seed")
    inner = dealt.withColumn("inner", F.coalesce(F.sum(load).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("inner") + F.col("offset")
    found = F.get(F.filter("ranges", lambda r: (r["low"] <= start) & (start < r["high"])), F.lit(0))["shard"]
    chosen = written(inner.join(parts, ["place", "part"]).select("doc_id", "size", "text_crc32", "at", "seed", "place", "part", found.alias("shard"), "grown_shard"), "shard_choice")

    ahead = Window.partitionBy("shard").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = chosen.groupBy("shard", "place", "part").agg(F.count("*").alias("n"))
    groups = groups.select("shard", "place", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "place", "part").orderBy("at", "doc_id", "seed"))
    numbered = chosen.withColumn("number", number).join(groups, ["shard", "place", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("first") + F.col("number") - 1).alias("slot"), "grown_shard")
