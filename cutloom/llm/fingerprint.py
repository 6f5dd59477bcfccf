"""Order MinHash fingerprints, and each document against its edited text and its neighbour.

A text is a row of pieces: its words, those over ``PIECE`` characters cut into parts. A k-mer is
``K`` neighbouring pieces (all of them in a shorter text). Each k-mer gets the number of its
occurrence in the text, and one hash of both puts it into one of ``BINS`` bins; the two smallest
of a bin, in text order, are hashed to the bin's part of the fingerprint. So one pass over the
k-mers serves all parts, and a moved or repeated passage changes them as an edit does. Likeness
is the share of equal parts among the bins that either text fills.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.arrays import at, indices, let, run_starts
from cutloom.llm.common import free_names

K = 5
PIECE = 16
BINS_LOG2 = 6
#: Low bits of a k-mer's number that hold its place in the text. In a text with more pieces the place is a field of its own.
PLACE_BITS = 24
#: Rows of neighbouring ids that are looked at together about, and the most such slices (their first rows are broadcast).
SLICE_ROWS, MOST_SLICES = 1000, 16_384


@dataclass(frozen=True)
class Numbers:
    """K-mers numbered so that they sort by hash, then place: longs with the place in the low bits or, ``wide``, structs (v, place)."""

    wide: bool = False

    def number(self, h: Column, occurrence: Column, place: Column) -> Column:
        high = F.xxhash64(h, occurrence.cast("int")).bitwiseAND(F.lit(-1 << PLACE_BITS))
        return F.struct(high.alias("v"), place.alias("place")) if self.wide else high.bitwiseOR(place.cast("bigint"))

    def bin(self, x: Column) -> Column:
        return F.shiftrightunsigned(x["v"] if self.wide else x, 64 - BINS_LOG2)

    def value(self, x: Column) -> Column:
        return F.shiftrightunsigned(x["v"] if self.wide else x, PLACE_BITS)

    def place(self, x: Column) -> Column:
        return x["place"] if self.wide else x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def kmer_hashes(pieces: Column, k: int) -> Column:
    return F.when(F.size(pieces) == 0, F.array().cast("array<bigint>")).when(F.size(pieces) < k, F.array(F.xxhash64(pieces))).otherwise(
        F.transform(indices(F.size(pieces) - (k - 1)), lambda i: F.xxhash64(*(at(pieces, i + j) for j in range(k))))
    )


def occurrences_numbered(hashes: Column, by: Numbers) -> Column:
    """Every k-mer by ``by.number``; only texts that repeat a k-mer are sorted to count occurrences."""

    def by_runs(pairs: Column) -> Column:
        def one_run(starts: Column) -> Column:
            end = lambda j: F.coalesce(at(starts, j + 1), F.size(pairs))
            return F.flatten(F.transform(starts, lambda start, j: F.transform(F.sequence(start, end(j) - 1), lambda q: by.number(at(pairs, q)["h"], q - start, at(pairs, q)["i"]))))

        return let(run_starts(pairs, F.size(pairs)), one_run)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda h, i: by.number(h, F.lit(0), i))).otherwise(
        let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_runs)
    )


def bin_parts(smallest: Column, by: Numbers) -> Column:
    """From the (at most) two smallest numbered k-mers of each bin: bin and tuple hash in one long."""

    def part(x: Column, i: Column) -> Column:
        mate = at(smallest, i + 1)
        paired = mate.isNotNull() & (by.bin(mate) == by.bin(x))
        hashed = F.when(~paired, F.xxhash64(by.value(x))).when(by.place(x) <= by.place(mate), F.xxhash64(by.value(x), by.value(mate))).otherwise(F.xxhash64(by.value(mate), by.value(x)))
        first = (i == 0) | (by.bin(at(smallest, i - 1)) != by.bin(x))
        return F.when(first, F.shiftleft(by.bin(x), 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))

    return F.filter(F.transform(smallest, part), lambda x: x.isNotNull())


def signature(text: Column, k: int = K) -> Column:
    """The fingerprint of a whole text as an array of longs, at most one for each bin; none for a text without words."""

    def of_hashes(hashes: Column, by: Numbers) -> Column:
        ordered = F.sort_array(occurrences_numbered(hashes, by))
        two = let(ordered, lambda v: F.filter(v, lambda x, i: (i < 2) | (by.bin(at(v, i - 2)) != by.bin(x))))
        return let(two, lambda v: bin_parts(v, by))

    pieces = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    hashes = let(pieces, lambda p: kmer_hashes(p, k))
    return let(hashes, lambda h: F.when(F.size(h) <= 1 << PLACE_BITS, of_hashes(h, Numbers())).otherwise(of_hashes(h, Numbers(wide=True))))


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.lower(F.hex(x))), ".")


def likeness(one: Column, other: Column) -> Column:
    """0 to 1; two texts without words are alike, one without and one with words are not."""
    bins = lambda parts: F.transform(parts, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(one), bins(other)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)) / filled)


def count_below(cuts: list[int], x: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``, by bisection."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def step(ends: Column, _: Column) -> Column:
        middle = F.shiftright(ends["low"] + ends["high"], 1)
        up = (ends["low"] < ends["high"]) & (F.get(table, middle) <= x)
        return F.struct(F.when(up, middle + 1).otherwise(ends["low"]).alias("low"), F.when(up, ends["high"]).otherwise(F.least(middle, ends["high"])).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), step, lambda ends: ends["low"])


def with_next(rows: DataFrame, carried: list[str], by: str, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``next``, a struct of the ``carried`` columns of the row that follows in descending ``key`` (after the last row comes
    the first; null keys come last).

    Keys are dealt into ranges by approximate quantiles, so ranges have like numbers of rows however far apart the keys are.
    The rows of a key that fills several ranges, and those of null keys, are dealt over as many slices by a hash of column ``by``, which
    is also their order; only equal rows stay together. Each slice lends its first row to the one before, so a row moves once and no task sees all rows. Beyond
    MOST_SLICES * SLICE_ROWS rows slices get longer; they are sorted, with spilling, and never gathered.
    """
    n = rows.count()
    ranges = min(MOST_SLICES, max(1, -(-n // SLICE_ROWS)))
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    fills = Counter(found or [])  # at most MOST_SLICES
    cuts = sorted(fills)
    group, top, host, seat, mixed = free_names(rows, "group", "top", "host", "seat", "mixed")
    number = count_below(cuts, F.col(key))
    hashed = F.xxhash64(by)
    least = F.get(F.array(*map(F.lit, cuts)), number - 1) if cuts else F.lit(None).cast("bigint")
    slices = F.when(F.col(key).isNull(), F.lit(ranges))
    if cuts:
        filled = F.get(F.array(*(F.lit(fills[c]) for c in cuts)), number - 1)
        slices = slices.when((least == F.col(key)) & (filled > 1), filled)
    # slices in descending order of their keys: a key that fills ranges is the least of its own, so its slices follow the others
    own = F.when(slices.isNotNull(), 1 + F.pmod(hashed, slices)).otherwise(0).cast("int")
    dealt = rows.withColumn(mixed, hashed).withColumn(group, F.struct(F.col(key).isNull().alias("a"), F.coalesce(-number, F.lit(0)).alias("b"), own.alias("c")))
    first = F.struct(F.col(key).alias("k"), F.col(mixed).alias("h"))
    ring = Window.orderBy(group)  # one row a slice: at most MOST_SLICES and as many of null keys
    tops = dealt.groupBy(group).agg(F.max(first).alias(top))
    tops = tops.select(group, top, F.coalesce(F.lag(group).over(ring), F.max(group).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(host))
    lent = dealt.join(F.broadcast(tops), group)
    at_home, as_guest = F.struct(F.col(group).alias("g"), F.lit(0).alias("guest")), F.struct(F.col(host).alias("g"), F.lit(1).alias("guest"))
    seated = lent.withColumn(seat, F.explode(F.when(F.col(top) == first, F.array(at_home, as_guest)).otherwise(F.array(at_home)))).drop(group, top, host)
    order = Window.partitionBy(f"{seat}.g").orderBy(f"{seat}.guest", F.desc_nulls_last(key), F.desc(mixed), *carried)
    return seated.withColumn("next", F.lead(F.struct(*carried)).over(order)).where(f"{seat}.guest = 0").drop(seat, mixed)


def fingerprint_report(documents: DataFrame, k: int = K) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's. Null texts count as empty: their fingerprint is empty. Equal texts have equal
    fingerprints. A single document is its own next one. Rows with one doc_id, null ones too, each give a row and follow each other in
    no stated order. Very long texts are fingerprinted whole. An empty table gives an empty result; other columns are ignored. A call
    counts rows and takes quantiles of their ids.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    both = with_next(rows.withColumn("sig", signature(F.col("text"), k)), ["text", "sig"], by="text").select("doc_id", n.cast("bigint").alias("n_chars"), "sig", F.col("next.sig").alias("next_sig"), edited.alias("edited"))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signature(F.col("edited"), k).alias("edited_sig"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
