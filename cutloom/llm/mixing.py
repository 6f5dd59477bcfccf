"""Mixing sources to target weights.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected: either to
the flattest mixture in which no source repeats more often than a limit, or to the share-like one that still
has a target entropy. Each source then gives its quota of tokens as whole permutations of its documents,
one an epoch, and the start of one more; quotas are dealt evenly over blocks of a token budget, so every
block holds the sources by their weights, in an order of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.arrays import WORD
from cutloom.llm.common import free_names, written

STEPS = 30
BLOCK_TOKENS = 1_000_000
SEED = 7
#: Leading hex digits of a permutation key that deal a source's epoch into parts for its running sum.
PART_DIGITS = 3
#: Sources up to which their plan is broadcast; beyond, documents meet it over SALTS salted copies.
MOST_BROADCAST, SALTS = 100_000, 64


@dataclass(frozen=True)
class Mixture:
    """The exponent, the token budget, and (source, tokens, weight, quota, full, rest) of each source."""

    exponent: float
    budget: int
    sources: DataFrame


def counted(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copies): null sources are the source '', tokens are words. Rows that agree in all three, as those of one id
    or without an id may, are one row with their number, so that no id is a crowded key of a permutation."""
    n_tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens")
    return documents.groupBy("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens).agg(F.count("*").alias("copies"))


def mixture(rows: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: int | None = None) -> Mixture:
    """The mixture of ``rows`` (source, n_tokens, copies).

    ``max_repeats``: the smallest exponent with which no source gives more than so many times its tokens;
    ``target_entropy`` (nats): the largest exponent whose weights have at least that entropy. Without ``budget`` it is the
    least with which every source gives all its documents, so none is left out. Sources without tokens have weight 0
    and give their documents once. A step of the
    search that needs all sources is an aggregate over their table, of which four numbers come to the driver.
    """
    sources = written(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total or 1))
    known = sources.where("tokens > 0").select("source", "tokens", share.alias("p"))

    def at(a: float) -> tuple[float, float, float, float]:
        """Of the weights with exponent ``a``: their sum before normalising, entropy, budget and most repeats."""
        z, s, up, down = known.agg(F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")), F.max(F.pow("p", F.lit(a - 1))), F.max(F.pow("p", F.lit(1 - a)))).first()
        if z is None:
            return 1.0, 0.0, 0.0, 0.0
        whole = budget if budget is not None else total * z * down
        return z, math.log(z) - a * s / z, whole, up * whole / (z * total)

    least, most = known.agg(F.min("p"), F.max("p")).first()
    if target_entropy is not None:
        fits = lambda a: at(a)[1] < target_entropy
    elif max_repeats is None or least is None:
        fits = lambda a: True
    elif budget is None:  # the most repeats are those of the smallest source, against one of the largest
        fits = lambda a: least ** (a - 1) * most ** (1 - a) <= max_repeats
    else:
        fits = lambda a: at(a)[3] <= max_repeats
    low, high = 0.0, 1.0  # `fits` holds from some exponent on
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    exponent = round(high if target_entropy is None else low, 6)
    z, _, whole, _ = at(exponent)
    whole = int(whole + 0.5)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    quota = F.round(weight * F.lit(float(whole))).cast("bigint")
    if max_repeats is not None:  # a budget may ask for more than the limit allows with any exponent
        quota = F.least(quota, F.floor(F.col("tokens") * F.lit(float(max_repeats))).cast("bigint"))
    plan = sources.select("source", "tokens", weight.alias("weight"), quota.alias("quota"))
    full = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1)
    plan = plan.select("*", full.cast("bigint").alias("full"), F.when(F.col("tokens") > 0, F.col("quota") % F.nullif("tokens", F.lit(0))).otherwise(0).alias("rest"))
    return Mixture(exponent, whole, plan)


def order_key(epoch: Column, seed: int = SEED) -> Column:
    """A document's place in the permutation of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their source, whatever share of the rows one source holds. The plan's other names are not among the rows'."""
    of, salt_of, salt = free_names(rows, "of", "salt_of", "salt")
    plan = plan.withColumnRenamed("source", of)
    if plan.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(plan), F.coalesce("source", F.lit("")) == F.col(of)).drop(of)
    salted = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt_of, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, (F.coalesce("source", F.lit("")) == F.col(of)) & (F.col(salt_of) == F.col(salt))).drop(of, salt, salt_of)


def streamed(rows: DataFrame, mix: Mixture, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, key, start, quota): each copy that the quotas take, with the tokens of its source before it."""
    plan = mix.sources.select("source", "tokens", "quota", "full", "rest")
    drawn = joined(rows, plan).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.greatest("full", F.lit(1)) - 1))))
    drawn = drawn.where("rest > 0 OR full > 0").withColumn("key", order_key(F.col("epoch"), seed))
    # the running sum of a permutation: within parts of it, and over the sums of the parts before
    drawn = drawn.withColumns({"part": F.substring("key", 1, PART_DIGITS), "all_tokens": F.col("n_tokens") * F.col("copies")})
    parts = drawn.groupBy("source", "epoch", "part").agg(F.sum("all_tokens").alias("sum"))
    over_parts = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "epoch", "part", F.coalesce(F.sum("sum").over(over_parts), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "epoch", "part").orderBy("key", "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("inside", F.coalesce(F.sum("all_tokens").over(within), F.lit(0))).join(parts, ["source", "epoch", "part"])
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    offset = F.col("before") + F.col("inside") + F.col("copy") * F.col("n_tokens")
    taken = each.where((F.col("epoch") < F.col("full")) | (offset < F.col("rest")))
    return taken.select("doc_id", "source", "n_tokens", "epoch", "key", (offset + F.col("epoch") * F.col("tokens")).alias("start"), "quota")


def mix_blocks(documents: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixed stream, one row a copy of a document: doc_id, source, epoch, n_tokens, block, position (in its block, from 1).

    Null sources are the source ''; null texts have no tokens; null and repeated doc_ids are copies like others (those with one key go
    by tokens). Sources without tokens give their documents once, in the first block. Very long texts are counted whole; an empty table gives
    an empty result; other columns are ignored. No text is moved. A call counts and writes the tokens and bisects the exponent at once; the
    returned rows are dealt when they are read.
    """
    rows = written(counted(documents), "tokens")
    mix = mixture(rows, max_repeats, target_entropy, budget)
    blocks = max(1, -(-mix.budget // block_tokens))
    block = F.when(F.col("quota") > 0, F.least(F.floor(F.col("start").cast("double") / F.col("quota") * F.lit(float(blocks))), F.lit(blocks - 1))).otherwise(0).cast("bigint")
    # a block has a bounded number of tokens but not of documents: its positions are counted by parts of the key
    stream = streamed(rows, mix, seed).withColumns({"block": block, "part": F.substring("key", 1, 2)})
    sizes = stream.groupBy("block", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("block", "part", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("block", "part").orderBy("key", "doc_id", "epoch", "n_tokens")
    numbered = stream.withColumn("number", F.row_number().over(order)).join(sizes, ["block", "part"])
    return numbered.select("doc_id", "source", "epoch", "n_tokens", "block", (F.col("before") + F.col("number")).alias("position"))


def mixed(documents: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``documents`` as often as the mixture takes each: all columns, one row a copy. Rows are kept where they are; of the epoch that
    is taken in part come those up to the last key that the quota reaches.

    Null sources are the source ''; null and empty texts have no tokens and come once where their source has none; rows of one id, or without an
    id, come equally often; very long texts count whole; an empty table stays empty; other columns may have any names. The mixture is
    worked out when the function is called.
    """
    rows = written(counted(documents), "tokens")
    mix = mixture(rows, max_repeats, target_entropy, budget)
    partial = streamed(rows, mix, seed).join(mix.sources.select(F.col("source").alias("_s"), F.col("full").alias("_f")), (F.col("source") == F.col("_s")) & (F.col("epoch") == F.col("_f")))
    last = partial.groupBy("source").agg(F.max("key").alias("last"))
    full_name, last_name, copies, copy = free_names(documents, "full", "last", "copies", "copy")
    plan = written(mix.sources.select("source", "full").join(last, "source", "left").select("source", F.col("full").alias(full_name), F.col("last").alias(last_name)), "mixture")
    more = F.coalesce((order_key(F.col(full_name), seed) <= F.col(last_name)).cast("int"), F.lit(0))
    found = joined(documents, plan).withColumn(copies, (F.col(full_name) + more).cast("int"))
    return found.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)


#: The rows of ``mix_blocks`` with its defaults.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source
), shares AS (SELECT source, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM totals) AS p FROM totals
), ends AS (SELECT min(p) AS least, max(p) AS most FROM shares WHERE tokens > 0
), search(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN fits THEN low ELSE (low + high) / 2 END, CASE WHEN fits THEN (low + high) / 2 ELSE high END
  FROM (SELECT s.*, pow(least, (low + high) / 2 - 1) * pow(most, 1 - (low + high) / 2) <= 4.0 AS fits FROM search s, ends WHERE i < 30)
), exponent AS (SELECT round(high, 6) AS a FROM search WHERE i = 30
), norm AS (SELECT a, sum(pow(p, a)) AS z FROM shares, exponent WHERE tokens > 0 GROUP BY a
), budget AS (SELECT a, z, floor((SELECT sum(tokens) FROM totals) * z * pow(most, 1 - a) + 0.5) AS b FROM norm, ends
), plan AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN least(round(pow(p, a) / z * b)::BIGINT, floor(tokens * 4.0)::BIGINT) ELSE 0 END AS quota, greatest(1, ceil(b / 1000000)) AS blocks
  FROM shares, budget
), parts AS (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS full_epochs, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM plan
), copies AS (
  SELECT doc_id, source, n_tokens, tokens, quota, blocks, full_epochs, rest, e.epoch, md5('7:' || e.epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM docs JOIN parts USING (source), LATERAL (SELECT unnest(range(0, full_epochs + (rest > 0)::INT)) AS epoch) e
), placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, n_tokens, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM copies
), dealt AS (
  SELECT *, CASE WHEN quota > 0 THEN least(floor((before + epoch * tokens)::DOUBLE / quota * blocks), blocks - 1) ELSE 0 END::BIGINT AS block
  FROM placed WHERE epoch < full_epochs OR before < rest
)
SELECT doc_id, source, epoch::BIGINT AS epoch, n_tokens, block, row_number() OVER (PARTITION BY block ORDER BY key, doc_id, epoch, n_tokens) AS position FROM dealt
"""
