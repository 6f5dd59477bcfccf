"""Digest trees of runs: two runs are compared by going down where their digests differ, and only those rows are read.

A row's range is the head of its key's hash, so both runs cut their keys alike. A leaf's digest is of its rows in any order, a node's is of its children's; the root stands
for the run. Rows are stored by range, so the ranges that agree are never opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.functions.scalars import content_hash
from cutloom.operators.lake import changed

#: Bits of a range, and of the step from a level to the next one: 256 leaves under 16 nodes under the root.
BITS, STEP = 8, 4
TREE = "level int, node int, n bigint, sha256 string"


def key_range(key: Column, bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


def leaves(rows: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(node, n, sha256) of each range: sums of the parts of the rows' digests, so no range is gathered or sorted. Equal rows count each.

    A part has 32 bits, so sums of longs hold two billion rows a range; more are an error, not another digest."""
    each = rows.select(key_range(F.col(key), bits).alias("node"), content_hash(*rows.columns).alias("_sha"))
    parts = [F.sum(F.conv(F.substring("_sha", 1 + 8 * i, 8), 16, 10).cast("bigint")).cast("string") for i in range(8)]
    return each.groupBy("node").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("sha256"))


def tree(rows: DataFrame, key: str, bits: int = BITS, step: int = STEP) -> DataFrame:
    """(level, node, n, sha256): the leaves, the nodes above them, and at level 0 the root. An empty run has no nodes."""
    # 2 ** bits leaves at most
    level = rows.sparkSession.createDataFrame(leaves(rows, key, bits).collect(), "node int, n bigint, sha256 string")
    levels, depth = [], -(-bits // step)
    for i in range(depth, -1, -1):
        levels.append(level.select(F.lit(i).alias("level"), "node", "n", "sha256"))
        children = F.array_sort(F.collect_list(F.struct("node", "sha256")))
        level = level.groupBy(F.shiftright("node", step).alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["sha256"])), ","), 256).alias("sha256"))
    return reduce(DataFrame.union, levels)


def by_range(rows: DataFrame, key: str, files: int, bits: int) -> DataFrame:
    """``rows`` with ``part``, dealt over four times as many tasks as there are files, so that few files meet in one task whatever the session's number is."""
    return rows.withColumn("part", key_range(F.col(key), bits)).repartition(4 * files * 2**bits, "part", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(files)))


def store_run(rows: DataFrame, path: str, key: str, files: int = 1, bits: int = BITS) -> str | None:
    """Writes a run below ``path``, its rows by range (in ``files`` files each) and its tree, and gives the root digest, null for an empty run. A run that is there already is an error.

    Keys are not null. There are two to the power of ``bits`` ranges; runs that are to be compared have as many.
    """
    by_range(rows, key, files, bits).write.mode("errorifexists").partitionBy("part").parquet(f"{path}/rows")
    rows.limit(0).write.mode("errorifexists").parquet(f"{path}/schema")  # an empty run has no files that would tell it
    tree(stored_rows(rows.sparkSession, path).drop("part"), key, bits).coalesce(1).write.mode("errorifexists").parquet(f"{path}/tree")
    return root(rows.sparkSession, path)


def root(spark: SparkSession, path: str) -> str | None:
    """The root digest of a stored run."""
    found = spark.read.schema(TREE).parquet(f"{path}/tree").where("level = 0").first()
    return found["sha256"] if found else None


def unequal(old: DataFrame, new: DataFrame, step: int = STEP) -> list[int]:
    """The leaves in which two trees differ, found from the root down: of a level, only the children of unequal nodes are looked at."""
    depth, found = max((df.agg(F.max("level")).first()[0] or 0 for df in (old, new))), [0]
    for level in range(depth + 1):
        of = lambda df, name, level=level, found=found: df.where((F.col("level") == level) & (F.shiftright("node", step) if level else F.col("node")).isin(found)).select("node", F.col("sha256").alias(name))
        both = of(old, "a").join(of(new, "b"), "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        found = sorted(r["node"] for r in both.select("node").collect())
        if not found:
            return []
    return found


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored run with ``part``, their range."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema.add("part", T.IntegerType())).parquet(f"{path}/rows")


def rows_of(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    """The rows of a stored run's ranges; others are not read."""
    return stored_rows(spark, path).where(F.col("part").isin(parts)).drop("part")


def compared(spark: SparkSession, old: str, new: str, key: str, value: str) -> DataFrame:
    """What two stored runs differ in: key, old_value, new_value, change (added, removed, changed)."""
    trees = [spark.read.schema(TREE).parquet(f"{p}/tree") for p in (old, new)]
    parts = unequal(*trees)
    return changed(*(rows_of(spark, p, parts) for p in (old, new)), key, value).where("change <> 'same'")
