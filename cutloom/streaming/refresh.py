"""Live refresh: new decisions change their keys' state, and the lake and the gates follow from it; sessions and late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cutloom.operators.lake import changed


def latest(decisions: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Each key's latest decision of the stream ``decisions`` (keys, levels, accepted, decided_at), a row a key that is its state: keys, decided_at, accepted, levels.

    An earlier or repeated decision changes nothing. Of decisions of one time an accepting one wins, then the greatest levels; those without a time are the
    earliest. A null level is 'unknown'. Spark's own aggregate keeps the state: rows meet it without Python, and no call is made for a key.
    """
    # nulls are the least of a struct's values
    order = F.struct("decided_at", "accepted", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in levels))
    return decisions.groupBy(*keys).agg(F.max(order).alias("_latest")).select(*keys, "_latest.*")


def published(spark: SparkSession, lake: str) -> DataFrame | None:
    """The newest whole version of a lake's leaves, or null where none is published. A version counts once its last file, the mark of success, is there."""
    done = whole_versions(spark, lake)
    return spark.read.parquet(f"{lake}/version={max(done)}") if done else None


def whole_versions(spark: SparkSession, lake: str) -> list[int]:
    """The numbers of the versions below ``lake`` that are written to the end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(lake)
    system = folder.getFileSystem(conf)
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{lake}/{n}/_SUCCESS")))


def rolled_up(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """The lake as ``operators.lake.label_lake`` gives it, from its leaves (levels, accept, reject)."""
    rolled = leaves.rollup(*levels).agg(F.grouping_id().alias("gid"), F.sum("accept").alias("accept"), F.sum("reject").alias("reject"))
    level, total = F.lit(len(levels)) - F.log2(F.col("gid") + 1).cast("int"), F.col("accept") + F.col("reject")
    return rolled.select(level.cast("int").alias("level"), *levels, "accept", "reject", total.alias("total"), F.round(F.col("accept") / total, 3).alias("accept_rate"))


def refresh_on_decisions(decisions: DataFrame, lake: str, checkpoint: str, keys: list[str], levels: list[str], regate: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Runs through what has arrived in the stream ``decisions`` (keys, levels, accepted, decided_at) and keeps the leaves of the lake as versions below ``lake``.

    A batch reads itself and the state, a row a key, and never the decisions before: they change their keys' rows, whose counts make the next version, which readers
    see only when it is whole (``published``). A batch that runs again writes its own version again. A decision that is null counts for nothing; leaves that nothing
    counts for any more go. ``regate`` gets the rolled-up lake.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = rows.groupBy(*levels).agg(F.count_if("accepted").alias("accept"), F.count_if(~F.col("accepted")).alias("reject")).where("accept <> 0 OR reject <> 0")
        now.write.mode("overwrite").parquet(f"{lake}/version={number}")
        if regate:
            regate(rolled_up(rows.sparkSession.read.parquet(f"{lake}/version={number}"), levels))

    stream = latest(decisions, keys, levels).writeStream.outputMode("complete").foreachBatch(batch)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regate_diff(old: DataFrame, new: DataFrame, key: str = "case_id") -> DataFrame:
    """What a refreshed gate decides differently: key, old_value, new_value, change, without what stayed."""
    return changed(old, new, key, "auto_cut").where("change <> 'same'")


def counted_by_window(events: DataFrame, time: str, late: str, window: str, slide: str | None, by: list[str]) -> DataFrame:
    """Event counts by window, on a batch or a stream; events more than ``late`` behind the newest are dropped from a stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window, slide), *by).count().select(F.col("window.start").alias("start"), *by, F.col("count").alias("n"))


def sessions(events: DataFrame, key: str, time: str, gap_ms: int, late: str) -> DataFrame:
    """Sessions of a stream: key, start_ms, end_ms, n; one is closed when no event of its key comes for more than ``gap_ms`` of event time."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grown = timed.groupBy(F.session_window(time, f"{gap_ms + 1} milliseconds").alias("w"), key).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return grown.select(key, F.unix_millis(F.col("w.start")).alias("start_ms"), F.unix_millis("last").alias("end_ms"), "n")


def as_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)
