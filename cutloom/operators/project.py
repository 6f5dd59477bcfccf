"""A project from its candidates to the edited timeline: frozen inputs, verified cuts, verdicts, edit list with digest, new times and the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import to_samples
from cutloom.operators import gates, intervals, params, verification
from cutloom.operators.frames import sliding
from cutloom.sources import logs


@dataclass(frozen=True)
class Finished:
    """What a run leaves: the version of the candidates it holds, its edit list, the edit list's digest, the words' new times and a report."""

    version: int
    edl: DataFrame
    digest: str
    words: DataFrame
    report: DataFrame


def candidates_of(spark: SparkSession, root: str, make: Callable[[], DataFrame], reuse: bool) -> tuple[int, DataFrame]:
    """The candidates a run works on, as a frozen version below ``root``: with ``reuse`` the newest there is, else (or if there is none) newly made ones as the next version."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    if not (reuse and there):
        logs.write_version(make(), root, logs.frozen(spark, root)[0] + 1 if there else 0)
    return logs.frozen(spark, root)


def edit_list(cuts: DataFrame, verdicts: DataFrame, keys: list[str], rate: int = 48_000) -> DataFrame:
    """(id, keys, start_sample, end_sample, crossfade): the ``cuts`` (id, keys, verdict, cut_start, cut_end, params) that the checks approve and whose judge says KEEP_CUT.

    ``verdicts`` (id, judged); a case without a verdict or with an unknown one needs review and stays out. Cross-fades leave a guard of their cut.
    """
    judged = cuts.where("verdict = 'APPROVE'").join(verdicts, "id", "left").where(gates.verdict_or_review(F.col("judged")) == "KEEP_CUT")
    start, end = to_samples(F.col("cut_start"), rate), to_samples(F.col("cut_end"), rate)
    fade = params.crossfade_samples(F.coalesce(F.col("params")["crossfade_ms"], F.lit(0)), end - start, rate)
    return judged.select("id", *keys, start.alias("start_sample"), end.alias("end_sample"), fade.alias("crossfade"))


def report_rows(cuts: DataFrame, edl: DataFrame) -> DataFrame:
    """A row for each cut (id, kind, verdict, strategy, start, end, cut_start, cut_end): its verdict and splice, by how much it was widened at head and tail, and whether it was applied."""
    applied = edl.select("id", F.lit(True).alias("applied"), "crossfade")
    return cuts.join(applied, "id", "left").select("id", "kind", "verdict", "strategy", (F.col("start") - F.col("cut_start")).alias("head_ms"), (F.col("cut_end") - F.col("end")).alias("tail_ms"), (F.col("cut_end") - F.col("cut_start")).alias("applied_ms"), F.coalesce("applied", F.lit(False)).alias("applied"), "crossfade")


def finish(spark: SparkSession, root: str, make: Callable[[], DataFrame], words: DataFrame, silence: DataFrame, verdicts: DataFrame, keys: list[str], kinds: tuple[str, ...], width: int, slice_width: int, reuse: bool = False, salts: int = 1) -> Finished:
    """Runs a project: candidates (id, kind, keys, start, end) from ``make``, ``words`` (id, keys, start, end, probability), ``silence`` (keys, start, end), ``verdicts`` (id, judged).

    The candidates are frozen as a version below ``root``; with ``reuse`` the newest version is taken and nothing is made. The checked cuts are written once, and the edit
    list, the report and the new times read that.
    """
    version, found = candidates_of(spark, f"{root}/candidates", make, reuse)
    said = words.select(*keys, "start", "end", "probability")
    checked = verification.expanded(verification.verified(found, said, silence, keys, kinds, width, slice_width, salts), said, keys, kinds, width, salts)
    if not checked_already(spark, f"{root}/checked/version={version}"):
        checked.write.mode("overwrite").parquet(f"{root}/checked/version={version}")
    cuts = spark.read.parquet(f"{root}/checked/version={version}")
    edl = edit_list(cuts, verdicts, keys)
    taken = cuts.join(edl.select("id"), "id", "left_semi").select(*keys, F.col("cut_start").alias("start"), F.col("cut_end").alias("end"))
    moved = intervals.remapped(words.select("id", *keys, F.col("start").alias("t")), taken, keys, slice_width)
    digest = logs.manifest(edl, "id").where("key = '*'").first()["sha256"]
    return Finished(version, edl, digest, moved, report_rows(cuts, edl))


def checked_already(spark: SparkSession, path: str) -> bool:
    """Whether a version's checks are written to the end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def review_package(words: DataFrame, cuts: DataFrame, rules: Column, context: int, width: int, keys: list[str]) -> DataFrame:
    """What a reviewer sees of each cut (id, kind, keys, start, end): the words (keys, pos, word, start, end) of its track within ``context`` of it in order, how many of them it takes, whether another
    cut is as near, and the label that ``rules``, a column over the cut, gives it.

    A cut has a size, ``width`` doubled until the cut and its context fit, and lies in one slice as wide as that. The words are lent to the slices whose cuts may hear them,
    as one list in order, so a cut finds its words in a row, and pairs of a cut and a word are never rows.
    """
    around = cuts.withColumns({"_from": F.col("start") - context, "_to": F.col("end") + context})
    # the bits of how often the width fits before the last instant
    over = F.floor((F.col("_to") - F.col("_from") - 1) / F.lit(width)).cast("bigint")
    around = around.withColumn("_size", F.when(over > 0, F.length(F.bin(over))).when(over.isNotNull(), F.lit(0)))
    sizes = around.select("_size").where("_size IS NOT NULL").distinct()
    wide = F.expr(f"shiftleft({width}L, _size)")
    counted = sliding(around, keys, "start", width, _near=(F.count("*"), -context, context)).withColumn("beside", F.col("_near") - 1)
    first, last = F.floor((F.col("start") - wide) / wide), F.floor(F.col("end") / wide)
    lent = words.crossJoin(F.broadcast(sizes)).where(first <= last).withColumn("_slice", F.explode(F.sequence(first, last)))
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", F.col("start").alias("s"), F.col("end").alias("e"))))
    said = lent.groupBy(*keys, "_size", "_slice").agg(listed.alias("_said"))
    met = counted.withColumn("_slice", F.floor(F.col("_from") / wide)).join(said.hint("merge"), [*keys, "_size", "_slice"], "left")
    near = F.filter("_said", lambda w: (w["s"] < F.col("_to")) & (w["e"] > F.col("_from")))
    heard = met.withColumn("_heard", F.coalesce(near, F.array().cast(said.schema["_said"].dataType)))
    taken = F.size(F.filter("_heard", lambda w: (w["s"] >= F.col("start")) & (w["e"] <= F.col("end"))))
    return heard.select("id", "kind", *keys, "start", "end", F.transform("_heard", lambda w: w["word"]).alias("heard"), taken.cast("bigint").alias("n_taken"), "beside", rules.alias("rule"))


def speaker_roles(words: DataFrame, keys: list[str], track: str, tokens: tuple[str, ...], duration: Column | None = None, least: float = 1.5) -> DataFrame:
    """(keys, track, backchannel_ratio, speaking_fraction, role): the track of a recording whose words are most often one of the ``tokens`` is its host, the others are guests.

    ``words`` (keys, track, token, start, end). The host's ratio must be at least ``least`` times the next one's, else all are ``undecided``; of equal ratios the track that speaks less comes first, then the
    name. The fraction is of ``duration`` (a column of ``words``), or of all that the recording's tracks say.
    """
    said = F.sum(F.col("end") - F.col("start"))
    totals = words.groupBy(*keys, track).agg((F.count_if(F.col("token").isin(*tokens)) / F.count("*")).alias("backchannel_ratio"), said.alias("_said"), *([F.max(duration).alias("_whole")] if duration is not None else []))
    own = Window.partitionBy(*keys)
    whole = F.col("_whole") if duration is not None else F.sum("_said").over(own)
    shared = totals.withColumn("speaking_fraction", F.try_divide(F.col("_said"), whole))
    order = own.orderBy(F.desc("backchannel_ratio"), "speaking_fraction", track)
    ranked = shared.withColumns({"_place": F.row_number().over(order), "_next": F.lead("backchannel_ratio").over(order)})
    decided = ranked.withColumn("_sure", F.max(F.when(F.col("_place") == 1, (F.col("backchannel_ratio") > 0) & (F.col("backchannel_ratio") >= least * F.coalesce("_next", F.lit(0.0))))).over(own))
    role = F.when(~F.col("_sure"), "undecided").when(F.col("_place") == 1, "host").otherwise("guest")
    return decided.select(*keys, track, "backchannel_ratio", "speaking_fraction", role.alias("role"))
