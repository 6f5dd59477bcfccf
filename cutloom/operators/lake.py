"""The label lake: decisions rolled up by reason, subtype and token, looked up, compared and searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LEVELS = ["reason_key", "subtype", "filler_token"]


def label_lake(decisions: DataFrame, levels: list[str] = LEVELS, excluded: DataFrame | None = None) -> DataFrame:
    """level (0: all), the ``levels``, accept, reject, total, accept_rate (3 places).

    ``decisions``: the levels and ``accepted`` (boolean); a null level is 'unknown' (so it is not taken for a subtotal), a null
    decision counts for nothing. Rows of ``excluded`` reviewers (reviewer) are left out.
    """
    rows = decisions.join(excluded.select("reviewer").distinct(), "reviewer", "left_anti") if excluded is not None else decisions
    rows = rows.where("accepted IS NOT NULL").withColumns({c: F.coalesce(c, F.lit("unknown")) for c in levels})
    rolled = rows.rollup(*levels).agg(F.grouping_id().alias("gid"), F.count_if("accepted").alias("accept"), F.count_if(~F.col("accepted")).alias("reject"), F.count("*").alias("total"))
    # the grouping id of a rollup is 2^k - 1 where k levels are summed over
    level = F.lit(len(levels)) - F.log2(F.col("gid") + 1).cast("int")
    return rolled.select(level.cast("int").alias("level"), *levels, "accept", "reject", "total", F.round(F.col("accept") / F.col("total"), 3).alias("accept_rate"))


def leaf_cases(decisions: DataFrame, case_id: str, levels: list[str] = LEVELS) -> DataFrame:
    """The decided cases with their leaf's accept, reject, total and accept_rate: ``case_id``, levels, counts. Null levels are 'unknown'; a row a case, so
    no leaf's cases are gathered."""
    rows = decisions.where("accepted IS NOT NULL").withColumns({c: F.coalesce(c, F.lit("unknown")) for c in levels})
    leaves = rows.groupBy(*levels).agg(F.count_if("accepted").alias("accept"), F.count_if(~F.col("accepted")).alias("reject"), F.count("*").alias("total"))
    leaves = leaves.withColumn("accept_rate", F.round(F.col("accept") / F.col("total"), 3))
    return rows.select(*levels, case_id).join(leaves, levels)


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that ``old`` has more often than ``new`` (change: removed) and the other way (added), each as often as that."""
    return old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


def looked_up_rate(cases: DataFrame, lake: DataFrame) -> DataFrame:
    """``cases`` (reason_key, subtype, filler_token) with rate and rate_level of the most special lake row there is."""
    part = lambda level, cols: lake.where(F.col("level") == level).select(*(F.col(c).alias(f"_{level}{c}") for c in cols), F.col("accept_rate").alias(f"_rate{level}"))
    found = cases
    for level in (3, 2, 1):
        cols = LEVELS[:level]
        on = None
        side = part(level, cols)
        for c in cols:
            test = F.coalesce(found[c], F.lit("unknown")) == side[f"_{level}{c}"]
            on = test if on is None else on & test
        found = found.join(side, on, "left")
    rate_level = F.when(F.col("_rate3").isNotNull(), 3).when(F.col("_rate2").isNotNull(), 2).when(F.col("_rate1").isNotNull(), 1).otherwise(0)
    return found.withColumns({"rate": F.coalesce("_rate3", "_rate2", "_rate1"), "rate_level": rate_level}).select(*cases.columns, "rate", "rate_level")


def suggestion(rate: Column, total: Column, least_total: int = 5, cut: float = 0.8, keep: float = 0.2) -> Column:
    """A three-valued proposal from history; too little of it asks for a person."""
    return F.when(total.isNull() | (total < least_total), "HUMAN_REVIEW_REQUIRED").when(rate >= cut, "MACHINE_CUT_SUGGESTED").when(rate <= keep, "MACHINE_PRESERVE_SUGGESTED").otherwise("HUMAN_REVIEW_REQUIRED")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full comparison of two runs: key, old_value, new_value, change (added, removed, changed, same)."""
    a, b = old.select(F.col(key), F.col(value).alias("old_value"), F.lit(True).alias("_a")), new.select(F.col(key), F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "old_value", "new_value", change.alias("change"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn."""
    return rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
