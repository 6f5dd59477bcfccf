"""Checks of a registry against what is there: names used, declared, installed and listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.sources.logs import manifest


def imported_names(sources: DataFrame, skipped: list[str]) -> DataFrame:
    """Top modules (name) that source files (path, text) import; files below a ``skipped`` folder are left out."""
    kept = sources.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))) if skipped else sources
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w., \t]+))"), F.lit(0))
    said = F.explode(lines).alias("line")
    names = kept.select(said).select(F.explode(F.split(F.regexp_replace(F.regexp_replace("line", r"^\s*(?:from|import)\s+", ""), r"\s+(?:import|as)\b[^,]*", ""), r"[,\s]+")).alias("n"))
    return names.where("n <> ''").select(F.lower(F.element_at(F.split("n", r"\."), 1)).alias("name")).distinct()


def declared_names(top: DataFrame, tools: DataFrame, stop: list[str]) -> DataFrame:
    """Names (name) that a registry declares: each entry of its ``top`` level (entry: a string taken whole, or a JSON object with a name), and the parts of each tool's entries.

    The entries of ``tools`` (entry) are parted at blanks and version signs; whole numbers and ``stop`` words are no names, but a version with a dot stays.
    """
    named = F.when(F.startswith("entry", F.lit("{")), F.get_json_object("entry", "$.name")).otherwise(F.col("entry"))
    whole = top.select(F.lower(named).alias("name")).where("name IS NOT NULL")
    parts = tools.select(F.explode(F.split(F.lower("entry"), r"[\s:>=<,]+")).alias("name"))
    parts = parts.where((F.col("name") != "") & ~F.col("name").rlike("^[0-9]+$") & ~F.col("name").isin(*stop))
    return whole.union(parts).distinct()


def normal(name: Column) -> Column:
    """A package name as it is compared: lower case, '-' for '_'."""
    return F.translate(F.lower(name), "_", "-")


def dependency_gaps(installed: DataFrame, used: DataFrame, declared: DataFrame, aliases: DataFrame, standard: DataFrame, unused_allowed: DataFrame | None = None) -> DataFrame:
    """(name, problem): installed but unused, and used but undeclared names.

    ``aliases`` (import_name, package) says which package an import comes from; names of the ``standard`` library need neither use nor
    declaration, those of ``unused_allowed`` no use, but a declaration if they are used. All others have a column name.
    """
    as_package = used.join(aliases, used["name"] == aliases["import_name"], "left").select(normal(F.coalesce("package", "name")).alias("name")).distinct()
    have, said, free = (df.select(normal(F.col("name")).alias("name")).distinct() for df in (installed, declared, standard))
    unused = have.join(as_package, "name", "left_anti").join(free, "name", "left_anti").withColumn("problem", F.lit("unused"))
    if unused_allowed is not None:
        unused = unused.join(unused_allowed.select(normal(F.col("name")).alias("name")).distinct(), "name", "left_anti")
    undeclared = as_package.join(said, "name", "left_anti").join(free, "name", "left_anti").join(have, "name", "left_semi").withColumn("problem", F.lit("undeclared"))
    return unused.union(undeclared)


def verdict(problems: DataFrame) -> DataFrame:
    """One row: n_undeclared, n_unused, verdict (FAIL with the former, WARN with the latter, else PASS)."""
    counts = problems.agg(F.count_if(F.col("problem") == "undeclared").alias("n_undeclared"), F.count_if(F.col("problem") == "unused").alias("n_unused"))
    return counts.withColumn("verdict", F.when(F.col("n_undeclared") > 0, "FAIL").when(F.col("n_unused") > 0, "WARN").otherwise("PASS"))


def registered_paths(tools: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Paths (path) of a registry, one for each of ``columns`` that is given, without a leading ``prefix``."""
    said = F.explode(F.array_compact(F.array(*columns)))
    return tools.select(said.alias("p")).select(F.when(F.startswith("p", F.lit(prefix)), F.substring(F.col("p"), F.lit(len(prefix) + 1), F.char_length("p"))).otherwise(F.col("p")).alias("path"))


def resolved(paths: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """``paths`` (path, …) with ``file``: the first of the ``roots``, in their order, below which it is among ``files`` (path), with that root before it; null where it is below none.

    Each path is looked up below every root by an equi-join; an absolute path is looked up as it is.
    """
    tried = F.posexplode(F.when(F.startswith("path", F.lit("/")), F.array("path")).otherwise(F.array(*(F.concat(F.lit(r), "path") for r in roots))))
    wanted = paths.select("path").distinct().select(F.col("path").alias("_path"), tried.alias("_n", "file"))
    there = wanted.join(files.select(F.col("path").alias("file")).distinct(), "file").groupBy("_path").agg(F.min_by("file", "_n").alias("file"))
    return paths.join(there, F.col("path") == F.col("_path"), "left").drop("_path")


def allowed_paths(allowlists: DataFrame) -> DataFrame:
    """The files (path) of all buckets of allowlists (buckets: map to structs with an array ``files``)."""
    return allowlists.select(F.explode(F.map_values("buckets")).alias("b")).select(F.explode("b.files").alias("path")).distinct()


def without_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Files (path) whose base name does not begin with ``prefix``."""
    return files.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(prefix)))


def unregistered(files: DataFrame, registered: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files (path) that no registered path, no registered base name and no allowed path matches: one anti-join each."""
    base = F.element_at(F.split("path", "/"), -1)
    names = registered.select(base.alias("base")).distinct()
    return files.withColumn("base", base).join(registered.select("path"), "path", "left_anti").join(names, "base", "left_anti").join(allowed.select("path"), "path", "left_anti").drop("base")


def statuses(texts: DataFrame, known: list[str]) -> DataFrame:
    """(status, n, bad) of the first ``status:`` line of each text; missing ones are 'none', those not ``known`` are bad."""
    found = F.regexp_extract("text", r"(?m)^status:\s*(\w+)", 1)
    status = F.when(found == "", "none").otherwise(found)
    return texts.groupBy(status.alias("status")).agg(F.count("*").alias("n")).withColumn("bad", ~F.col("status").isin(*known))


def governed(registry: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """One row for a registry: n, n_unknown (rows whose ``column`` is null or not among ``allowed``), verdict (FAIL with such rows), sha256 (the digest of all rows, whatever their order, to be frozen into a run)."""
    unknown = F.count_if(F.coalesce(~F.col(column).isin(*allowed), F.lit(True)))
    digest = manifest(registry, registry.columns[0]).where("key = '*'").select("sha256")
    counts = registry.agg(F.count("*").alias("n"), unknown.alias("n_unknown"))
    both = counts.withColumn("_one", F.lit(1)).join(digest.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return both.select("n", "n_unknown", F.when(F.col("n_unknown") > 0, "FAIL").otherwise("PASS").alias("verdict"), "sha256")


def in_order(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Checks in the order given, up to the first that fails: place, layer, n_bad, verdict.

    A check is the table of what it finds bad and what that means, FAIL or WARN; one that finds nothing is a PASS. All are counted in one plan.
    """
    counted = [bad.agg(F.count("*").alias("n_bad")).select(F.lit(i).alias("place"), F.lit(name).alias("layer"), "n_bad", F.when(F.col("n_bad") > 0, level).otherwise("PASS").alias("verdict")) for i, (name, (bad, level)) in enumerate(checks.items(), 1)]
    every = reduce(DataFrame.unionByName, counted)
    # a row a check, so one task holds them all
    before = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("_failed", F.max(F.col("verdict") == "FAIL").over(before)).where("NOT coalesce(_failed, false)").drop("_failed")
