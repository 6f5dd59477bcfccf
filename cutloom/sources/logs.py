"""Readers and writers: JSON documents, JSON-lines logs, texts, run folders, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.functions.scalars import as_list, content_hash, parsed_time

#: One schema a document kind; nothing is inferred, so a field that is a string here and a list there keeps its column.
FEEDBACK = "schema_version STRING, timestamp STRING, episode_id STRING, reviewer STRING, source STRING, kind STRING, candidate_pattern STRUCT<filler_token STRING, reason_key STRING, filler_subtype STRING, speaker_role STRING, context STRING, kind STRING, any BOOLEAN>, verdict STRING, note STRING, action_taken STRING, case_ref STRUCT<candidate_id STRING, source_file STRING>, _corrupt_record STRING"
LEAF = "STRUCT<accept BIGINT, reject BIGINT, total BIGINT, accept_rate DOUBLE, case_ids ARRAY<STRING>>"
LAKE = f"schema_version STRING, by_reason_key MAP<STRING, STRUCT<_subtypes MAP<STRING, STRUCT<_tokens MAP<STRING, {LEAF}>, accept BIGINT, reject BIGINT, total BIGINT, accept_rate DOUBLE>>, accept BIGINT, reject BIGINT, total BIGINT, accept_rate DOUBLE>>"
CASE = "row INT, case_id STRING, clip_id STRING, start DOUBLE, end DOUBLE, wav_path STRING, verdict STRING, note STRING"
CASE_NOTE = "reason_key STRING, episode STRING, track STRING, risk ARRAY<STRING>, deleted_text STRING"
DECISIONS = "run_id STRING, reviewer STRING, decisions ARRAY<STRUCT<clip_id STRING, verdict STRING, note STRING, decided_at STRING>>"
WORDS = "track STRING, words ARRAY<STRUCT<word STRING, start DOUBLE, end DOUBLE, probability DOUBLE>>"
TOOLS = "tools ARRAY<STRUCT<name STRING, description STRING, params ARRAY<STRING>, reads_only BOOLEAN, full_path STRING, script STRING, wraps_script STRING>>"


def feedback(spark: SparkSession, *paths: str) -> DataFrame:
    """Feedback rules of JSON-lines files; both spellings of a token or reason become lists, all spellings of a time one timestamp."""
    rows = spark.read.schema(FEEDBACK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(list(paths))
    pattern = F.col("candidate_pattern")
    return rows.withColumns({"ts": parsed_time(F.col("timestamp")), "tokens": as_list(pattern["filler_token"]), "reasons": as_list(pattern["reason_key"]), "context": pattern["context"]})


def lake_rows(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a lake document: reason_key, subtype, filler_token, accept, reject, total, accept_rate, case_ids."""
    doc = spark.read.schema(LAKE).option("multiLine", True).json(path)
    reasons = doc.select(F.explode("by_reason_key").alias("reason_key", "r"))
    subtypes = reasons.select("reason_key", F.explode("r._subtypes").alias("subtype", "s"))
    return subtypes.select("reason_key", "subtype", F.explode("s._tokens").alias("filler_token", "t")).select("reason_key", "subtype", "filler_token", "t.*")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a case index, with the JSON of their notes read."""
    return spark.read.schema(CASE).json(path).withColumn("n", F.from_json("note", CASE_NOTE)).select("*", "n.*").drop("n")


def decisions(spark: SparkSession, root: str, name: str = "*decisions.json", lines: bool = False) -> DataFrame:
    """All decisions of the files that match ``name`` anywhere below ``root``: run_id, reviewer, clip_id, verdict, note, decided_at. A file is one document, or with ``lines`` one in each line."""
    rows = spark.read.schema(DECISIONS).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return rows.select("run_id", "reviewer", F.explode("decisions").alias("d")).select("run_id", "reviewer", "d.clip_id", "d.verdict", "d.note", parsed_time(F.col("d.decided_at")).alias("decided_at"))


def tools(spark: SparkSession, path: str) -> DataFrame:
    """One row a registered tool, with ``path``: its full path, else its script, else null."""
    rows = spark.read.schema(TOOLS).option("multiLine", True).json(path).select(F.explode("tools").alias("t")).select("t.*")
    return rows.withColumn("path", F.coalesce("full_path", "script"))


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files below ``root``."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def word_rows(documents: DataFrame) -> DataFrame:
    """The words of transcripts (text: a JSON document with track and timed words, and any other columns): all other columns, track, pos, word, start and end in ms, probability, fault.

    ``fault`` says what a word lacks: its text, its times, an end after its start, or a probability from 0 to 1 where one is given; null if nothing. A text
    that is no such document, or has no words, is one row with the fault ``no_document`` or ``no_words`` and no position.
    """
    read = documents.withColumn("_t", F.from_json("text", WORDS)).drop("text")
    each = read.select(*read.drop("_t").columns, F.col("_t.track").alias("track"), F.posexplode_outer("_t.words").alias("_n", "_w"), F.col("_t.words").isNull().alias("_none"))
    ms = lambda name: F.round(F.col(f"_w.{name}") * 1000).cast("bigint").alias(name)
    timed = each.select(*each.drop("_n", "_w").columns, (F.col("_n") + 1).alias("pos"), F.col("_w.word").alias("word"), ms("start"), ms("end"), F.col("_w.probability").alias("probability"))
    fault = F.when(F.col("_none"), "no_document").when(F.col("pos").isNull(), "no_words").when(F.coalesce("word", F.lit("")) == "", "no_word").when(F.col("start").isNull() | F.col("end").isNull(), "no_time").when(F.col("end") < F.col("start"), "order").when(~F.col("probability").between(0, 1), "probability")
    return timed.withColumn("fault", fault).drop("_none")


def words(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """The words of all transcripts below ``root``, with the path of each."""
    return word_rows(texts(spark, root, pattern))


def write_version(rows: DataFrame, root: str, version: int) -> None:
    """Writes one version of a table below ``root``; a version that is there already is an error."""
    write_run(rows, f"{root}/version={version}")


def frozen(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, DataFrame]:
    """A version of a table, the newest by default, and its number: later versions do not change what a run that holds it reads."""
    if version is None:
        version = spark.read.parquet(root).agg(F.max("version")).first()[0]
    return version, spark.read.parquet(f"{root}/version={version}")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of files below ``root``, whatever they hold; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines log."""
    rows.write.mode("append").json(path)


def write_run(rows: DataFrame, path: str) -> None:
    """Writes a run's table; a run that is there already is an error."""
    rows.write.mode("errorifexists").parquet(path)


def write_current(rows: DataFrame, *paths: str) -> None:
    """Replaces the one current table, at each of ``paths``."""
    for path in paths:
        rows.write.mode("overwrite").parquet(path)


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of every row, and under the key '*' the digest of all rows together, whatever their order."""
    each = rows.select(F.col(key).cast("string").alias("key"), content_hash(*rows.columns).alias("sha256"))
    # a running digest of everything would need one order in one task: sums of the digests' parts do not
    parts = [F.sum(F.conv(F.substring("sha256", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return each.union(each.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("sha256")).select(F.lit("*").alias("key"), "sha256"))


def report(summary: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """Writes a small summary as a Markdown table, as one text file; ``summary`` must have at most ``most`` rows."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", r"\|") for c in cells) + " |"
    lines = [f"# {title}", "", line(summary.columns), line(["---"] * len(summary.columns)), *map(line, rows)]
    summary.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
