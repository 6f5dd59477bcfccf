"""The training-data pipeline: five stages over ``documents``.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutloom.llm import mixing, near, packing, secrets, toxicity
from cutloom.llm.common import free_names, written
from cutloom.tables import table

#: Copies that the mixture takes of a document of a small source at most.
MAX_REPEATS = 2.0


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold.

    The model learns from ``labels`` outside the held-out fold. Null, empty and wordless texts score 0 and stay; rows with one
    id or without an id are judged each; very long texts are read whole; an empty table stays empty; further columns pass through."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score, offending = free_names(docs, "score", "offending")
    return toxicity.scored(docs, model, score=score, offending=offending).where(f"{score} < {toxicity.THRESHOLD}").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; candidates by SimHash.

    The smallest id stays (null ids last), of equal ids the smallest text hash, of equal rows one. Texts without words, null ones too, are one
    group; very long texts are read whole; an empty table stays empty; further columns pass through."""
    return near.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark and their lengths counted anew.

    Null texts stay null and have a null length; repeated rows and rows without an id are redacted each alike; very long texts whole; an
    empty table stays empty; further columns pass through."""
    return secrets.redacted(docs).selectExpr(*(c if c != "n_chars" else "CAST(char_length(text) AS BIGINT) AS n_chars" for c in docs.columns))


def with_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources repeated to flatten the mixture; none is left out.

    Null sources are one source; texts without words, null ones too, come once where their source has no others; rows with one id, or without an
    id, come equally often; an empty table stays empty; further columns pass through."""
    return mixing.mixed(docs, max_repeats=MAX_REPEATS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, and their places in sequences; ``row_id`` tells the copies of one document apart.

    Null and empty texts are one piece with the end mark alone; rows with one id or without an id are packed each; very long texts are cut into
    whole sequences and a rest; an empty table gives no rows; further columns are ignored."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("source_mixing", with_target_weights),
    ("best_fit_packing", packed),
]
#: SQL has no words for the model, the fingerprints' components or the tokenizer; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, name)
    return docs
