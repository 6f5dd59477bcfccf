"""Rules that name a pattern of text: one automaton over all patterns reads each text once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns that one automaton is made of; of more patterns, several are made and each reads the texts.
MOST_CHARS = 5_000_000


def read_by(texts: DataFrame, patterns: list[str], keys: list[str], text: str) -> DataFrame:
    """(keys, pattern) of ``texts`` for patterns that a task can hold."""
    held = texts.sparkSession.sparkContext.broadcast(patterns)

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern in held.value:
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        for batch in batches:
            yield pa.array([list({pattern for _, pattern in automaton.iter(x.as_py() or "")}) for x in batch], pa.list_(pa.string()))

    return texts.select(*keys, F.explode(found(F.col(text))).alias("pattern"))


def pattern_hits(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """(keys, pattern): the ``patterns`` (pattern) that occur in each row's text, each once a row.

    Patterns are strings, matched as they are; they may overlap or lie within one another. Null and empty ones and null texts have no hits. The patterns come to
    the driver in parts of about ``most_chars`` characters, dealt by hash; each part is one pass over the texts.
    """
    known = patterns.where("pattern <> ''").select("pattern").distinct()
    chars = known.agg(F.sum(F.char_length("pattern"))).first()[0] or 0
    parts = -(-chars // most_chars)
    dealt = lambda i: [r["pattern"] for r in known.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i).collect()]
    return reduce(DataFrame.union, (read_by(texts, dealt(i), keys, text) for i in range(parts))) if parts else texts.where("false").select(*keys, F.lit("").alias("pattern"))
