"""Table functions for SQL: a table goes in by key and in order, rows come out as they are made."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

#: A pause from which a clause ends, and a frame, in ms: fixed values.
PAUSE_MS, FRAME_MS = 600, 100
SIGNS = (".", "?", "!")


@udtf(returnType="key string, clause int, first_pos bigint, last_pos bigint, start bigint, end bigint, words array<string>")
class Clauses:
    """Words (key, pos, word, start, end) of a partition, in order of pos, as clauses: one ends with a word that ends in a sign, or where PAUSE_MS or more pass before the next.

    A clause starts with its first word and ends with the latest end of its words. Only the clause that is open is held. Nulls: a null time is no pause, a null word is a word without a sign; an empty partition gives no rows.
    """

    def __init__(self) -> None:
        self.number, self.words = 0, []

    def eval(self, row: Row) -> Iterator[tuple]:
        last = self.words[-1] if self.words else None
        if last is not None and last["end"] is not None and row["start"] is not None and row["start"] - last["end"] >= PAUSE_MS:
            yield self.closed()
        self.words.append(row)
        if (row["word"] or "").endswith(SIGNS):
            yield self.closed()

    def terminate(self) -> Iterator[tuple]:
        if self.words:
            yield self.closed()

    def closed(self) -> tuple:
        first, last, number = self.words[0], self.words[-1], self.number
        end = max((w["end"] for w in self.words if w["end"] is not None), default=None)
        made = (str(first["key"]), number, first["pos"], last["pos"], first["start"], end, [w["word"] for w in self.words])
        self.number, self.words = number + 1, []
        return made


@udtf(returnType="key string, frame bigint, covered bigint")
class Frames:
    """Words (key, start, end) as the frames of FRAME_MS that each touches, with how much of a frame it covers. A word without times or of no length touches none."""

    def eval(self, row: Row) -> Iterator[tuple]:
        start, end = row["start"], row["end"]
        if start is not None and end is not None:
            for frame in range(start // FRAME_MS, -(-end // FRAME_MS)) if start < end else ():
                yield str(row["key"]), frame, min(end, (frame + 1) * FRAME_MS) - max(start, frame * FRAME_MS)


#: Every function of this library that SQL can name; ``register`` makes them known.
TABLE_FUNCTIONS = {"clauses": Clauses, "frames": Frames}


def register(spark: SparkSession) -> list[str]:
    """Registers all table functions for SQL in this session; their names."""
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, made)
    return list(TABLE_FUNCTIONS)
