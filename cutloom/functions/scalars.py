"""Column functions: times, ratios, vectors, hashes and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a time that occur in the logs.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def parsed_time(text: Column) -> Column:
    """A timestamp from any of TIME_FORMATS, null from anything else; zoneless ones are in the session's zone."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    seconds = F.unix_date(F.to_date(ts)) * F.lit(86400).cast("bigint") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def to_samples(ms: Column, rate: int = 48_000) -> Column:
    """Milliseconds as whole samples; exact for rates of whole samples a millisecond."""
    return F.round(ms * F.lit(rate) / 1000).cast("bigint")


def exact_avg(number: str) -> Column:
    """The average of a double column, the same in whatever order rows come: a sum of decimals of ten places. Values that have no such decimal make it the plain average."""
    each = F.col(number).try_cast("decimal(38,10)")
    total = F.when(F.count(each) == F.count(number), F.try_sum(each)).cast("double")
    return F.coalesce(total / F.count(number), F.avg(number))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns' values as JSON, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def as_list(x: Column) -> Column:
    """A field that holds one string or a JSON list of them, as an array."""
    return F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x))
