"""Time expressions. Instants are compared as epoch microseconds (BIGINT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

# An instant must end in Z or a numeric UTC offset.
OFFSET_PATTERN = r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"
# Spellings accepted by the tolerant parser, tried in order.
TOLERANT_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
                    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")


def micros(column: str | Column) -> Column:
    """Epoch microseconds of a timestamp (the session runs in UTC, so NTZ values agree)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def as_micros(df: DataFrame, column: str) -> Column:
    """``column`` as BIGINT micros, whether it is a timestamp or already a number."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(column)
    return F.col(column).cast("bigint")


def from_micros_ntz(column: Column) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz")


def shift(column: str | Column, *, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """A timestamp moved by a fixed interval, keeping its type."""
    column = F.col(column) if isinstance(column, str) else column
    return column + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    """Exact elapsed time in days as a double (never whole calendar units)."""
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_US))


def parse_strict(column: str | Column) -> Column:
    """An instant with an explicit UTC offset; anything else is NULL (rejected)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.rlike(OFFSET_PATTERN), F.try_to_timestamp(column))


def parse_tolerant(column: str | Column) -> Column:
    """Mixed ISO spellings; a value without an offset is read as UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in TOLERANT_FORMATS])


def canonical(column: Column) -> Column:
    """The one spelling written back out."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def local_to_utc(column: str | Column, zone: str = "America/New_York") -> Column:
    """Wall clock in ``zone`` to UTC, result kept as NTZ (ambiguous = daylight, gap = forward)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), column.cast("timestamp_ntz"))


def utc_to_local(column: str | Column, zone: str = "America/New_York") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), column.cast("timestamp_ntz"))


def epoch_block(column: str | Column, days: int = 7) -> Column:
    """Absolute block number: whole ``days``-long blocks since the epoch."""
    return F.floor(micros(column) / F.lit(days * DAY_US)).cast("bigint")
