"""Time expressions on TIMESTAMP_NTZ columns that hold UTC wall-clock time."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# Buckets are aligned to Monday 2000-01-03 00:00 UTC.
BUCKET_ORIGIN_SECONDS = 946_857_600


def utc_literal(value: datetime | str | Column) -> Column:
    """A TIMESTAMP_NTZ literal in UTC; aware datetimes are converted, naive ones kept."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def in_range(
    ts: Column, start: datetime | str | Column | None, end: datetime | str | Column | None
) -> Column:
    """Half-open ``start <= ts < end``; a bound left out is open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= utc_literal(start))
    if end is not None:
        keep = keep & (ts < utc_literal(end))
    return keep


def bucket_start(ts: Column, width_seconds: int) -> Column:
    """Start of the tumbling bucket holding ``ts`` for one fixed width."""
    width = max(1, int(width_seconds))
    offset = BUCKET_ORIGIN_SECONDS % width
    return F.window(ts, f"{width} seconds", startTime=f"{offset} seconds")["start"]


def bucket_start_by(ts: Column, width_seconds: Column) -> Column:
    """As :func:`bucket_start`, with the width taken from another column."""
    width = width_seconds.cast("long") * 1_000_000
    origin = F.lit(BUCKET_ORIGIN_SECONDS * 1_000_000).cast("long")
    since = epoch_micros(ts) - origin
    return micros_to_ts(since - F.pmod(since, width) + origin)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def micros_to_ts(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def floor_div(value: Column, divisor: int) -> Column:
    """Integer division rounding down, without going through double."""
    step = F.lit(divisor).cast("long")
    return F.call_function("div", value - F.pmod(value, step), step)


def ns_to_ts(ts_ns: Column) -> Column:
    """Nanoseconds since the epoch to microsecond timestamps, rounding down."""
    return micros_to_ts(floor_div(ts_ns, 1000))


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """ISO-8601 UTC text: six fraction digits, or none when the fraction is zero."""
    text = F.translate(ts.cast("timestamp_ntz").cast("string"), " ", "T")
    padded = F.when(F.instr(text, ".") > 0, F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(padded, F.lit("+00:00"))


def iso_text_ns(ts_ns: Column) -> Column:
    """ISO-8601 UTC text of nanoseconds since the epoch, always nine fraction digits."""
    fraction = F.pmod(ts_ns, F.lit(1_000_000_000).cast("long"))
    seconds = floor_div(ts_ns, 1_000_000_000)
    whole = F.timestamp_seconds(seconds).cast("timestamp_ntz").cast("string")
    return F.concat(
        F.translate(whole, " ", "T"),
        F.lit("."),
        F.lpad(fraction.cast("string"), 9, "0"),
        F.lit("+00:00"),
    )
