"""Integer arithmetic between microseconds, frames and rates, and clock strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.schemas import SAMPLE_RATE_HZ

MICROS = 1_000_000


def col(column: Column | str | int) -> Column:
    if isinstance(column, int):
        return F.lit(column).cast("bigint")
    return F.col(column) if isinstance(column, str) else column


def div(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer division on BIGINT."""
    return F.call_function("div", col(a), col(b))


def scale_floor(value, numerator, denominator) -> Column:
    """floor(value * numerator / denominator) without overflowing on value * numerator."""
    v, n, d = col(value).cast("bigint"), col(numerator).cast("bigint"), col(denominator).cast("bigint")
    return div(v, d) * n + div((v % d) * n, d)


def scale_ceil(value, numerator, denominator) -> Column:
    v, n, d = col(value).cast("bigint"), col(numerator).cast("bigint"), col(denominator).cast("bigint")
    return div(v, d) * n + div((v % d) * n + d - 1, d)


def duration_us(frames, rate_hz) -> Column:
    """Whole microseconds in so many frames, rounded down; 0 where the rate is 0."""
    rate = col(rate_hz)
    return F.when(rate == 0, col(0)).otherwise(scale_floor(frames, MICROS, rate))


def sample_floor(time_us, rate_hz: int = SAMPLE_RATE_HZ) -> Column:
    return scale_floor(time_us, rate_hz, MICROS)


def sample_ceil(time_us, rate_hz: int = SAMPLE_RATE_HZ) -> Column:
    return scale_ceil(time_us, rate_hz, MICROS)


def frames_in(time_us, rate_hz) -> Column:
    return scale_floor(time_us, rate_hz, MICROS)


def midpoint(start_us, end_us) -> Column:
    return col(start_us) + div(col(end_us) - col(start_us), 2)


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Half-open ranges share at least one microsecond; touching ends do not count."""
    return (col(a_start) < col(b_end)) & (col(b_start) < col(a_end))


def whole_number(text: Column, sql_type: str = "bigint") -> Column:
    """Unsigned decimal digits (an optional plus sign) as a number, null for anything else."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast(sql_type))


def decimal_seconds_us(text: Column) -> Column:
    """``12.345678`` as microseconds: the dot is required, digits past six are cut, not rounded."""
    whole = F.regexp_extract(text, r"^(\+?[0-9]+)\.[0-9]*$", 1)
    fraction = F.regexp_extract(text, r"^\+?[0-9]+\.([0-9]*)$", 1)
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint")
    seconds = whole.try_cast("decimal(20,0)")
    total = (seconds * MICROS + micros).try_cast("bigint")
    return F.when(whole != "", total)


def clock_sum_us(hours: Column, minutes: Column, seconds: Column) -> Column:
    """Hours, minutes and decimal seconds of a clock as microseconds, null where one is malformed."""
    total = (
        whole_number(hours).cast("decimal(20,0)") * 3_600_000_000
        + whole_number(minutes).cast("decimal(20,0)") * 60_000_000
        + decimal_seconds_us(seconds)
    )
    return total.try_cast("bigint")
