"""Conversions of nanoseconds, 100-nanosecond ticks and seconds; integers truncate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticks_to_ns(t: Column) -> Column:
    return t.cast("long") * 100


def ns_to_ticks(t: Column) -> Column:
    return trunc_div(t.cast("long"), 100)


def trunc_div(a: Column, n: int) -> Column:
    """Integer quotient, truncated towards zero."""
    return F.call_function("div", a, F.lit(n).cast("long"))


def ns_to(t: Column, unit: str) -> Column:
    """Whole seconds, milliseconds or microseconds of nanoseconds."""
    return trunc_div(t.cast("long"), {"s": 1_000_000_000, "ms": 1_000_000, "us": 1000}[unit])


def seconds_since(t: Column, t0: Column) -> Column:
    return (t - t0).cast("double") * 1e-9


def ns_to_timestamp(t: Column) -> Column:
    """Timestamp of nanoseconds since 1970; microseconds are kept."""
    return F.timestamp_micros(trunc_div(t.cast("long"), 1000))


def timestamp_to_ns(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) * 1000


def date_text(t: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ns_to_timestamp(t), fmt)
