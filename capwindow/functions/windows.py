"""Epoch-aligned tumbling windows in integer seconds."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from capwindow.schema import EXPIRY_GRACE


def window_start(t: Column, bs: Column) -> Column:
    return t - t % bs


def window_end(t: Column, bs: Column) -> Column:
    """The last second of t's window."""
    return window_start(t, bs) + bs - 1


def expired(t: Column, bs: Column, now: Column) -> Column:
    return now > window_end(t, bs)


def collectable(t: Column, bs: Column, now: Column) -> Column:
    """Expired for longer than the grace period."""
    return now > window_end(t, bs) + EXPIRY_GRACE


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a time stamp without zone, whatever the session's zone."""
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def register(spark: SparkSession) -> None:
    """SQL functions of the same names."""
    for name, args, body in (
        ("window_start", "t BIGINT, bs BIGINT", "t - t % bs"),
        ("window_end", "t BIGINT, bs BIGINT", "t - t % bs + bs - 1"),
        ("window_expired", "t BIGINT, bs BIGINT, now BIGINT", "now > t - t % bs + bs - 1"),
    ):
        kind = "BOOLEAN" if name == "window_expired" else "BIGINT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
