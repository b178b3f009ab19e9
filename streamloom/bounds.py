"""Checks that come before any broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small; else ``df`` as it is, so that the join shuffles."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def second_of_day(time: Column) -> Column:
    """Seconds since midnight of a timestamp, free of time zones for ``timestamp_ntz``."""
    return F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def clock_slice(time: Column, seconds: int) -> Column:
    """Number of the ``seconds``-long slice of the day that ``time`` falls in. Entity, date and slice
    together are a partitioning key that keeps a hot entity from landing in one task."""
    return F.floor(second_of_day(time) / seconds).cast("int")


def one_of_copies(df: DataFrame, seq: str) -> DataFrame:
    """Of rows equal in all columns but ``seq``, the one with the smallest ``seq``. Column order is kept.
    Needs no exchange where ``df`` is already partitioned by a subset of the other columns."""
    others = [c for c in df.columns if c != seq]
    return df.groupBy(*others).agg(F.min(seq).alias(seq)).select(*df.columns)
