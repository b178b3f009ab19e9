"""Sinks: printed streams, long tables for plots, probes for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.core import Stream


def out(prefix: str, s: Stream, rows: int = 20) -> Stream:
    """Prints the first rows in order, and returns the stream."""
    print(prefix)
    s.df.orderBy(*s.order, *s.keys).show(rows, truncate=False)
    return s


def series(s: Stream, value: str, label: str | None = None) -> DataFrame:
    """A plot's data as a long table ``series, ts, value``, one series per key."""
    name = F.concat_ws("/", *s.keys) if s.keys else F.lit(label or value)
    return s.df.select(name.alias("series"), F.col(s.order[0]).alias("ts"), F.col(value).alias("value"))


def table_view(s: Stream) -> DataFrame:
    """Latest value per key, sortable."""
    from streamloom.operators.vector import entries

    return entries(s).orderBy(*s.keys)


def emitted(s: Stream, *columns: str) -> list:
    """All values in order: for tests over small streams only."""
    rows = s.df.orderBy(*s.order, *s.keys).select(*(columns or s.values)).collect()
    return [r[0] if len(r) == 1 else tuple(r) for r in rows]


def trace(s: Stream) -> str:
    """The plan that Spark makes of a stream."""
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as text:
        s.df.explain("formatted")
    return text.getvalue()
