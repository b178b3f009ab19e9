"""Several inputs in one bucket: all that fires in one cycle is one row before anything is folded."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.operators.joins import KeyMap, _fan_out


def bind(first: Stream, *others: Stream, key_map: KeyMap = None) -> Stream:
    """One row per key and cycle with the value columns of every input, null where it didn't fire.
    Column names must differ; aggregates skip the nulls. Inputs share keys, or are sent to the keys of the
    first by ``key_map``."""
    names = [c for s in (first, *others) for c in s.values]
    if len(set(names)) < len(names):
        raise ValueError("inputs share column names")
    parts = [first.df, *[_fan_out(first, o, key_map) for o in others]]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    merged = union.groupBy(*first.keys, *first.order).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    return replace(first, df=merged)
