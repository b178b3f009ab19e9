"""Verbs over the set of keys: key lists, value sets, snapshots over all keys, per-key sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.order import numbers


def entries(s: Stream) -> DataFrame:
    """Keys and their latest values."""
    latest = s.df.groupBy(*s.keys).agg(F.max_by(F.struct(*s.values), F.struct(*s.order)).alias("__v"))
    return latest.select(*s.keys, "__v.*")


def key_set(s: Stream) -> Stream:
    """One row per key at its first event, the key as its value."""
    first = s.df.groupBy(*s.keys).agg(F.min(F.struct(*s.order)).alias("__o"))
    return s.with_df(first.select(*s.keys, "__o.*", *[F.col(k).alias(f"{k}_value") for k in s.keys]))


def key_list(s: Stream, name: str = "key_list") -> Stream:
    """The list of keys so far, at every new key. The list is the value, so it is as long as there are keys."""
    (key,) = s.keys
    firsts = key_set(s).df
    w = Window.orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    return replace(s, keys=(), df=firsts.select(*s.order, F.collect_list(key).over(w).alias(name)))


def value_set(s: Stream, expand: Column, name: str = "value") -> Stream:
    """Every distinct element of ``expand`` (an array) over all keys, at the cycle of its first appearance.
    ``pos`` orders elements of one cycle."""
    rows = s.df.select(*s.order, F.posexplode(expand).alias("pos", name))
    first = rows.groupBy(name).agg(F.min(F.struct(*s.order, "pos")).alias("__o"))
    return Stream(first.select("__o.*", name), (*s.order, "pos"), (), s.slice)


def key_to_stream(s: Stream, source: Stream) -> Stream:
    """For every key of ``s``, the stream of that key in ``source``."""
    keys = s.df.select(*[F.col(k).alias(b) for k, b in zip(s.keys, source.keys)]).distinct()
    return replace(source, df=source.df.join(keys, list(source.keys), "left_semi"))


def take_by_value(s: Stream, value: str, source: Stream) -> Stream:
    """Values of a stream as keys, and the stream of each from ``source``."""
    return key_to_stream(s.by(**{source.keys[0]: F.col(value)}), source)


def map_vector_sum(s: Stream, name: str = "total", **columns: Column) -> Stream:
    """At every cycle with a change, the sum over all keys' latest values: each event adds its difference
    from its key's value before, and the differences are added up along the order."""
    ((_, value),) = columns.items() or (("", F.col(s.values[0])),)
    valued = s.df.withColumn("__v", value.cast("double"))
    deltas = valued.withColumn("__d", F.coalesce("__v", F.lit(0.0)) - F.coalesce(F.lag("__v").over(s.window_spec()), F.lit(0.0)))
    cycles = deltas.groupBy(*s.order).agg(F.sum("__d").alias("__d"))
    out = Stream(cycles, s.order, (), s.slice).prefix(**{name: ("sum", F.col("__d"), True)})
    return out.with_df(out.df.select(*s.order, name))


def key_count(s: Stream, name: str = "n_keys") -> Stream:
    """Number of keys so far, at every cycle."""
    first = F.when(F.row_number().over(s.window_spec()) == 1, 1).otherwise(0)
    cycles = s.df.withColumn("__new", first).groupBy(*s.order).agg(F.sum("__new").alias("__new"))
    out = Stream(cycles, s.order, (), s.slice).prefix(**{name: ("sum", F.col("__new"), True)})
    return out.with_df(out.df.select(*s.order, name))


def snapshot(s: Stream, value: str, keys: Sequence[object]) -> Stream:
    """At every cycle, the latest values of a stated list of keys, one column per key. For key sets that
    aren't stated or are too many for columns there are ``map_vector`` and, as rows, ``joins.sample``."""
    (key,) = s.keys
    named = {str(k): F.max(F.when(F.col(key) == F.lit(k), F.col(value))) for k in keys}
    cycles = s.df.groupBy(*s.order).agg(*[c.alias(f"__{n}") for n, c in named.items()])
    out = Stream(cycles, s.order, (), s.slice).prefix(**{n: ("last", F.col(f"__{n}"), True) for n in named})
    return out.with_df(out.df.select(*s.order, *[F.col(f"`{n}`") for n in named]))


def map_vector(s: Stream, value: str, f: Callable[[dict], object], name: str, kind: str) -> Stream:
    """At every cycle with a change, any function of all keys' latest values, given as a dict from key to
    value. Slices of the order are worked on side by side: each begins with the values of all keys as they
    stood before it, which makes (keys x slices) rows beside the events."""
    (key,) = s.keys
    # keys are looked at together, so the slices are those of the stream without them
    cut = replace(s, keys=()).sliced()
    rows = _ranked(replace(s, slice=cut.slice), key, value)
    last = rows.groupBy(key, "__slice").agg(F.max_by("__v", F.struct(*s.order)).alias("__v"))
    until = rows.agg(F.max("__slice").alias("__last"))  # one row
    ends = last.withColumn("__next", F.lead("__slice").over(Window.partitionBy(key).orderBy("__slice"))).join(F.broadcast(until))
    carried = numbers(ends, F.col("__slice") + 1, F.coalesce("__next", "__last"), "__to").select(key, F.col("__to").alias("__slice"), "__v")
    state = carried.withColumn("__event", F.lit(False))
    both = rows.withColumn("__event", F.lit(True)).unionByName(state, allowMissingColumns=True)
    order = list(s.order)

    def run(frames):
        import pandas as pd

        at, latest, cycle, shown = None, {}, None, None
        for pdf in frames:
            out = []
            for part, event, k, v, *o in pdf[["__slice", "__event", key, "__v", *order]].itertuples(index=False, name=None):
                if cycle is not None and (part != at or o != cycle):
                    out.append((*cycle, f(latest)))
                    cycle = None
                if part != at:
                    at, latest = part, {}
                latest[k] = v
                cycle = o if event else None
            if out:
                yield pd.DataFrame(out, columns=[*order, name])
        if cycle is not None:
            yield pd.DataFrame([(*cycle, f(latest))], columns=[*order, name])

    kinds = dict(s.df.dtypes)
    sorted_ = both.repartition("__slice").sortWithinPartitions("__slice", "__event", *order)
    made = sorted_.mapInPandas(run, ", ".join(f"{o} {kinds[o]}" for o in order) + f", {name} {kind}")
    return Stream(made, s.order, (), s.slice)


def _ranked(s: Stream, key: str, value: str) -> DataFrame:
    """Rows with the number of their slice: slices are few, so they are numbered in one small window."""
    rows = s.df.withColumn("__cut", s.slice).select(key, *s.order, F.col(value).alias("__v"), "__cut")
    ranks = rows.select("__cut").distinct().withColumn("__slice", F.row_number().over(Window.orderBy("__cut")).cast("bigint"))
    return rows.join(ranks, "__cut").drop("__cut")
