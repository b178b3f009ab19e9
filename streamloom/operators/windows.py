"""Folds over Boolean windows.

A window opens and closes on the edges of a Boolean. A value in the cycle of an opening edge is inside,
one in the cycle of a closing edge is not. ``reduce`` emits at closing edges only, empty windows included,
so a window still open at the end emits nothing; ``scan`` emits at every opening edge and at every value
inside.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.functions.aggs import Agg
from streamloom.operators.joins import KeyMap, _fan_out
from streamloom.order import numbers, prefix, spread
from streamloom.session import durable

WINDOW = "window_id"


@dataclass(frozen=True)
class Windowed:
    stream: Stream  # with __open, __edge, __close, window_id and __on (a value came in this cycle)

    def _guarded(self) -> DataFrame:
        """Rows inside windows; value columns are null on edges without a value."""
        return self.stream.df.where(F.col("__open") & (F.col("__on") | F.col("__edge")))

    def reduce(self, *aggs: Agg) -> DataFrame:
        s = self.stream
        by = [*s.keys, WINDOW]
        closed = s.df.where("__close").select(*s.keys, F.col(WINDOW))
        inside = s.df.where(F.col("__open") & F.col("__on")).groupBy(*by).agg(*[a.grouped(s.order).alias(a.name) for a in aggs])
        out = closed.join(inside, by, "left")
        return out.withColumns({a.name: a.or_empty(F.col(a.name)) for a in aggs})

    last = reduce

    def scan(self, *aggs: Agg) -> Stream:
        s = self.stream
        w = Window.partitionBy(*s.keys, WINDOW).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
        inside = self._guarded().withColumns({a.name: a.or_empty(a.finish(a.running().over(w))) for a in aggs})
        return replace(s, df=inside.drop("__open", "__edge", "__close", "__on"))

    all = scan


@dataclass(frozen=True)
class Shared:
    """One window for all keys, or for all keys of a group: its edges are numbered once, rows take the number as a
    latest value, and only what a key must emit without a value (empty windows, opening edges) is made per key
    from its first window on."""

    stream: Stream  # with ``by``, __open, __n (number of the window, over all keys)
    edges: DataFrame  # ``by``, order columns, __n of every opening edge
    closed: DataFrame  # ``by``, __closed, how many windows close; one row without ``by``
    by: tuple[str, ...] = ()  # the group of a key

    def _beside(self, df: DataFrame, one: DataFrame) -> DataFrame:
        """``df`` with what ``one`` has for the group, or for all."""
        return df.join(one, list(self.by), "left") if self.by else df.join(F.broadcast(one))  # one row

    def _first(self) -> DataFrame:
        """Per key the number of its first window, ``__from``, and whether the key was born inside it."""
        s = self.stream
        born = s.df.groupBy(*s.keys, *self.by).agg(F.min_by(F.struct("__n", "__open"), F.struct(*s.order)).alias("__b"))
        return born.select(*s.keys, *self.by, F.col("__b.__open").alias("__inside"), (F.col("__b.__n") + F.when(F.col("__b.__open"), 0).otherwise(1)).alias("__from"))

    def reduce(self, *aggs: Agg) -> DataFrame:
        """Rows of one number are first those inside the window, then those after it. Each of these parts makes the
        empty windows up to the key's next part, so the (keys x windows) rows are only emitted."""
        s = self.stream
        parts = s.df.groupBy(*s.keys, *self.by, "__n", "__open").agg(*[a.grouped(s.order).alias(a.name) for a in aggs])
        parts = spread(self._beside(parts, self.closed), s.keys)
        w = Window.partitionBy(*s.keys).orderBy("__n", F.desc("__open"))
        begins = F.col("__n") + F.when(F.col("__open"), 0).otherwise(1)
        parts = parts.withColumns({"__from": F.first(begins).over(w), "__next": F.lead(F.when(F.col("__open"), F.col("__n") - 1).otherwise(F.col("__n"))).over(w)})
        until = F.least(F.coalesce("__next", "__closed"), "__closed")
        out = numbers(parts.withColumnRenamed("__n", "__at"), F.when(F.col("__open"), F.col("__at")).otherwise(F.col("__at") + 1), until, "__n")
        values = [a.or_empty(F.when(F.col("__open") & (F.col("__n") == F.col("__at")), F.col(a.name))).alias(a.name) for a in aggs]
        return out.select(*s.keys, (F.col("__n") - F.col("__from") + 1).alias(WINDOW), *values)

    last = reduce

    def scan(self, *aggs: Agg) -> Stream:
        s = self.stream
        last = self.edges.groupBy(*self.by).agg(F.max("__n").alias("__last"))
        first = self._first()
        later = self._beside(first, last).withColumn("__a", F.col("__from") + F.col("__inside").cast("int")).where(F.col("__a") <= F.col("__last"))
        marks = numbers(later, F.col("__a"), F.col("__last"), "__n").select(*s.keys, *self.by, "__n").join(self.edges, [*self.by, "__n"]).drop(*self.by)
        rows = s.df.where("__open").select(*s.keys, *s.order, "__n", F.struct(*[c for c in s.values if c not in (*self.by, "__open", "__n")]).alias("__v"))
        both = rows.unionByName(marks, allowMissingColumns=True).groupBy(*s.keys, *s.order, "__n").agg(F.first("__v", ignorenulls=True).alias("__v"))
        w = Window.partitionBy(*s.keys, "__n").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
        values = both.select(*s.keys, *s.order, "__n", "__v.*")
        folded = values.withColumns({a.name: a.or_empty(a.finish(a.running().over(w))) for a in aggs})
        out = folded.join(first, list(s.keys)).withColumn(WINDOW, F.col("__n") - F.col("__from") + 1)
        return replace(s, df=out.drop("__n", "__inside", "__from", *self.by))

    all = scan


def _shared(s: Stream, opened: Stream, key_map: KeyMap = None) -> Shared:
    (flag,) = opened.values
    by = [f"__g{i}" for i in range(len(opened.keys))]
    mapped = key_map(*[F.col(k) for k in s.keys]) if by else []
    mapped = mapped if isinstance(mapped, (list, tuple)) else [mapped]
    given = s.slice if s.slice is not None or opened.order != s.order else opened.slice
    slice_ = given if given is not None else replace(s, keys=()).sliced().slice
    at = [F.col(c).alias(n) for c, n in zip(opened.order, s.order)]
    if by:
        changes = opened.df.select(*[F.col(k).alias(g) for k, g in zip(opened.keys, by)], *at, F.col(flag).alias("__flag"))
        changes = changes.dropna(subset=[*by, "__flag"]).groupBy(*by, *s.order).agg(F.last("__flag").alias("__flag"))
    else:
        changes = opened.df.select(*at, F.coalesce(flag, F.lit(False)).alias("__flag"))
    was = prefix(changes, by, s.order, {"__was": ("last", F.col("__flag"), False)}, slice_)
    before = F.coalesce("__was", F.lit(False))
    marked = was.withColumns({"__edge": (F.col("__flag") & ~before).cast("bigint"), "__close": (~F.col("__flag") & before).cast("bigint")})
    numbered = prefix(marked, by, s.order, {"__n": ("sum", F.col("__edge"), True)}, slice_)
    if by:  # as many as the input may have, and used several times
        numbered = durable(numbered.drop("__was"))
    rows = s.df.select(*[m.alias(g) for m, g in zip(mapped, by)], *s.order, F.struct(*s.keys, *s.values).alias("__row"))
    both = rows.withColumn("__rank", F.lit(1)).unionByName(numbered.select(*by, *s.order, "__flag", F.col("__n").alias("__number"), F.lit(0).alias("__rank")), allowMissingColumns=True)
    latest = {"__open": ("last", F.col("__flag"), True), "__n": ("last", F.col("__number"), True)}
    both = prefix(both, by, (*s.order, "__rank"), latest, slice_).where("__rank = 1")
    out = both.select(*by, *s.order, "__row.*", F.coalesce("__open", F.lit(False)).alias("__open"), F.coalesce("__n", F.lit(0)).cast("bigint").alias("__n"))
    closed = numbered.groupBy(*by).agg(F.coalesce(F.sum("__close"), F.lit(0)).alias("__closed"))
    return Shared(s.with_df(out.select(*s.df.columns, *by, "__open", "__n")), numbered.where("__edge = 1").select(*by, *s.order, "__n"), closed, tuple(by))


def window(s: Stream, opened: Stream | Column, key_map: KeyMap = None) -> Windowed | Shared:
    """``opened`` is a Boolean column of the stream, or a stream whose only value is a Boolean: per key, or
    one for all keys; ``key_map`` tells which key of ``opened`` belongs to each key of ``s``. A key exists from its first value on; windows that closed before are none of its own."""
    if isinstance(opened, Column):
        rows = s.with_columns(__flag=opened, __on=F.lit(True))
    elif s.keys and (not opened.keys or key_map is not None):
        return _shared(s, opened, key_map)
    else:
        (flag,) = opened.values
        marks = _fan_out(s, opened, key_map).withColumnRenamed(flag, "__flag").select(*s.keys, *s.order, "__flag")
        values = s.df.select(*s.keys, *s.order, F.struct(*s.values).alias("__v"))
        both = values.unionByName(marks, allowMissingColumns=True).groupBy(*s.keys, *s.order)
        both = both.agg(F.first("__v", ignorenulls=True).alias("__v"), F.last("__flag", ignorenulls=True).alias("__flag"))
        born = {"__born": ("max", F.col("__v").isNotNull().cast("int"), True)}
        s = s.sliced()
        both = prefix(both, s.keys, s.order, {"__state": ("last", F.col("__flag"), True), **born}, s.slice)
        both = both.where("__born = 1") if s.keys else both
        rows = s.with_df(both.select(*s.keys, *s.order, "__v.*", F.col("__state").alias("__flag"), F.col("__v").isNotNull().alias("__on")))
    state = F.coalesce("__flag", F.lit(False))
    rows = rows.with_columns(__open=state).prefix(__was=("last", F.col("__open"), False))
    was = F.coalesce("__was", F.lit(False))
    rows = rows.with_columns(__edge=F.col("__open") & ~was, __close=~F.col("__open") & was).prefix(**{WINDOW: ("sum", F.col("__edge").cast("bigint"), True)})
    return Windowed(rows.with_df(rows.df.drop("__flag", "__was")))


def toggled(trigger: Stream, name: str = "open") -> Stream:
    """A Boolean stream that flips at every event."""
    counted = trigger.prefix(__n=("sum", F.lit(1), True))
    return counted.map(**{name: F.col("__n") % 2 == 1})
