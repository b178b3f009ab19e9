"""Slices: which events belong together, and what is emitted.

Triggers: ``events(n)``, ``Every(seconds)``, a condition on the stream's own rows, another stream (global
or per key), or none (one bucket until the end). Alignment ``after``: an event in the trigger's own cycle
still belongs to the old bucket; ``before``: it opens the new one. ``reduce`` emits every bucket at its end
and the last one at termination, empty ones included (``emit_empty``); ``scan`` emits running values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.functions.aggs import Agg
from streamloom.operators.joins import _fan_out
from streamloom.order import numbers, prefix, spread

BUCKET = "bucket"


@dataclass(frozen=True)
class Events:
    """A slice at every ``n``-th event."""

    n: int


@dataclass(frozen=True)
class Every:
    """A slice every so many seconds from the first event of the whole stream on, empty ones included.
    Needs a timestamp or an epoch in ``units`` per second as time."""

    seconds: float
    units: int = 1000


def events(n: int) -> Events:
    return Events(n)


@dataclass(frozen=True)
class Grouped:
    stream: Stream  # with the column ``bucket``
    #: Slices per key (keys, ``slices``), or of all (``slices``): the last bucket is number ``slices``.
    spine: DataFrame | None

    #: The cycles that end slices (keys if there are some per key, order columns, ``bucket`` that ends), where
    #: slices can be empty.
    marks: DataFrame | None = None

    def scan(self, *aggs: Agg, emit_empty: bool = True) -> Stream:
        """Running values of each bucket, at every event. An empty slice emits its empty values when it ends;
        for one trigger of all keys that makes (keys x empty slices) rows."""
        s = self.stream
        whole = [a for a in aggs if not a.fold]
        w = Window.partitionBy(*s.keys, BUCKET).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
        out = s.with_columns(**{a.name: a.or_empty(a.finish(a.running().over(w))) for a in whole})
        for a in aggs:
            if a.fold:
                from streamloom.functions.folds import scan_fold

                out = out.with_df(scan_fold(out.df, [*s.keys, BUCKET], s.order, a.fold, a.name, a.kind))
        if emit_empty and self.marks is not None:
            empty = {a.name: a.empty() if a.empty is not None else F.lit(None) for a in aggs}
            out = out.with_df(out.df.unionByName(self.empty_slices().withColumns(empty), allowMissingColumns=True).select(*out.df.columns))
        return out

    def empty_slices(self) -> DataFrame:
        """Keys, order columns and bucket of every slice that ends without an event, from a key's first on."""
        s = self.stream
        filled = s.df.select(*s.keys, BUCKET).distinct()
        if not s.keys or set(s.keys) <= set(self.marks.columns):
            return self.marks.join(filled, [*s.keys, BUCKET], "left_anti")
        ends = self.marks.agg(F.max(BUCKET).alias("__last"))  # one row
        born = s.df.groupBy(*s.keys).agg(F.min(BUCKET).alias("__first")).join(F.broadcast(ends))
        missing = numbers(born, F.col("__first"), F.col("__last"), BUCKET).select(*s.keys, BUCKET).join(filled, [*s.keys, BUCKET], "left_anti")
        return missing.join(self.marks, BUCKET)

    def all(self, *aggs: Agg, emit_empty: bool = True) -> Stream:
        """``scan``; without aggregates the latest values, which an empty slice emits again."""
        if aggs:
            return self.scan(*aggs, emit_empty=emit_empty)
        s = self.stream
        if not emit_empty or self.marks is None:
            return s
        rows = s.df.withColumn("__event", F.lit(True)).unionByName(self.empty_slices(), allowMissingColumns=True)
        carried = Stream(rows, s.order, s.keys, s.slice).prefix(**{f"__l_{c}": ("last", F.col(c), True) for c in s.values if c != BUCKET})
        values = {c: F.when(F.col("__event"), F.col(c)).otherwise(F.col(f"__l_{c}")) for c in s.values if c != BUCKET}
        return s.with_df(carried.df.withColumns(values).select(*s.df.columns))

    def reduce(self, *aggs: Agg, emit_empty: bool = True) -> DataFrame:
        s = self.stream
        out = s.df.groupBy(*s.keys, BUCKET).agg(*[a.grouped(s.order).alias(a.name) for a in aggs])
        if emit_empty and s.keys:
            return self._with_empty(out, aggs)
        if emit_empty:
            out = self.buckets().join(out, [BUCKET], "left")
        return out.withColumns({a.name: a.or_empty(F.col(a.name)) for a in aggs})

    def _with_empty(self, filled: DataFrame, aggs: Sequence[Agg]) -> DataFrame:
        """The filled buckets of each key and the empty ones. Every filled bucket makes the empty ones up to the
        key's next, so the (keys x slices) rows are neither shuffled nor sorted, only emitted."""
        keys = self.stream.keys
        filled = filled.withColumnRenamed(BUCKET, "__at")
        own = set(keys) <= set(self.spine.columns)
        filled = filled.join(self.spine, list(keys), "left") if own else spread(filled.join(F.broadcast(self.spine)), keys)  # one row
        after = F.lead("__at").over(Window.partitionBy(*keys).orderBy("__at")) - 1
        until = F.coalesce(after, F.greatest(F.coalesce("slices", F.lit(0)).cast("bigint"), "__at"))
        out = numbers(filled.withColumn("__until", until), F.col("__at"), F.col("__until"), BUCKET)
        values = [a.or_empty(F.when(F.col(BUCKET) == F.col("__at"), F.col(a.name))).alias(a.name) for a in aggs]
        return out.select(*keys, BUCKET, *values)

    last_of = reduce

    def reduce_k(self, make: Callable[..., Sequence[Agg]], emit_empty: bool = True) -> DataFrame:
        """Aggregates that depend on the key: ``make`` gets the key columns."""
        return self.reduce(*make(*map(F.col, self.stream.keys)), emit_empty=emit_empty)

    def scan_k(self, make: Callable[..., Sequence[Agg]], emit_empty: bool = True) -> Stream:
        return self.scan(*make(*map(F.col, self.stream.keys)), emit_empty=emit_empty)

    def collapse(self, make: Callable[[], object], name: str, kind: str, tags: Mapping[str, str] | None = None, emit_empty: bool = True) -> DataFrame:
        """One value of a ``Fold`` per bucket, made anew for each and closed at its end. With ``tags`` (a tag to
        a column that is null where that input didn't fire) several inputs bound together are added by
        ``add(tag, row)``, all of a cycle before any value is taken."""
        from streamloom.functions.folds import reduce_fold

        s = self.stream
        out = reduce_fold(s.df, [*s.keys, BUCKET], s.order, make, name, kind, tags)
        if emit_empty:
            empty = make()
            getattr(empty, "close", lambda: None)()
            at = self.buckets().join(out.withColumn("__there", F.lit(True)), [*s.keys, BUCKET], "left")
            out = at.withColumn(name, F.when(F.col("__there"), F.col(name)).otherwise(F.lit(empty.value()).cast(kind))).drop("__there")
        return out

    def last(self, column: str) -> DataFrame:
        """The latest value at every slice, carried on over empty ones."""
        from streamloom.functions.aggs import Last

        out = self.reduce(Last(column, column))
        w = Window.partitionBy(*self.stream.keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
        return out.withColumn(column, F.last(column, ignorenulls=True).over(w))

    def buckets(self) -> DataFrame:
        """Every bucket of every key from its first event on; of a single stream from the start."""
        s = self.stream
        if not s.keys:
            total = self.spine.select(F.coalesce("slices", F.lit(0)).cast("bigint").alias("slices"))
            return numbers(total, F.lit(0), F.col("slices"), BUCKET).select(BUCKET)
        born = s.df.groupBy(*s.keys).agg(F.min(BUCKET).alias("__first"), F.max(BUCKET).alias("__latest"))
        if set(s.keys) <= set(self.spine.columns):
            born = born.join(self.spine, list(s.keys), "left")
        else:
            born = born.join(F.broadcast(self.spine))  # one row
        until = F.greatest(F.coalesce("slices", F.lit(0)).cast("bigint"), "__latest")
        return numbers(born, F.col("__first"), until, BUCKET).select(*s.keys, BUCKET)


def _micros(ts: Column, kind: str, units: int) -> Column:
    if kind.startswith("timestamp"):
        return F.unix_micros(ts.cast("timestamp"))
    return (ts * F.lit(1_000_000 / units)).cast("bigint")


def group(s: Stream, trigger: object, align: str = "after") -> Grouped:
    if align not in ("before", "after"):
        raise ValueError("align is 'before' or 'after'")
    inclusive = align == "before"
    totals = lambda df, c: df.groupBy(*s.keys).agg(c.cast("bigint").alias("slices"))
    if trigger is None:
        spine = s.df.groupBy(*s.keys).agg(F.lit(0).cast("bigint").alias("slices"))
        return Grouped(s.with_columns(**{BUCKET: F.lit(0).cast("bigint")}), spine)
    if isinstance(trigger, Events):
        rows = s.prefix(__rn=("sum", F.lit(1), True)).df
        number = F.col("__rn") if inclusive else F.col("__rn") - 1
        df = rows.withColumn(BUCKET, F.floor(number / trigger.n).cast("bigint")).drop("__rn")
        return Grouped(s.with_df(df), totals(s.df, F.floor(F.count(F.lit(1)) / trigger.n)))
    if isinstance(trigger, Every):
        kind = dict(s.df.dtypes)[s.order[0]]
        at = _micros(F.col(s.order[0]), kind, trigger.units)
        span = s.df.agg(F.min(at).alias("__t0"), F.max(at).alias("__t1"))  # one row
        step = int(trigger.seconds * 1_000_000)
        df = s.df.join(F.broadcast(span)).withColumn(BUCKET, F.floor((at - F.col("__t0")) / step).cast("bigint")).drop("__t0", "__t1")
        total = F.floor((F.col("__t1") - F.col("__t0")) / step).cast("bigint")
        ends = numbers(span.withColumn("__n", total), F.lit(0), F.col("__n") - 1, BUCKET).withColumn("__at", F.col("__t0") + (F.col(BUCKET) + 1) * step)
        when = F.timestamp_micros("__at").cast(kind) if kind.startswith("timestamp") else (F.col("__at") * F.lit(trigger.units / 1_000_000)).cast(kind)
        rest = {c: F.lit(None).cast(dict(s.df.dtypes)[c]) for c in s.order[1:]}
        marks = ends.withColumn(s.order[0], when).withColumns(rest).select(*s.order, BUCKET)
        return Grouped(s.with_df(df), span.select(total.alias("slices")), marks)
    if isinstance(trigger, Column):
        fired = F.when(trigger, 1).otherwise(0)
        df = s.prefix(**{BUCKET: ("sum", fired, inclusive)}).df.withColumn(BUCKET, F.coalesce(BUCKET, F.lit(0)).cast("bigint"))
        return Grouped(s.with_df(df), totals(s.df, F.sum(fired)))
    if isinstance(trigger, Stream):
        return _by_stream(s, trigger, inclusive)
    raise TypeError(f"not a trigger: {trigger!r}")


def _by_stream(s: Stream, trigger: Stream, inclusive: bool) -> Grouped:
    """Buckets cut by another stream. A single trigger cuts all keys: its cycles are numbered once, and the
    number, a latest value, is taken by every row in one pass over the order (split over slices if there
    are any), not by a copy of the trigger per key."""
    # a merged stream has further order columns inside a cycle; a trigger's cycle is told by the common ones
    common, inner = s.order[: len(trigger.order)], s.order[len(trigger.order) :]
    marks = trigger.df.select(*trigger.keys, *trigger.order[: len(common)]).withColumnsRenamed(dict(zip(trigger.order, common))).distinct()
    keyed = bool(trigger.keys)
    keys = s.keys if keyed else ()
    if keyed:
        marks = _fan_out(s, Stream(marks.withColumn("__m", F.lit(1)), common, trigger.keys), None).drop("__m")
    marks = marks.withColumns({c: F.lit(None).cast(dict(s.df.dtypes)[c]) for c in inner})
    marks = marks.withColumns({"__fired": F.lit(1), "__row": F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in s.df.dtypes if c not in (*keys, *s.order)) + ">")})
    rest = [c for c in s.df.columns if c not in (*keys, *s.order)]
    rows = s.df.select(*keys, *s.order, F.lit(0).alias("__fired"), F.struct(*rest).alias("__row"))
    both = marks.select(*keys, *s.order, "__fired", "__row").unionByName(rows)
    # in one cycle: 'before' counts the trigger first, 'after' counts it after the value
    rank = F.when(F.col("__fired") == 1, 0 if inclusive else 1).otherwise(1 if inclusive else 0)
    slice_ = s.slice if keys or s.slice is not None else replace(s, keys=()).sliced().slice
    both = prefix(both.withColumn("__rank", rank), keys, [*common, "__rank", *inner], {BUCKET: ("sum", F.col("__fired"), True)}, slice_)
    out = both.where("__fired = 0").select(*keys, *s.order, "__row.*", F.col(BUCKET).cast("bigint").alias(BUCKET))
    fired = marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("slices"))
    ends = both.where("__fired = 1").select(*keys, *s.order, (F.col(BUCKET) - 1).cast("bigint").alias(BUCKET))
    if keyed:  # from a key's first event on
        ends = ends.join(out.groupBy(*keys).agg(F.min(BUCKET).alias("__first")), list(keys)).where(F.col(BUCKET) >= F.col("__first")).drop("__first")
    return Grouped(s.with_df(out.select(*s.df.columns, BUCKET)), fired, ends)
