"""Streams: one vocabulary for single streams and for streams per key.

A ``Stream`` is a DataFrame of changes in long form: key columns (none for a single stream), order columns
(time, seq) and value columns. Every verb is written once; keys only partition it. ``Stream.df`` is an
ordinary DataFrame, so everything Spark offers (sort, limit, set operations, cube, SQL, sinks) applies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions.aggs import Agg
from streamloom.order import prefix, quantile_bounds, slice_of

if TYPE_CHECKING:
    from streamloom.operators.buckets import Grouped
    from streamloom.operators.windows import Windowed


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    order: tuple[str, ...] = ("ts", "seq")
    keys: tuple[str, ...] = ()
    #: Function of the order that cuts it into slices, e.g. the hour; None: prefix values take one window.
    slice: Column | None = None

    # --- shape -----------------------------------------------------------------------------------------
    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.order and c not in self.keys]

    def with_df(self, df: DataFrame) -> "Stream":
        return replace(self, df=df)

    def window_spec(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def sliced(self) -> "Stream":
        """A stream without keys and slices gets slices from the quantiles of its time."""
        if self.keys or self.slice is not None:
            return self
        bounds = quantile_bounds(self.df, self.order[0])
        return replace(self, slice=slice_of(self.df, self.order[0], bounds) if bounds else F.lit(0))

    def prefix(self, **wanted: tuple[str, Column, bool]) -> "Stream":
        s = self.sliced()
        return s.with_df(prefix(s.df, s.keys, s.order, wanted, s.slice))

    def checked(self) -> "Stream":
        """Fails where two rows have equal keys and order: joins and buckets would take them for one cycle."""
        w = Window.partitionBy(*self.keys, *self.order)
        alone = F.when(F.count(F.lit(1)).over(w) > 1, F.raise_error(F.lit("two rows of one key and order"))).otherwise(F.lit(True)).cast("boolean")
        return self.with_df(self.df.withColumn("__alone", alone).where("__alone").drop("__alone"))

    # --- projections and filters -----------------------------------------------------------------------
    def map(self, expose_null: bool = True, **columns: Column) -> "Stream":
        """New value columns in place of the old ones. Without ``expose_null`` rows of null are not emitted."""
        df = self.df.select(*self.keys, *self.order, *[c.alias(n) for n, c in columns.items()])
        return self.with_df(df if expose_null else df.dropna(how="all", subset=list(columns)))

    def with_columns(self, **columns: Column) -> "Stream":
        return self.with_df(self.df.withColumns(columns))

    def filter(self, condition: Column) -> "Stream":
        """Rows whose value is accepted. Keys without accepted rows are to be taken from ``key_set``."""
        return self.with_df(self.df.where(condition))

    def filter_type(self, tag: str, kind: str) -> "Stream":
        """Rows whose discriminator column is ``kind``."""
        return self.filter(F.col(tag) == kind)

    def filter_variant(self, column: str, kind: str, name: str = "value") -> "Stream":
        """Rows whose VARIANT value has the type ``kind``, cast to it."""
        typed = F.schema_of_variant(F.col(column)) == kind
        return self.with_df(self.df.where(typed).withColumn(name, F.expr(f"try_variant_get({column}, '$', '{kind}')")))

    def every(self, n: int = 2, offset: int = 0) -> "Stream":
        """Every ``n``-th row: a predicate with a state."""
        counted = self.prefix(__n=("sum", F.lit(1), True))
        return self.with_df(counted.df.where((F.col("__n") - 1) % n == offset).drop("__n"))

    # --- keys ------------------------------------------------------------------------------------------
    def by(self, **keys: Column) -> "Stream":
        """A stream per key, or a new key in place of the old one."""
        return replace(self, df=self.df.withColumns(keys), keys=tuple(keys))

    def nest(self, **keys: Column) -> "Stream":
        """An outer key before the present ones."""
        return replace(self, df=self.df.withColumns(keys), keys=(*keys, *self.keys))

    def to_stream(self) -> "Stream":
        """All keys in one stream; the key stays as a value. Rows of one cycle are ordered by key."""
        return replace(self, keys=(), order=(*self.order, *self.keys))

    def map_keys(self, unique: bool = False, **keys: Column) -> "Stream":
        """Keys replaced, null drops. With ``unique`` two old keys of one new key raise an error."""
        names = list(keys)
        moved = self.df.withColumns({f"__new_{n}": c for n, c in keys.items()}).where(F.col(f"__new_{names[0]}").isNotNull())
        if unique:
            old = F.struct(*self.keys)
            w = Window.partitionBy(*[f"__new_{n}" for n in names])
            moved = moved.withColumn("__clash", F.min(old).over(w) != F.max(old).over(w))
            moved = moved.where(F.when(F.col("__clash"), F.raise_error(F.lit("two keys become one"))).otherwise(F.lit(True)).cast("boolean")).drop("__clash")
        kept = [c for c in self.df.columns if c not in self.keys and c not in names]
        return replace(self, df=moved.select(*[F.col(f"__new_{n}").alias(n) for n in names], *kept), keys=tuple(names))

    def subset(self, condition: Column) -> "Stream":
        """Keys that satisfy a condition."""
        return self.filter(condition)

    def apply(self, *key: object) -> "Stream":
        """The stream of one key; empty if the key never comes."""
        condition = F.lit(True)
        for k, v in zip(self.keys, key):
            condition = condition & (F.col(k) == F.lit(v))
        return replace(self, df=self.df.where(condition).drop(*self.keys), keys=())

    # --- folds -----------------------------------------------------------------------------------------
    def scan(self, *aggs: Agg) -> "Stream":
        """Running aggregates, a row per event. With slices (a stream without keys always has some) they are
        taken inside slices and carried from slice to slice, so no task sees a whole stream or hot key; lists
        and folds, which grow or depend on each other, need one window or pass per key."""
        sliced = [a for a in aggs if a.parts and not a.fold and (self.slice is not None or not self.keys)]
        folded, whole = [a for a in aggs if a.fold], [a for a in aggs if not a.fold and a not in sliced]
        out = self
        if sliced:
            wanted = {f"__{i}_{j}": (kind, c, True) for i, a in enumerate(sliced) for j, (kind, c) in enumerate(a.parts)}
            made = self.prefix(**wanted)
            values = {a.name: a.or_empty(a.whole(*[F.col(f"__{i}_{j}") for j in range(len(a.parts))])) for i, a in enumerate(sliced)}
            out = made.with_df(made.df.withColumns(values).drop(*wanted))
        if whole:
            w = self.window_spec().rowsBetween(Window.unboundedPreceding, 0)
            out = out.with_df(out.df.withColumns({a.name: a.or_empty(a.finish(a.running().over(w))) for a in whole}))
        for a in folded:
            from streamloom.functions.folds import scan_fold

            out = out.with_df(scan_fold(out.df, self.keys, self.order, a.fold, a.name, a.kind))
        return out

    fold_all = scan

    def scan_sum(self, column: Column | str, name: str = "sum") -> "Stream":
        """Running sum, 0.0 before any value; split over slices if the stream has them."""
        c = F.col(column) if isinstance(column, str) else column
        out = self.prefix(**{name: ("sum", c.cast("double"), True)})
        return out.with_columns(**{name: F.coalesce(F.col(name), F.lit(0.0))})

    def reduce(self, *aggs: Agg) -> DataFrame:
        """One row at the end (per key). An empty single stream gives the empty values."""
        out = self.df.groupBy(*self.keys).agg(*[a.grouped(self.order).alias(a.name) for a in aggs])
        return out.withColumns({a.name: a.or_empty(F.col(a.name)) for a in aggs})

    reduce_all = reduce

    # --- buckets, windows, joins: see operators ------------------------------------------------------------
    def group(self, trigger: object, align: str = "after") -> "Grouped":
        from streamloom.operators.buckets import group

        return group(self, trigger, align)

    def window(self, opened: "Stream | Column", key_map: Callable | None = None) -> "Windowed":
        from streamloom.operators.windows import window

        return window(self, opened, key_map)

    def join(self, other: "Stream", key_map: Callable | None = None) -> "Stream":
        from streamloom.operators.joins import join

        return join(self, other, key_map)

    def take(self, other: "Stream", key_map: Callable | None = None) -> "Stream":
        from streamloom.operators.joins import take

        return take(self, other, key_map)

    def sample(self, events: "Stream") -> "Stream":
        from streamloom.operators.joins import sample

        return sample(self, events)


def stream(df: DataFrame, ts: str, seq: str | Sequence[str], *values: str, slice: Column | None = None) -> Stream:  # noqa: A002
    """A single stream of ``values`` (all other columns by default)."""
    order = (ts, *([seq] if isinstance(seq, str) else seq))
    return Stream(df.select(*order, *(values or [c for c in df.columns if c not in order])), order, (), slice)


def keyed(df: DataFrame, keys: Sequence[str], ts: str, seq: str | Sequence[str], *values: str, slice: Column | None = None) -> Stream:  # noqa: A002
    order = (ts, *([seq] if isinstance(seq, str) else seq))
    rest = values or [c for c in df.columns if c not in order and c not in keys]
    return Stream(df.select(*keys, *order, *rest), order, tuple(keys), slice)
