"""Structured Streaming twins of the ordered operators.

Row-ordered windows don't exist on streaming DataFrames, so an ordered operator is a processor with state per
key. One processor serves all (``process``): the state is a small node, kept pickled between micro-batches, that
gets the rows of each cycle together. Folds (see ``functions.folds``), joins, several inputs in one bucket and
slices that another stream ends are such nodes. An unbounded stream has no end by itself: where one is known, an
end marker among the rows flushes what is open.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.folds import Fold, LatestFold, SlicedFold, SumFold, WindowFold


_WHOLE = ("tinyint", "smallint", "int", "bigint")


class Node(Protocol):
    """What is kept per key: it gets all rows of a cycle at once and returns rows to emit."""

    def cycle(self, rows: list[dict[str, Any]]) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def process(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Node], schema: str, end: Column | None = None) -> DataFrame:
    """The keys and columns of ``schema`` that a node per key emits. The rows of a batch are sorted per key, and
    those of equal ``order`` reach the node together. A row for which ``end`` is true is an end marker: it tells
    the node that nothing more comes. Nulls reach the node as None and NaN as NaN."""
    from pyspark import cloudpickle

    columns, kinds = df.columns, dict(df.dtypes)
    whole = [kinds[c] in _WHOLE for c in columns]
    given = df.withColumns({"__nulls": F.array(*[F.col(c).isNull() for c in columns]), "__end": F.lit(False) if end is None else F.coalesce(end, F.lit(False))})
    names = [*keys, *[c.split()[0].strip("`") for c in _split(schema)]]

    def run(key: tuple, frames: Iterator, state) -> Iterator:
        import itertools

        import pandas as pd

        node = pickle.loads(state.get[0]) if state.exists else make()
        pdf = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        rows = []
        for values, nulls, last in zip(zip(*[pdf[c] for c in columns]), pdf["__nulls"], pdf["__end"]):
            rows.append((last, {c: None if n else int(v) if w else v for c, v, n, w in zip(columns, values, nulls, whole)}))
        out = []
        for _, part in itertools.groupby(rows, key=lambda r: [r[1][c] for c in order]):
            part = list(part)
            if cycle := [r for last, r in part if not last]:
                out += node.cycle(cycle)
            if any(last for last, _ in part):
                out += node.end()
        state.update((cloudpickle.dumps(node),))
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=names, dtype=object)

    made = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema
    return given.groupBy(*keys).applyInPandasWithState(run, made, "node binary", "append", "NoTimeout")


def _split(schema: str) -> list[str]:
    """The columns of a schema, whose types may have commas of their own."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


class Running:
    """Every row with the value of a fold."""

    def __init__(self, fold: Fold, columns: Sequence[str]):
        self.fold, self.columns = fold, columns

    def cycle(self, rows):
        out = []
        for row in rows:
            self.fold.add(row)
            out.append((*[row[c] for c in self.columns], self.fold.value()))
        return out

    def end(self):
        return ()


class Latest:
    """Latest values of both sides whenever one fires, once per cycle, from the first left row on."""

    def __init__(self, order: Sequence[str], left: Sequence[str], right: Sequence[str]):
        self.order, self.sides, self.now = order, (left, right), [None, None]

    def cycle(self, rows):
        for row in rows:
            self.now[row["side"]] = [row[c] for c in self.sides[row["side"]]]
        if self.now[0] is None:
            return ()
        return [(*[rows[0][c] for c in self.order], *self.now[0], *(self.now[1] or [None] * len(self.sides[1])))]

    def end(self):
        return ()


class Together:
    """All that several inputs bring in one cycle as one row."""

    def __init__(self, order: Sequence[str], values: Sequence[str]):
        self.order, self.values = order, values

    def cycle(self, rows):
        latest = lambda c: next((r[c] for r in reversed(rows) if r[c] is not None), None)
        return [(*[rows[0][c] for c in self.order], *map(latest, self.values))]

    def end(self):
        return ()


class Sliced:
    """A value per slice; slices end at trigger rows and at the end marker."""

    def __init__(self, make: Callable[[], Fold], align: str):
        self.make, self.align, self.bucket, self.fold = make, align, 0, make()

    def _emit(self):
        getattr(self.fold, "close", lambda: None)()
        out = (self.bucket, self.fold.value())
        self.bucket, self.fold = self.bucket + 1, self.make()
        return out

    def cycle(self, rows):
        fired = any(r["trigger"] for r in rows)
        out = [self._emit()] if fired and self.align == "before" else []
        for r in rows:
            if r["on"]:
                self.fold.add(r)
        return [*out, self._emit()] if fired and self.align == "after" else out

    def end(self):
        return [self._emit()]


def scan_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Fold], name: str, kind: str) -> DataFrame:
    """Every row with the running value of the fold of its key."""
    rest = [c for c in df.columns if c not in keys]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in rest) + f", {name} {kind}"
    return process(df, keys, order, lambda: Running(make(), rest), schema).select(*df.columns, name)


def _tagged(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    union = None
    for i, p in enumerate(parts):
        one = p.withColumn("side", F.lit(i))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    return union


def _fields(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest left and right values whenever either side of a key fires, as far as both have arrived."""
    x, y = ([c for c in df.columns if c not in (*keys, *order)] for df in (left, right))
    both = _tagged([left, right], keys, order)
    return process(both, keys, order, lambda: Latest(list(order), x, y), _fields(both, [*order, *x, *y]))


def bind(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key and cycle with the values of every input, for what arrives in one batch."""
    values = [c for p in parts for c in p.columns if c not in (*keys, *order)]
    both = _tagged(parts, keys, order)
    return process(both, keys, order, lambda: Together(list(order), values), _fields(both, [*order, *values]))


def reduce_slices(
    df: DataFrame, triggers: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Fold], name: str, kind: str, align: str = "after", end: Column | None = None,
) -> DataFrame:
    """One row per slice of a key when the slice ends: at the rows of ``triggers``, another stream of the same
    keys, and at rows of ``df`` for which ``end`` is true, which flush what is open. A trigger of all keys is to
    be sent to each of them."""
    x = df.withColumns({"trigger": F.lit(False), "on": F.lit(True), "__last": F.lit(False) if end is None else end})
    y = triggers.select(*keys, *order).withColumns({"trigger": F.lit(True), "on": F.lit(False), "__last": F.lit(False)})
    both = x.unionByName(y, allowMissingColumns=True)
    return process(both, keys, order, lambda: Sliced(make, align), f"bucket bigint, {name} {kind}", F.col("__last"))


def scan_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str = "sum") -> DataFrame:
    return scan_fold(df, keys, order, lambda: SumFold(column), name, "double")


def slice_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, n: int, name: str = "sum") -> DataFrame:
    """Running sum within every ``n`` events."""
    return scan_fold(df, keys, order, lambda: SlicedFold(lambda: SumFold(column), n), name, "double")


def window_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, opened: str, name: str = "sum") -> DataFrame:
    """Running sum while ``opened`` is true, null while not."""
    return scan_fold(df, keys, order, lambda: WindowFold(lambda: SumFold(column), opened), name, "double")


def take(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, kind: str) -> DataFrame:
    """Left rows with the latest right ``value`` of their key, as far as both have arrived; in one cycle the
    right side comes first."""
    names = [c for c in left.columns if c not in (*keys, *order)]
    x = left.select(*keys, *order, *names, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("latest_in"))
    y = right.select(*keys, *order, *[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in names], F.lit(0).alias("side"), F.col(value).alias("latest_in"))
    both = scan_fold(x.unionByName(y), keys, [*order, "side"], lambda: LatestFold("latest_in"), value, kind)
    return both.where("side = 1").drop("side", "latest_in")


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: Sequence[str], *aggs) -> DataFrame:
    """Aggregates per key and time window, with a watermark of ``late``. A ``timestamp_ntz`` column is cast,
    since a watermark needs a timestamp."""
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(*aggs)


def first_seen(df: DataFrame, time: str, late: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values as they first appear: the streaming value set."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(columns))
