"""Order-dependent folds that have no native aggregate.

A ``Fold`` is a small class with ``add(row)`` and ``value()``. In batch it runs over sorted partitions in
one streaming pass, with the state of one key at a time; in Structured Streaming (``streaming.keyed``) the
same class is kept as state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame


class Fold(Protocol):
    def add(self, row: dict[str, Any]) -> None: ...

    def value(self) -> Any: ...


class EwmaRefFold:
    """Running ``x ** (1 - weight) + s ** weight``."""

    def __init__(self, column: str = "value", weight: float = 0.98):
        self.column, self.weight, self.state = column, weight, 0.0

    def add(self, row: dict[str, Any]) -> None:
        if row[self.column] is not None:
            self.state = row[self.column] ** (1 - self.weight) + self.state**self.weight

    def value(self) -> float:
        return self.state


class EwmaFold:
    """Running ``x * (1 - weight) + s * weight``."""

    def __init__(self, column: str = "value", weight: float = 0.98):
        self.column, self.weight, self.state = column, weight, 0.0

    def add(self, row: dict[str, Any]) -> None:
        if row[self.column] is not None:
            self.state = row[self.column] * (1 - self.weight) + self.state * self.weight

    def value(self) -> float:
        return self.state


class ModeFold:
    """The most frequent value so far, of equally frequent ones the smallest."""

    def __init__(self, column: str = "value"):
        self.column, self.counts, self.best = column, {}, None

    def add(self, row: dict[str, Any]) -> None:
        v = row[self.column]
        if v is not None:
            n = self.counts[v] = self.counts.get(v, 0) + 1
            if self.best is None or (n, -v) > (self.counts[self.best], -self.best):
                self.best = v

    def value(self) -> Any:
        return self.best


class SumFold:
    def __init__(self, column: str = "value"):
        self.column, self.state = column, 0.0

    def add(self, row: dict[str, Any]) -> None:
        self.state += row[self.column] or 0.0

    def value(self) -> float:
        return self.state


class SlicedFold:
    """Starts ``make()`` anew at every ``n``-th event (the slice comes after the event)."""

    def __init__(self, make: Callable[[], Fold], n: int):
        self.make, self.n, self.seen, self.inner = make, n, 0, make()

    def add(self, row: dict[str, Any]) -> None:
        if self.seen and self.seen % self.n == 0:
            self.inner = self.make()
        self.seen += 1
        self.inner.add(row)

    def value(self) -> Any:
        return self.inner.value()


class WindowFold:
    """Folds while ``column`` is true; each opening starts anew; None while closed."""

    def __init__(self, make: Callable[[], Fold], column: str):
        self.make, self.column, self.inner = make, column, None

    def add(self, row: dict[str, Any]) -> None:
        if not row[self.column]:
            self.inner = None
        else:
            self.inner = self.inner or self.make()
            self.inner.add(row)

    def value(self) -> Any:
        return None if self.inner is None else self.inner.value()


class LatestFold:
    """The latest non-null value of ``column``: the as-of side of ``take``."""

    def __init__(self, column: str):
        self.column, self.state = column, None

    def add(self, row: dict[str, Any]) -> None:
        if row[self.column] is not None:
            self.state = row[self.column]

    def value(self) -> Any:
        return self.state


def rows_of(batch, columns: Sequence[str]) -> Iterator[dict[str, Any]]:
    """Rows of an Arrow batch as dicts; null is None and NaN stays NaN."""
    for values in zip(*[batch.column(c).to_pylist() for c in columns]):
        yield dict(zip(columns, values))


def scan_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Fold], name: str, kind: str) -> DataFrame:
    """``df`` with the running value of a fold. Partitions are sorted and streamed; nothing is collected
    per key. Without keys there is one partition: an order-dependent fold can't be split."""
    columns, names = df.columns, list(keys)
    arrow = _arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, fold = object(), None
        for batch in batches:
            out = []
            for row in rows_of(batch, columns):
                key = tuple("nan" if row[k] != row[k] else row[k] for k in names)
                if key != current:
                    current, fold = key, make()
                fold.add(row)
                out.append(fold.value())
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*columns, name])

    return _sorted(df, keys, order).mapInArrow(run, _schema(df, columns, name, kind))


def reduce_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Any], name: str, kind: str, tags: Mapping[str, str] | None = None) -> DataFrame:
    """One value per key of a fold over its rows in order: made at the first row, closed (if it has ``close``)
    after the last. With ``tags`` each input that fired is added by ``add(tag, row)``."""
    columns, names = df.columns, list(keys)
    arrow = _arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        current, fold, first, empty = object(), None, None, None

        def ended():
            getattr(fold, "close", lambda: None)()
            return {**first, name: fold.value()}

        for batch in batches:
            done = []
            for row in rows_of(batch, columns):
                key = tuple("nan" if row[k] != row[k] else row[k] for k in names)
                if key != current:
                    if fold is not None:
                        done.append(ended())
                    current, fold, first = key, make(), {k: row[k] for k in names}
                if tags is None:
                    fold.add(row)
                else:
                    for tag, column in tags.items():
                        if row[column] is not None:
                            fold.add(tag, row)
            empty = batch.schema
            if done:
                yield from _batches(done, empty)
        if fold is not None:
            yield from _batches([ended()], empty)

    def _batches(rows: list[dict], schema):
        import pyarrow as pa

        arrays = [pa.array([r[k] for r in rows], schema.field(k).type) for k in names] + [pa.array([r[name] for r in rows], arrow)]
        yield pa.RecordBatch.from_arrays(arrays, [*names, name])

    return _sorted(df, keys, order).mapInArrow(run, _schema(df, names, name, kind))


def _arrow_type(kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(kind))


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    parted = df.repartition(*keys) if keys else df.coalesce(1)
    return parted.sortWithinPartitions(*keys, *order)


def _schema(df: DataFrame, columns: Sequence[str], name: str, kind: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", {name} {kind}"
