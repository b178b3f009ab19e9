"""Aggregates that work in a bucket (``grouped``) and as running values (``running``).

``grouped`` gets the order columns, because a group has no order of its own; ``running`` is used over an
ordered window. ``empty`` is the value of a bucket without events.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    name: str
    grouped: Callable[[Sequence[str]], Column]
    running: Callable[[], Column]
    empty: Callable[[], Column] | None = None
    finish: Callable[[Column], Column] = lambda c: c  # applied to the running value
    #: Prefix values (kind, column) that make up the running value, and how: what can be taken slice by slice.
    parts: tuple[tuple[str, Column], ...] = ()
    whole: Callable[..., Column] = lambda c: c
    #: A ``Fold`` for running values that no window makes, and the type of its value.
    fold: Callable[[], object] | None = None
    kind: str = "double"

    def alias(self, name: str) -> "Agg":
        return replace(self, name=name)

    def or_empty(self, col: Column) -> Column:
        return col if self.empty is None else F.coalesce(col, self.empty())


def _plain(name: str, make: Callable[[], Column], empty: Callable[[], Column] | None = None, parts: tuple = (), whole: Callable[..., Column] = lambda c: c) -> Agg:
    return Agg(name, lambda order: make(), make, empty, parts=parts, whole=whole)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ordered(c: Column, order: Sequence[str]) -> Column:
    """The values of a group in order, nulls left out."""
    rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], c.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def Sum(c: Column | str, name: str = "sum") -> Agg:
    """Sum as double, 0.0 when empty."""
    return _plain(name, lambda: F.sum(_c(c).cast("double")), lambda: F.lit(0.0), (("sum", _c(c).cast("double")),))


def Avg(c: Column | str, name: str = "avg") -> Agg:
    """Mean, NaN when empty."""
    return _plain(name, lambda: F.avg(_c(c)), lambda: F.lit(float("nan")), (("sum", _c(c).cast("double")), ("sum", F.when(_c(c).isNotNull(), 1))), lambda s, n: s / n)


def Count(name: str = "n") -> Agg:
    return _plain(name, lambda: F.count(F.lit(1)), lambda: F.lit(0).cast("bigint"), (("sum", F.lit(1)),))


def CountIf(c: Column, name: str = "n") -> Agg:
    return _plain(name, lambda: F.count_if(c), lambda: F.lit(0).cast("bigint"), (("sum", F.when(c, 1).otherwise(0)),))


def Min(c: Column | str, name: str = "min") -> Agg:
    return _plain(name, lambda: F.min(_c(c)), parts=(("min", _c(c)),))


def Max(c: Column | str, name: str = "max") -> Agg:
    return _plain(name, lambda: F.max(_c(c)), parts=(("max", _c(c)),))


def AnyTrue(c: Column, name: str = "any") -> Agg:
    return _plain(name, lambda: F.bool_or(c), lambda: F.lit(False), (("max", c.cast("int")),), lambda x: x.cast("boolean"))


def First(c: Column | str, name: str = "first") -> Agg:
    return Agg(name, lambda order: F.min_by(_c(c), F.when(_c(c).isNotNull(), F.struct(*order))), lambda: F.first(_c(c), ignorenulls=True), parts=(("first", _c(c)),))


def Last(c: Column | str, name: str = "last") -> Agg:
    """The latest non-null value."""
    return Agg(name, lambda order: F.max_by(_c(c), F.when(_c(c).isNotNull(), F.struct(*order))), lambda: F.last(_c(c), ignorenulls=True), parts=(("last", _c(c)),))


def Collect(c: Column | str, name: str = "list") -> Agg:
    """Non-null values in order."""
    return Agg(name, lambda order: _ordered(_c(c), order), lambda: F.collect_list(_c(c)), lambda: F.expr("array()"))


def SetOf(c: Column | str, name: str = "set") -> Agg:
    """Distinct non-null values, sorted."""
    return Agg(name, lambda order: F.array_sort(F.collect_set(_c(c))), lambda: F.collect_set(_c(c)), lambda: F.expr("array()"), finish=F.array_sort, parts=(("set", _c(c)),), whole=F.array_sort)


def Vwap(price: Column | str, quantity: Column | str, name: str = "vwap") -> Agg:
    paid, traded = _c(price) * _c(quantity), F.when(_c(price).isNotNull(), _c(quantity))
    return _plain(name, lambda: F.try_divide(F.sum(paid), F.sum(traded)), None, (("sum", paid), ("sum", traded)), F.try_divide)


def Mode(c: Column | str, name: str = "mode", kind: str = "double") -> Agg:
    """The most frequent value, of equally frequent ones the smallest. Running values come from a fold over a
    named column of type ``kind``."""

    def grouped(order: Sequence[str]) -> Column:
        return F.mode(_c(c), deterministic=True)

    def running() -> Column:
        raise ValueError("running modes need a named column")

    from streamloom.functions.folds import ModeFold

    return Agg(name, grouped, running, fold=(lambda: ModeFold(c)) if isinstance(c, str) else None, kind=kind)


def _power_step(weight: float) -> Callable[[Column, Column], Column]:
    return lambda s, x: F.pow(x, F.lit(1 - weight)) + F.pow(s, F.lit(weight))


def _linear_step(weight: float) -> Callable[[Column, Column], Column]:
    return lambda s, x: x * F.lit(1 - weight) + s * F.lit(weight)


def _folded(name: str, c: Column | str, step: Callable[[Column, Column], Column], make: Callable[[], object]) -> Agg:
    fold = lambda values: F.aggregate(values, F.lit(0.0), step)

    def running() -> Column:
        raise ValueError("running averages need a named column")

    return Agg(name, lambda order: fold(_ordered(_c(c).cast("double"), order)), running, lambda: F.lit(0.0), fold=make if isinstance(c, str) else None)


def EwmaRef(c: Column | str, weight: float = 0.98, name: str = "ewma") -> Agg:
    """The moving average in its documented form, with powers: ``x ** (1 - weight) + s ** weight``."""
    from streamloom.functions.folds import EwmaRefFold

    return _folded(name, c, _power_step(weight), lambda: EwmaRefFold(c, weight))


def Ewma(c: Column | str, weight: float = 0.98, name: str = "ewma") -> Agg:
    """The usual moving average, with products."""
    from streamloom.functions.folds import EwmaFold

    return _folded(name, c, _linear_step(weight), lambda: EwmaFold(c, weight))
