"""Total order, cycles and prefix values.

A stream's rows carry a time and a ``seq``; equal ``seq`` means the same cycle. Derived streams keep the
``seq`` of their parent. Prefix values (running sums, latest values) are taken in two levels wherever a
slice of the order is given: inside each slice by a window, and across slices from the table of slices. So
a stream without a key, or a hot key, doesn't end in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WINDOW = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True), "set": F.collect_set}
#: Slices that an order is cut into where none are given, and elements of one array where numbers are made.
SLICES, BLOCK = 32, 4096


def _number(df: DataFrame, column: str) -> Column | None:
    """An order column as a number that grows with it."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column)
    return F.col(column) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None


def quantile_bounds(df: DataFrame, column: str, slices: int = SLICES) -> list[float]:
    """Numbers that cut an order column into slices of about as many rows; found by one aggregate."""
    at = _number(df, column)
    if at is None:
        return []
    found = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).first()[0]
    return sorted(set(found or []))


def slice_of(df: DataFrame, column: str, bounds: Sequence[float]) -> Column:
    """The slice of a value: how many bounds it has reached."""
    at, out = _number(df, column), F.lit(0)
    for b in bounds:
        out = out + F.when(at >= F.lit(b), 1).otherwise(0)
    return out


def numbers(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """``df`` with a row per whole number from ``first`` to ``last``, made in two steps, so that no array is
    longer than ``BLOCK`` or the number of blocks."""
    a, b = first.cast("bigint"), last.cast("bigint")
    blocks = df.where(a <= b).withColumns({"__a": a, "__b": b}).withColumn("__block", F.explode(F.sequence(F.floor(F.col("__a") / BLOCK), F.floor(F.col("__b") / BLOCK))))
    low, high = F.greatest("__a", F.col("__block") * BLOCK), F.least("__b", F.col("__block") * BLOCK + BLOCK - 1)
    return blocks.withColumn(name, F.explode(F.sequence(low, high))).drop("__a", "__b", "__block")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` by its keys, in as many partitions as the session has for shuffles. For rows out of which far more
    are made in the same task: their own size doesn't tell how many partitions those need."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Mapping[str, tuple[str, Column, bool]], slice_: Column | None = None) -> DataFrame:
    """``df`` with a column per entry of ``wanted``: ``(kind, expression, inclusive)`` over all rows up to
    the current one (without it, if not inclusive) of the same keys. ``last`` skips nulls. ``slice_`` must
    not decrease along ``order``."""
    if slice_ is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: _WINDOW[k](e).over(w.rowsBetween(Window.unboundedPreceding, 0 if incl else -1)) for n, (k, e, incl) in wanted.items()})
    inputs = {f"__in_{n}": e for n, (_, e, _) in wanted.items()}
    rows = df.withColumns({"__slice": slice_, **inputs})
    by = [*keys, "__slice"]
    w = Window.partitionBy(*by).orderBy(*order)
    at = F.struct(*order)
    totals, carried, combined = [], {}, {}
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    for n, (kind, _, incl) in wanted.items():
        x = F.col(f"__in_{n}")
        local[f"__at_{n}"] = _WINDOW[kind](x).over(w.rowsBetween(Window.unboundedPreceding, 0 if incl else -1))
        at_end = {"last": F.max_by, "first": F.min_by}.get(kind)
        totals.append((at_end(x, F.when(x.isNotNull(), at)) if at_end else _WINDOW[kind](x)).alias(f"__all_{n}"))
        whole = F.col(f"__all_{n}")
        carried[f"__before_{n}"] = F.array_distinct(F.flatten(F.collect_list(whole).over(before))) if kind == "set" else _WINDOW[kind](whole).over(before)
        a, b = F.col(f"__before_{n}"), F.col(f"__at_{n}")
        combine = {"sum": lambda: F.coalesce(a + b, a, b), "max": lambda: F.greatest(a, b), "min": lambda: F.least(a, b), "last": lambda: F.coalesce(b, a), "first": lambda: F.coalesce(a, b)}
        combined[n] = combine.get(kind, lambda: F.coalesce(F.array_union(a, b), a, b))()
    slices = rows.groupBy(*by).agg(*totals).withColumns(carried)
    slices = slices.select(*[F.col(c).alias(f"__s_{i}") for i, c in enumerate(by)], *carried)
    same = None
    for i, c in enumerate(by):
        one = F.col(c).eqNullSafe(F.col(f"__s_{i}"))
        same = one if same is None else same & one
    out = rows.withColumns(local).join(slices, same, "left").withColumns(combined)
    return out.select(*df.columns, *wanted)


def merge_sources(*sources: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Independent sources as one: the order of equal times is the order of the sources, then their own.
    ``seq`` becomes a struct ``(source, seq)``, comparable and unique, without any global numbering."""
    parts = [s.withColumn(seq, F.struct(F.lit(i).alias("source"), F.col(seq).cast("bigint").alias("seq"))) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
