"""Latest-value and as-of joins of streams, all by one tagged union and one ordered pass per key.

``join`` emits when either side fires, once per cycle; ``take`` when the left side fires; ``sample`` gives
the latest value at every event of another stream. A side that has not fired yet is null. Value columns of
both sides are kept, so their names must differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.order import BLOCK, prefix, spread

KeyMap = Callable[..., Column] | None
#: Blocks of ``BLOCK`` events that are broadcast, some MB.
BLOCKS = 256


def _fan_out(left: Stream, right: Stream, key_map: KeyMap) -> DataFrame:
    """Rows of ``right`` under the keys of ``left``, order columns under the names of ``left``."""
    renamed = right.df
    for a, b in zip(left.order, right.order):
        renamed = renamed.withColumnRenamed(b, a) if a != b else renamed
    if not left.keys:
        return renamed
    if key_map is None:
        for a, b in zip(left.keys, right.keys):
            renamed = renamed.withColumnRenamed(b, a) if a != b else renamed
        # rows of keys that the left side never has would only be carried along
        return renamed
    renamed = renamed.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(right.keys)})
    mapped = key_map(*[F.col(k) for k in left.keys])
    mapped = mapped if isinstance(mapped, (list, tuple)) else [mapped]
    keys = left.df.select(*left.keys).distinct().select(*left.keys, *[m.alias(f"__l{i}") for i, m in enumerate(mapped)])
    same = None
    for i in range(len(mapped)):
        one = F.col(f"__l{i}") == F.col(f"__r{i}")
        same = one if same is None else same & one
    return keys.join(renamed, same).select(*left.keys, *left.order, *right.values)


def _merged(left: Stream, right: Stream, key_map: KeyMap) -> DataFrame:
    """One row per key and cycle with both sides packed, null where a side didn't fire."""
    if clash := set(left.values) & set(right.values):
        raise ValueError(f"both sides have {sorted(clash)}; rename one")
    x = left.df.select(*left.keys, *left.order, F.struct(*left.values, F.lit(True).alias("__on")).alias("__x"))
    y = _fan_out(left, right, key_map).select(*left.keys, *left.order, F.struct(*right.values, F.lit(True).alias("__on")).alias("__y"))
    both = x.unionByName(y, allowMissingColumns=True)
    return both.groupBy(*left.keys, *left.order).agg(F.first("__x", ignorenulls=True).alias("__x"), F.first("__y", ignorenulls=True).alias("__y"))


def _unpacked(left: Stream, right: Stream, df: DataFrame, condition: Column) -> Stream:
    values = [*[F.col(f"__lx.{c}").alias(c) for c in left.values], *[F.col(f"__ly.{c}").alias(c) for c in right.values]]
    return replace(left, df=df.where(condition).select(*left.keys, *left.order, *values))


def _latest(left: Stream, df: DataFrame) -> DataFrame:
    left = left.sliced()
    return prefix(df, left.keys, left.order, {"__lx": ("last", F.col("__x"), True), "__ly": ("last", F.col("__y"), True)}, left.slice)


def join(left: Stream, right: Stream, key_map: KeyMap = None) -> Stream:
    """Latest left and right values whenever either fires. A keyed row exists for the keys of the left side
    only, from their first left event on; earlier right events still count as the latest."""
    latest = _latest(left, _merged(left, right, key_map))
    return _unpacked(left, right, latest, F.col("__lx").isNotNull() if left.keys else F.lit(True))


def take(left: Stream, right: Stream, key_map: KeyMap = None) -> Stream:
    """Left values with the latest right values, whenever the left side fires."""
    return _unpacked(left, right, _latest(left, _merged(left, right, key_map)), F.col("__x").isNotNull())


def sample(stream: Stream, events: Stream) -> Stream:
    """The stream's latest value at every event; for a keyed stream every key's, from its first value on.

    The result has (keys x later events) rows by definition."""
    if not stream.keys:
        marks = Stream(events.df.select(*events.order, F.lit(1).alias("__mark")), events.order, (), events.slice if stream.slice is None else stream.slice)
        out = take(marks, stream)
        return out.with_df(out.df.drop("__mark"))
    # events are numbered, and every value holds for the numbers up to the key's next value; these are cut into
    # blocks, and a block brings the order columns of its events as arrays. So the result is neither shuffled nor
    # sorted, only emitted.
    from streamloom.operators.buckets import BUCKET, group

    names = {c: f"__v{i}" for i, c in enumerate(stream.values)}
    counted = group(stream.with_df(stream.df.withColumnsRenamed(names)), events, "after")  # the bucket: earlier events
    order = events.df.select(*[F.col(c).alias(n) for c, n in zip(events.order, stream.order)]).distinct()
    total = order.count()
    numbered = Stream(order, stream.order, (), stream.slice).prefix(__k=("sum", F.lit(1), True)).df.withColumn("__k", F.col("__k") - 1)
    columns = [F.col(c).alias(f"__o{i}") for i, c in enumerate(stream.order)]
    blocks = numbered.groupBy(F.floor(F.col("__k") / BLOCK).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("__k", *columns))).alias("__m"))
    blocks = blocks.select("__block", *[F.col(f"__m.__o{i}").alias(f"__o{i}") for i in range(len(columns))])

    rows = spread(counted.stream.df, stream.keys)
    until = F.coalesce(F.lead(BUCKET).over(Window.partitionBy(*stream.keys).orderBy(*stream.order)), F.lit(total)) - 1
    rows = rows.select(*stream.keys, *names.values(), BUCKET, until.alias("__until")).where(F.col(BUCKET) <= F.col("__until"))
    pieces = rows.withColumn("__block", F.explode(F.sequence(F.floor(F.col(BUCKET) / BLOCK), F.floor(F.col("__until") / BLOCK))))
    pieces = pieces.join(F.broadcast(blocks) if total <= BLOCKS * BLOCK else blocks, "__block")
    start = F.col("__block") * BLOCK
    out = pieces.withColumn("__at", F.explode(F.sequence(F.greatest(BUCKET, start) - start, F.least(F.col("__until") - start, F.lit(BLOCK - 1)))))
    out = out.select(*stream.keys, *[F.get(f"__o{i}", F.col("__at")).alias(c) for i, c in enumerate(stream.order)], *[F.col(n).alias(c) for c, n in names.items()])
    return stream.with_df(out)
