"""Sources of streams: tables, Python values, timer grids, delimited files, random walks, key tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.session import durable


def from_values(spark: SparkSession, values: Iterable[Any], kind: str, time_of: Callable[[Any, int], int] = lambda v, i: i, name: str = "value") -> Stream:
    """Python values as a stream; ``time_of`` gets the value and its place."""
    rows = [(int(time_of(v, i)), i, v) for i, v in enumerate(values)]
    return Stream(spark.createDataFrame(rows, f"ts bigint, seq bigint, {name} {kind}"))


def as_vector(spark: SparkSession, keys: Iterable[Any], kind: str = "string", name: str = "key") -> Stream:
    """A fixed set of keys, each its own value, all there from the start."""
    rows = [(k, 0, i, k) for i, k in enumerate(dict.fromkeys(keys))]
    return Stream(spark.createDataFrame(rows, f"{name} {kind}, ts bigint, seq bigint, value {kind}"), keys=(name,))


def lazy_vector(keys: Stream, source: Stream | Callable[..., Iterable[tuple]], schema: str = "ts bigint, seq bigint, value double") -> Stream:
    """Streams that come into being for the keys that are asked for: ``source`` kept to them, or made for each
    key by a function that gets the key and returns rows of ``schema``, whose first two columns are the order."""
    from streamloom.operators.vector import key_to_stream

    if isinstance(source, Stream):
        return key_to_stream(keys, source)
    names = list(keys.keys)
    kinds = dict(keys.df.dtypes)
    columns = [c.split()[0] for c in schema.split(",")]

    def run(frames):
        import itertools

        import pandas as pd

        for pdf in frames:
            for key in pdf[names].itertuples(index=False, name=None):
                rows = iter(source(*key))
                while part := list(itertools.islice(rows, 10_000)):
                    out = pd.DataFrame(part, columns=columns)
                    for n, k in zip(reversed(names), reversed(key)):
                        out.insert(0, n, k)
                    yield out

    asked = keys.df.select(*names).distinct()
    made = asked.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + schema)
    return Stream(made, tuple(columns[:2]), keys.keys)


def timer(spark: SparkSession, start: str, end: str, seconds: int) -> Stream:
    """Ticks from ``start`` on, at ``start`` itself first, up to ``end``."""
    import datetime as dt

    first, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
    ticks = spark.range(max(0, int((last - first).total_seconds() // seconds) + 1))
    at = F.timestamp_add("SECOND", F.col("id") * seconds, F.lit(first).cast("timestamp_ntz"))
    return Stream(ticks.select(at.alias("ts"), F.col("id").alias("seq")))


def on_trigger(trigger: Stream, **columns) -> Stream:
    """A value computed anew at every event of ``trigger``."""
    return trigger.map(**columns)


def read_ticks(spark: SparkSession, path: str, schema: str, time: str, pattern: str = "yyyyMMdd'T'HHmmss") -> DataFrame:
    """Tab-separated ticks with a header; ``time`` is parsed by ``pattern`` (24 hours)."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    return raw.withColumn(time, F.to_timestamp_ntz(F.col(time), F.lit(pattern)))


def random_walk(spark: SparkSession, keys: Sequence[str], n: int, seed: int = 1, step: float = 1.0) -> Stream:
    """``n`` random steps per key, made where they are used."""
    rows = spark.range(n).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in keys], "key string")))
    df = rows.select("key", F.col("id").alias("ts"), F.col("id").alias("seq"), ((F.rand(seed) - 0.5) * 2 * step).alias("value"))
    return Stream(df, keys=("key",))


def with_arrival(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """A ``seq`` for a table without one, by two levels: rows are numbered inside range partitions of
    ``order``, and each partition starts where those before it end."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # kept, as partition numbers must be the same in both uses
    rows = durable(parts.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    w = Window.partitionBy("__part").orderBy("__row")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = rows.withColumn(name, F.row_number().over(w).cast("bigint")).join(sizes, "__part")
    return numbered.withColumn(name, F.col(name) + F.col("__start") - 1).drop("__part", "__row", "__start")
