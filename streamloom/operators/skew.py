"""Per-key results when a few keys hold most rows.

Heavy keys are found with a frequent-items sketch (map-side, fixed size, no false negatives above its
error) and confirmed by exact counts. Their rows are then processed apart: joins broadcast the few heavy
rows of the other side, aggregates are salted, running values are cut into slices of time; all other keys
take the ordinary shuffle, and both results are united. No row is dropped or sampled.

Defined cases: a null key is no key (``heavy_keys`` ignores it; aggregates and running values give it no
row; joins keep its facts without a match); an empty table gives an empty result; equal order values are
ordered by the further order columns given; columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.bounds import has_at_most
from streamloom.session import durable

SHARE = 0.04


def heavy_keys(df: DataFrame, key: Column | str, share: float = SHARE) -> DataFrame:
    """``hot_key, n_rows, share`` of every key that holds more than ``share`` of the rows with a non-null key.

    There are fewer than ``1 / share`` such keys, which is what bounds later broadcasts."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    at_most = math.ceil(1 / share)
    keys = df.select((F.col(key) if isinstance(key, str) else key).alias("hot_key")).where("hot_key is not null")
    # error of the sketch: about 3.5 / tracked of the rows, here under a fiftieth of the share
    tracked = 2 ** math.ceil(math.log2(max(1024, 175 * at_most)))
    found = keys.agg(F.expr(f"approx_top_k(hot_key, {2 * at_most + 1}, {tracked})").alias("top"))
    candidates = found.select(F.explode("top").alias("top")).select(F.col("top.item").alias("candidate"))
    counted = (
        keys.join(F.broadcast(candidates), F.col("hot_key") == F.col("candidate"), "left")
        .groupBy("candidate")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    # at most 2 / share + 2 rows reach this window
    return (
        counted.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0))))
        .where(F.col("candidate").isNotNull() & (F.col("share") > share))
        .select(F.col("candidate").alias("hot_key"), "n_rows", "share")
    )


def few_heavy_keys(df: DataFrame, key: str, share: float, name: str) -> DataFrame:
    """The heavy keys under ``name``, found once and kept by a checkpoint, since several branches use them."""
    return durable(heavy_keys(df, key, share).select(F.col("hot_key").alias(name)))


def split_by_weight(df: DataFrame, key: str, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The rows of heavy keys and all others (null keys among the others)."""
    heavy = F.broadcast(few_heavy_keys(df, key, share, "__hot"))
    same = df[key] == F.col("__hot")
    return df.join(heavy, same, "left_semi"), df.join(heavy, same, "left_anti")


def aggregate_by_key(df: DataFrame, key: str, sums: Mapping[str, Column], share: float = SHARE, salts: int = 64) -> DataFrame:
    """``key``, ``n_rows`` and a sum per name of ``sums`` for every key. Heavy keys are added up in
    ``salts`` parts first."""
    salt = "__salt"
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), *[c.alias(f"__v{i}") for i, c in enumerate(sums.values())])
    values = [f"__v{i}" for i in range(len(sums))]
    heavy, light = split_by_weight(rows, "__key", share)
    first = [F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(v) for v in values]]
    # the salt follows from the row, so a task that is run again makes the same parts
    parts = heavy.withColumn(salt, F.pmod(F.xxhash64("__key", *values), F.lit(salts))).groupBy("__key", salt).agg(*first)
    of_heavy = parts.groupBy("__key").agg(F.sum("__n").alias("__n"), *[F.sum(v).alias(v) for v in values])
    both = of_heavy.unionByName(light.groupBy("__key").agg(*first))
    return both.select(F.col("__key").alias(key), F.col("__n").alias("n_rows"), *[F.col(v).alias(n) for v, n in zip(values, sums)])


def join_by_key(facts: DataFrame, dims: DataFrame, key: str, columns: Sequence[str], share: float = SHARE, most: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join of ``facts`` with ``columns`` of ``dims`` on ``key``. The dimension rows of heavy keys are
    broadcast; beyond ``most`` of them each is repeated for ``salts`` parts of its key's facts instead. The
    rest is joined by shuffle."""
    side = dims.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    few = F.broadcast(few_heavy_keys(facts, key, share, "__hot"))
    heavy_side = side.join(few, F.col("__key") == F.col("__hot"), "left_semi")
    same = facts[key] == F.col("__hot")
    of_heavy, matched = facts.join(few, same, "left_semi"), F.col(key) == F.col("__key")
    if has_at_most(heavy_side, most):
        of_heavy = of_heavy.join(F.broadcast(heavy_side), matched, "left")
    else:
        salted = of_heavy.withColumn("__salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)))
        parts = heavy_side.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        of_heavy = salted.join(parts, matched & (F.col("__salt") == F.col("__part")), "left")
    of_light = facts.join(few, same, "left_anti").join(side, matched, "left")
    out = [*[F.col(c) for c in facts.columns], *[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)]]
    return of_heavy.select(*out).unionByName(of_light.select(*out))


def running_by_key(df: DataFrame, key: str, order: Sequence[str], value: Column, time_slice: Column, share: float = SHARE) -> DataFrame:
    """``key``, the order columns, ``running_n`` and ``running_sum`` of ``value`` (null counts as 0) for
    every row with a key. ``time_slice`` is a non-decreasing function of the first order column: a heavy
    key is added up slice by slice, with what lies before each slice taken from the table of its slices.
    A null slice counts as the first."""
    names = [f"__o{i}" for i in range(len(order))]
    lowest = -(2**62)
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.coalesce(time_slice.cast("bigint"), F.lit(lowest)).alias("__slice"),
        F.coalesce(value, F.lit(0)).alias("__v"), *[F.col(c).alias(n) for c, n in zip(order, names)],
    )
    heavy, light = split_by_weight(rows, "__key", share)

    def running(x: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
        return x.withColumns({"__n": F.count(F.lit(1)).over(w), "__sum": F.sum("__v").over(w)})

    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = heavy.groupBy("__key", "__slice").agg(F.count(F.lit(1)).alias("__cn"), F.sum("__v").alias("__cs"))
    slices = slices.select(
        "__key", "__slice", F.coalesce(F.sum("__cn").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__cs").over(before), F.lit(0)).alias("__s0")
    )
    of_heavy = running(heavy, "__key", "__slice").join(slices, ["__key", "__slice"])
    of_heavy = of_heavy.withColumns({"__n": F.col("__n") + F.col("__n0"), "__sum": F.col("__sum") + F.col("__s0")})
    out = [F.col("__key").alias(key), *[F.col(n).alias(c) for c, n in zip(order, names)], F.col("__n").alias("running_n"), F.col("__sum").alias("running_sum")]
    return of_heavy.select(*out).unionByName(running(light, "__key").select(*out))
