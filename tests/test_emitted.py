"""Rows that a query makes out of few others (keys x triggers) are emitted where they are made: no exchange, sort
or join comes after them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.functions import aggs as A
from streamloom.operators import joins
from streamloom.operators.windows import toggled
from streamloom.sinks import trace


def emitted_where_made(df) -> bool:
    plan = trace(Stream(df))
    above = plan.split("Generate")[0]
    return "Generate" in plan and not any(x in above for x in ("Exchange", "Sort", "Join", "Aggregate"))


def some(spark, n: int = 400, keys: int = 7):
    """Rows (key, ts, seq, value), ``ts`` with ties, and the stream per key of them."""
    r = random.Random(5)
    rows = [(r.randrange(keys), i // 3, i, r.randrange(100)) for i in range(n)]
    return rows, Stream(spark.createDataFrame(rows, "key int, ts bigint, seq bigint, value int"), keys=("key",))


def test_slices_of_one_trigger_for_all_keys(spark):
    rows, s = some(spark)
    out = s.group(Stream(s.df.where("value > 80").drop("key"), s.order)).reduce(A.Sum("value"), A.Count())
    assert emitted_where_made(out)
    bucket, want, born = 0, {}, {}
    for key, _, _, value in rows:
        born.setdefault(key, bucket)
        a = want.get((key, bucket), (0, 0))
        want[key, bucket] = (a[0] + value, a[1] + 1)
        bucket += value > 80
    want |= {(k, b): (0, 0) for k, first in born.items() for b in range(first, bucket + 1) if (k, b) not in want}
    assert {(r.key, r.bucket): (r.sum, r.n) for r in out.collect()} == want and out.count() == len(want)


def windows(rows, kept, mark, group=lambda key: 0, marked_by=lambda key: 0):
    """(key, window_id): (sum, n) of windows that open and close at alternate marks of the key's group. Rows that
    aren't kept only move the windows."""
    opened, number, first, out = {}, {}, {}, {}
    for key, _, seq, value in rows:
        if mark(key, value):
            m = marked_by(key)
            opened[m] = not opened.get(m, False)
            number[m] = number.get(m, 0) + opened[m]
        if seq not in kept:
            continue
        g = group(key)
        n = number.get(g, 0)
        if key not in first:
            first[key] = n if opened.get(g) else n + 1
        if opened.get(g):
            a = out.get((key, n - first[key] + 1), (0, 0))
            out[key, n - first[key] + 1] = (a[0] + value, a[1] + 1)
    closed = {k: number.get(group(k), 0) - opened.get(group(k), False) - a + 1 for k, a in first.items()}
    return {(k, w): out.get((k, w), (0, 0)) for k, last in closed.items() for w in range(1, last + 1)}


def late(rows):
    """Without the first rows of some keys, so that these begin inside windows, outside, or near the end."""
    return [r for r in rows if not (r[0] in (1, 2, 3) and r[2] < 60 * r[0] or r[0] == 4 and r[2] < 380)]


def test_one_window_for_all_keys(spark):
    rows, s = some(spark)
    flips = toggled(Stream(s.df.where("value > 80").drop("key"), s.order))
    out = Stream(spark.createDataFrame(late(rows), s.df.schema), s.order, s.keys).window(flips).reduce(A.Sum("value"), A.Count())
    assert emitted_where_made(out)
    want = windows(rows, {r[2] for r in late(rows)}, lambda k, v: v > 80)
    assert {(r.key, r.window_id): (r.sum, r.n) for r in out.collect()} == want and out.count() == len(want)


@pytest.mark.parametrize(("block", "blocks"), [(4096, 256), (4, 256), (4, 0)])
def test_samples_of_all_keys(spark, monkeypatch, block, blocks):
    """Events in one block, in several, and in too many for a broadcast; some in the cycle of a value."""
    monkeypatch.setattr(joins, "BLOCK", block, raising=False)
    monkeypatch.setattr(joins, "BLOCKS", blocks, raising=False)
    rows, s = some(spark)
    kept = [r for r in late(rows) if r[3] <= 60 or r[3] % 2]
    marks = Stream(s.df.where("value > 50").select("ts", "seq", F.col("value").alias("m")), s.order)
    values = Stream(spark.createDataFrame(kept, s.df.schema).withColumnRenamed("value", "bucket"), s.order, s.keys)
    out = joins.sample(values, marks)
    assert emitted_where_made(out.df) and out.df.columns == ["key", "ts", "seq", "bucket"]
    latest, want = {}, []
    by_seq = {r[2]: r for r in kept}
    for _, ts, seq, value in rows:
        if seq in by_seq:
            latest[by_seq[seq][0]] = value
        if value > 50:
            want += [(k, ts, seq, v) for k, v in latest.items()]
    assert sorted(map(tuple, out.df.collect())) == sorted(want)


def test_one_window_for_the_keys_of_a_group(spark):
    """By two groups, which have marks of their own; one key's group has none. Running values are those of the
    windows that are copied for each key."""
    rows, s = some(spark)
    group = lambda k: k % 3
    flips = toggled(s.filter((F.col("value") > 70) & (F.col("key") % 3 < 2)).by(g=F.col("key") % 3))
    few = Stream(spark.createDataFrame(late(rows), s.df.schema), s.order, s.keys)
    out = few.window(flips, key_map=group).reduce(A.Sum("value"), A.Count())
    assert emitted_where_made(out)
    mark = lambda key, value: value > 70 and key % 3 < 2
    want = windows(rows, {r[2] for r in late(rows)}, mark, group, group)
    assert {(r.key, r.window_id): (r.sum, r.n) for r in out.collect()} == want and out.count() == len(want)
    copied = Stream(joins._fan_out(few, flips, group), s.order, s.keys)
    columns = ["key", "ts", "seq", "value", "window_id", "sum"]
    got, by_key = (sorted(map(str, w.scan(A.Sum("value")).df.select(*columns).collect())) for w in (few.window(flips, key_map=group), few.window(copied)))
    assert got == by_key
