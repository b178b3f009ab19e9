"""Nearest matches against all pairs, on a small fixture."""

from __future__ import annotations

import datetime as dt
import random

from streamloom.llm.nearest import match_nearest

T0 = dt.datetime(2020, 1, 1, 23, 50)
LEFT = "id bigint, who string, t timestamp_ntz, x double, ent string, bucket int"
RIGHT = "id bigint, who string, t timestamp_ntz, y double, right boolean"


def fixture(n: int, seed: int):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.03 else T0 + dt.timedelta(milliseconds=500 * rng.randrange(3000))
    who = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(i, who(), at(), rng.choice([1.0, None]), "e", 1) for i in range(n)]
    left += [(n + i, *left[rng.randrange(n)][1:]) for i in range(n // 10)]
    right = [(i, who(), at(), float(i), True) for i in range(n)]
    return left, right


def brute(left, right, tolerance):
    kept = {}
    for r in sorted(left, key=lambda r: r[0]):
        kept.setdefault(r[1:], r)
    out = set()
    for r in kept.values():
        near = [(abs((q[2] - r[2]).total_seconds() * 1e6), q[2], q[0]) for q in right if q[1] == r[1] is not None and q[2] and r[2]]
        best = min((x for x in near if x[0] <= tolerance), default=None)
        out.add((r[0], best and best[2]))
    return out


def run(spark, left, right, **more):
    args = {"entity": "who", "time": "t", "left_id": "id", "right_id": "id", "tolerance_us": 5_000_000, "left_columns": ["x"], "right_columns": ["y"]} | more
    got = match_nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), **args).collect()
    assert len(got) == len({r.left_id for r in got})
    assert all(r.right_id is None or r.right_y == r.right_id for r in got)
    return {(r.left_id, r.right_id) for r in got}


def test_random(spark):
    left, right = fixture(600, 1)
    assert run(spark, left, right, bucket_seconds=30) == brute(left, right, 5_000_000)
    assert run(spark, left, right, bucket_seconds=3) == brute(left, right, 5_000_000)


def test_small_groups(spark):
    import streamloom.llm.nearest as m

    left, right = fixture(400, 2)
    whole, m.FLUSH = m.FLUSH, 10
    try:
        assert run(spark, left, right, bucket_seconds=20) == brute(left, right, 5_000_000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
        assert run(spark, left, right, bucket_seconds=3600) == brute(left, right, 5_000_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        m.FLUSH = whole


def test_empty(spark):
    left, right = fixture(20, 3)
    assert run(spark, [], right) == set()
    assert {b for _, b in run(spark, left, [])} == {None}


def test_copies(spark):
    """Copies are equal in all columns but the id; -0.0 equals 0.0, and a null is no other column's null."""
    t = T0
    left = [(1, "a", t, 0.0, "e", 1), (2, "a", t, -0.0, "e", 1), (3, "a", t, None, "e", 1), (4, "a", t, None, None, 1), (5, "a", t, float("nan"), "e", 1), (6, "a", t, float("nan"), "e", 1), (7, "a", t, 0.0, "e", 2)]
    got = match_nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame([(9, "a", t, 1.0, True)], RIGHT), entity="who", time="t", left_id="id", right_id="id", tolerance_us=1)
    assert sorted(r.left_id for r in got.collect()) == [1, 3, 4, 5, 7]
