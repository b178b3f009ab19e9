"""Hot keys and orphan references against plain Python."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from streamloom.operators.orphans import clean_key, life_spans, orphan_report, orphan_rows
from streamloom.operators.skew import aggregate_by_key, heavy_keys, join_by_key, running_by_key

SCHEMA = "seq bigint, t bigint, k string, v bigint, hot_key string, candidate int"


def fixture(n: int = 3000, seed: int = 1):
    rng = random.Random(seed)
    key = lambda: rng.choice(["HOT"] * 40 + ["WARM"] * 6 + [None] * 5 + [f"k{i}" for i in range(60)])
    return [(s, rng.randrange(10**7), key(), rng.choice([None, 1, 2, 3]), "clash", 0) for s in range(n)]


def test_heavy(spark):
    rows = fixture()
    counts = Counter(r[2] for r in rows if r[2] is not None)
    want = {k: n for k, n in counts.items() if n > 0.04 * sum(counts.values())}
    got = {r.hot_key: r.n_rows for r in heavy_keys(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    assert got == want and "HOT" in want
    assert heavy_keys(spark.createDataFrame([], SCHEMA), "k").count() == 0
    assert heavy_keys(spark.createDataFrame([(1, 1, None, 1, "", 1)], SCHEMA), "k").count() == 0
    # exactly the share is not more than it
    even = [(i, i, f"k{i % 25}", 1, "", 1) for i in range(100)]
    assert heavy_keys(spark.createDataFrame(even, SCHEMA), "k").count() == 0


def test_totals_and_running(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.k: (r.n_rows, r.total) for r in aggregate_by_key(df, "k", {"total": F.col("v")}).collect()}
    assert got == {k: (sum(r[2] == k for r in rows), sum(r[3] or 0 for r in rows if r[2] == k)) for k in {r[2] for r in rows} - {None}}
    state, want = {}, {}
    for s, t, k, v, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if k is not None:
            n, total = state.get(k, (0, 0))
            state[k] = want[s] = (n + 1, total + (v or 0))
    got = running_by_key(df, "k", ["t", "seq"], F.col("v"), F.floor(F.col("t") / 10**6)).collect()
    assert {r.seq: (r.running_n, r.running_sum) for r in got} == want and len(got) == len(want)


def test_join(spark):
    rows = fixture(500)
    dims = [("HOT", 1), ("k1", 2), ("k2", 3), (None, 9)]
    look = {k: w for k, w in dims if k}
    for most in (100_000, 0):  # broadcast or salted
        got = join_by_key(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(dims, "k string, w int"), "k", ["w"], most=most).collect()
        assert sorted((r.seq, r.w or 0) for r in got) == sorted((r[0], look.get(r[2]) or 0) for r in rows)


PARENTS = "seq bigint, time bigint, orderId string, op string, n int"
CHILDREN = "seq bigint, time bigint, orderId string, n int, m_key string"


def test_orphans(spark):
    day = 86_400_000
    parents = [(1, 10, "a", "new", 1), (2, 50, "B ", "new", 1), (3, 100, "b", "del", 1), (4, 5, "c", "del", 1), (5, 1, None, "new", 1), (6, None, "d", "new", 1)]
    children = [
        (1, 10, " A", 0, "x"), (2, 9, "a", 0, "x"), (3, 50, "b", 0, "x"), (4, 100, "b", 0, "x"), (5, 99, "b", 0, "x"), (6, 7, "c", 0, "x"), (7, day, "nope", 0, "x"), (8, 1, None, 0, "x"),
        (9, 1, "  ", 0, "x"), (10, 1, "d", 0, "x"), (11, day, "nope", 0, "x"), (12, None, "a", 0, "x"), (13, None, "nope", 0, "x"),
    ]
    hot = [(100 + i, 2 * day + i, "gone", 0, "x") for i in range(50)] + [(200 + i, 20, "a", i, "x") for i in range(50)]
    spans = life_spans(spark.createDataFrame(parents, PARENTS), "orderId", "time", F.col("op") == "new", F.col("op") == "del")
    out = orphan_rows(spark.createDataFrame(children + hot, CHILDREN), spans, "orderId", "time", "seq", "t")
    assert sorted(r.seq for r in out.collect()) == [2, 4, 6, 7, 10, 13, *range(100, 150)]
    report = {r.period: (r.n_orphans, r.n_keys) for r in orphan_report(out).collect()}
    assert report == {"1970-01-01": (4, 4), "1970-01-02": (1, 1), "1970-01-03": (50, 1), None: (1, 1)}
    none = spark.createDataFrame([], CHILDREN)
    assert orphan_rows(none, spans, "orderId", "time", "seq", "t").count() == 0
    no_parents = life_spans(spark.createDataFrame([], PARENTS), "orderId", "time", F.col("op") == "new", F.col("op") == "del")
    assert orphan_rows(spark.createDataFrame(children, CHILDREN), no_parents, "orderId", "time", "seq", "t").count() == 10


def test_clean_key(spark):
    df = spark.createDataFrame([(" ab ",), ("",), ("  ",), (None,)], "k string")
    assert [r[0] for r in df.select(clean_key(F.col("k"))).collect()] == ["AB", None, None, None]
