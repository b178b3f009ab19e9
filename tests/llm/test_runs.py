"""Runs against a plain scan of the whole date."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from streamloom.llm import runs as R
from streamloom.llm.runs import collapse_runs

SCHEMA = "seq bigint, ticker string, time timestamp_ntz, bid double, bidDepth bigint, ask double, askDepth bigint, slice int, n string"
T0 = dt.datetime(2020, 1, 1, 8)


def within(anchor, event, tol: float, n_abs: int, rel: float) -> bool:
    for i, (a, b) in enumerate(zip(anchor, event)):
        if a is None or b is None:
            if a is not b:
                return False
        elif not abs(a - b) <= (tol * (1 + 1e-6) if i < n_abs else rel * abs(a) * (1 + 1e-9)) and (a == a or b == b):
            return False
    return True


def brute(rows, tick: dict, least: int) -> set:
    kept = {}
    for r in sorted(rows, key=lambda r: r[0]):
        kept.setdefault(r[1:], r)
    groups = defaultdict(list)
    out = set()
    for r in kept.values():
        if r[1] is None or r[2] is None:
            if least < 2:
                out.add((r[1], r[0], r[0], 1))
        else:
            groups[r[1], r[2].date()].append(r)
    for (name, _), g in groups.items():
        g.sort(key=lambda r: (r[2], r[0]))
        runs = []
        for r in g:
            v = (r[3], r[5], r[4], r[6])
            if runs and within(runs[-1][0], v, tick.get(name, 0.0) / 2, 2, 0.02):
                runs[-1][1].append(r)
            else:
                runs.append((v, [r]))
        out |= {(name, x[0][0], x[-1][0], len(x)) for _, x in runs if len(x) >= least}
    return out


def random_rows(n: int, seed: int, spread: int) -> list[tuple]:
    rng = random.Random(seed)
    rows, nan = [], float("nan")
    for s in range(n):
        name = rng.choice(["A", "A", "A", "B", "C", None])
        t = None if rng.random() < 0.02 else T0 + dt.timedelta(seconds=rng.randrange(spread))
        bid = rng.choice([10.0, 10.0, 10.004, 10.0049, 10.02, None, nan, 0.0, -0.0])
        rows.append((s, name, t, bid, rng.choice([100, 101, 102, 150, None]), rng.choice([11.0, 11.0, 11.003]), rng.choice([50, 50, 51]), 1, "x"))
        if rng.random() < 0.05:
            rows.append((n + s, *rows[-1][1:]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,spread,least", [(1, 7200, 1), (2, 50_000, 2), (3, 200_000, 2), (4, 60, 1)])
def test_random(spark, seed, spread, least, rows=None, flush=None):
    rows = rows or random_rows(3000, seed, spread)
    tick = {"A": 0.01, "B": 0.01}
    df = spark.createDataFrame(rows, SCHEMA)
    ticks = spark.createDataFrame([(k, v / 2) for k, v in tick.items()], "ent string, tol double")
    for seconds in (300,):
        got = collapse_runs(df, entity="ticker", time="time", seq="seq", absolute=["bid", "ask"], relative=["bidDepth", "askDepth"], tolerance=ticks, rel_tolerance=0.02, least=least, slice_seconds=seconds, flush=flush)
        got = [(r.ticker, r.first_seq, r.last_seq, r.n_events) for r in got.collect()]
        assert len(got) == len(set(got))
        canon = [tuple(0.0 if isinstance(x, float) and x == 0 else x for x in r) for r in rows]
        canon = [tuple("nan" if isinstance(x, float) and x != x else x for x in r) for r in canon]
        canon = [tuple(float("nan") if x == "nan" else x for x in r) for r in {r[1:]: r for r in sorted(canon, key=lambda r: -r[0])}.values()]
        assert set(got) == brute(canon, tick, least)


def test_small_batches(spark):
    """State is carried from batch to batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_random(spark, 5, 4000, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_duration(spark):
    args = {"entity": "ticker", "time": "time", "seq": "seq", "absolute": ["bid"], "relative": ["bidDepth"]}
    assert collapse_runs(spark.createDataFrame([], SCHEMA), **args).count() == 0
    rows = [(1, "A", T0, 1.0, 5, None, None, 0, ""), (2, "A", T0 + dt.timedelta(hours=3), 1.0, 5, None, None, 0, ""), (3, "A", T0 + dt.timedelta(days=1), 1.0, 5, None, None, 0, "")]
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), **args).orderBy("first_seq").collect()
    assert [(r.first_seq, r.last_seq, r.n_events, r.duration_us) for r in got] == [(1, 2, 2, 3 * 3600 * 10**6), (3, 3, 1, 0)]


def cycling(n: int, values, seconds: float) -> list[tuple]:
    return [(i, "A", T0 + dt.timedelta(seconds=seconds * i), values[i % len(values)], 100 + i % 3, 11.0, 50, 1, "x") for i in range(n)]


@pytest.mark.parametrize("values", [(10.0, 10.004), (10.0, 10.004, 10.008), (10.0, 10.003, 10.006, 10.009, 10.012), tuple(10 + 0.0011 * (i * 7 % 13) for i in range(13))])
def test_quiet_and_cycling(spark, values):
    """Values that drift within tolerance of each other without any certain break, over many slices."""
    test_random(spark, 0, 0, 1, cycling(2500, values, 1.7))
    test_random(spark, 0, 0, 2, cycling(1500, values, 1.7), flush=40)


def test_seam_is_bounded(spark):
    """A slice hands on a few rows, however many events it has."""
    tables = []
    for n in (2000, 20_000):
        df = spark.createDataFrame(cycling(n, (10.0, 10.004, 10.008), 0.05), SCHEMA)
        kept, R.durable = R.durable, lambda x: tables.append(kept(x)) or tables[-1]
        try:
            collapse_runs(df, entity="ticker", time="time", seq="seq", absolute=["bid", "ask"], relative=["bidDepth", "askDepth"], tolerance=spark.createDataFrame([("A", 0.005)], "ent string, tol double"), rel_tolerance=0.02)
        finally:
            R.durable = kept
    assert [t.where("kind = 1").groupBy("slice").count().agg(F.max("count")).first()[0] for t in tables] == [4, 4]


def test_the_difference_decides(spark):
    """Without the difference of row numbers, runs of equal values would be one."""
    rows = cycling(600, (10.0, 10.0, 10.02, 10.02, 10.0), 9)
    ticks = spark.createDataFrame([("A", 0.005)], "ent string, tol double")
    run = lambda: collapse_runs(spark.createDataFrame(rows, SCHEMA), entity="ticker", time="time", seq="seq", absolute=["bid", "ask"], tolerance=ticks).count()
    assert run() == len(brute([(*r[:4], 1, *r[5:6], 1, *r[7:]) for r in rows], {"A": 0.01}, 1))
