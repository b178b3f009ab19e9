"""Flagged readings against a plain scan of each date, without filter, slices or seams."""

from __future__ import annotations

import datetime as dt
import os
import random
from collections import defaultdict
from statistics import median

import numpy as np
import pytest

from streamloom.operators.spikes import flag_readings

SCHEMA = "seq bigint, ticker string, time timestamp_ntz, price double, quantity bigint, slice int, flag string"
T0 = dt.datetime(2020, 1, 1, 8)
TABLES = os.environ.get("STREAMLOOM_TABLES", "/root/testdata/sf0.001")


def stands_off(v: float, side: list[float], usual: float) -> bool:
    middle = median(side)
    return abs(v - middle) > min(max(3 * 1.4826 * median(abs(x - middle) for x in side), 3 * usual), 6 * usual)


def candidates(x: list[float], usual: float) -> list[bool]:
    """Off the rolling medians of the seven readings before and of the seven after, over the whole date."""
    sides = [(x[max(0, i - 7) : i], x[i + 1 : i + 8]) for i in range(len(x))]
    return [bool(b and a) and stands_off(v, b, usual) and stands_off(v, a, usual) for v, (b, a) in zip(x, sides)]


def spikes_of(x: list[float], far: float, candidate: list[bool]) -> set[int]:
    out, sound, i = set(), None, 0
    while i < len(x):
        found = 0
        if sound is not None and abs(x[i] - sound) > far:
            side = 1 if x[i] > sound else -1
            for k in (1, 2, 3):
                if i + k < len(x) and all(candidate[i : i + k]) and all((v - sound) * side > far and (v - x[i + k]) * side > far for v in x[i : i + k]):
                    found = k
                    break
        if found:
            out |= set(range(i, i + found))
            i += found
        else:
            sound = x[i]
            i += 1
    return out


def brute(rows, tick, levels=("price",), sizes=("quantity",), columns=("seq", "ticker", "time", "price", "quantity")) -> set:
    at = {c: i for i, c in enumerate(columns)}
    kept = {}
    for r in sorted(rows, key=lambda r: r[0]):
        kept.setdefault(tuple("nan" if v != v else v for v in r[1:]), r)
    series = defaultdict(list)
    for r in sorted((r for r in kept.values() if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        for f in (*levels, *sizes):
            if r[at[f]] is not None:
                series[r[1], f, r[2].date()].append((r[0], float(r[at[f]])))
    usual = defaultdict(list)
    for (name, f, _), g in series.items():
        x = [v for _, v in g if v > 0]
        if f in sizes:
            usual[name, f] += x
        else:
            usual[name, f] += [abs(b - a) for a, b in zip(x, x[1:]) if abs(b - a) >= tick.get(name, 0) * (1 - 1e-6) and a != b]
    out = set()
    for (name, f, _), g in series.items():
        u = median(usual[name, f]) if usual[name, f] else 0
        good = [(s, v) for s, v in g if v > 0]
        out |= {(s, f, "impossible") for s, v in g if not v > 0}
        frozen = set()
        run = [g[0]]
        for p in [*g[1:], (None, object())]:
            if p[1] == run[-1][1]:
                run.append(p)
            else:
                if len(run) >= 25:
                    frozen |= {s for s, v in run if v > 0}
                run = [p]
        out |= {(s, f, "frozen") for s in frozen}
        good = [(s, v) for s, v in good if s not in frozen]
        if u > 0:
            x = [v for _, v in good]
            far = {i for i, v in enumerate(x) if v > 25 * u} if f in sizes else spikes_of(x, 12 * u, candidates(x, u))
            out |= {(good[i][0], f, "spike") for i in far if good[i][0] not in frozen}
    return out


def fixture(n: int, seed: int, span: int):
    rng = random.Random(seed)
    level, rows = {"A": 100.0, "B": 5.0, None: 1.0}, []
    for s in range(n):
        name = rng.choice(["A", "A", "A", "B", None])
        level[name] += rng.choice([0, 0, 1, -1]) * 0.01
        if rng.random() < 0.004:
            level[name] += 3
        price = level[name]
        if rng.random() < 0.02:
            price += rng.choice([2, -2, 3])
        price = rng.choice([price] * 60 + [None, float("nan"), 0.0, -1.0])
        if s % 400 < 90:
            price = 42.0
        quantity = rng.choice([10, 11, 12, 500, None, 0, -5]) if rng.random() < 0.1 else rng.randrange(5, 15)
        t = None if rng.random() < 0.01 else T0 + dt.timedelta(seconds=span * s / n + rng.random() * 30)
        rows.append((s, name, t, round(price, 4) if price is not None else None, quantity, 1, "x"))
        if rng.random() < 0.02:
            rows.append((n + s, *rows[-1][1:]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,span,seconds,flush", [(1, 30_000, 3600, None), (2, 200_000, 3600, None), (3, 20_000, 40_000, 300)])
def test_random(spark, seed, span, seconds, flush):
    rows = fixture(3000, seed, span)
    ticks = spark.createDataFrame([("A", 0.01), ("B", 0.01)], "src string, tick double")
    got = flag_readings(spark.createDataFrame(rows, SCHEMA), table="t", source="ticker", time="time", seq="seq", levels=["price"], sizes=["quantity"], ticks=ticks, slice_seconds=seconds, flush=flush).collect()
    assert len(got) == len({(r.seq, r.field) for r in got})
    want = brute([r[:5] for r in rows], {"A": 0.01, "B": 0.01})
    assert {(r.seq, r.field, r.reason) for r in got} == want
    assert len({x for _, _, x in want}) == 3


def test_empty(spark):
    ticks = spark.createDataFrame([], "src string, tick double")
    args = {"table": "t", "source": "ticker", "time": "time", "seq": "seq", "levels": ["price"], "sizes": ["quantity"], "ticks": ticks}
    assert flag_readings(spark.createDataFrame([], SCHEMA), **args).count() == 0
    one = [(1, "A", T0, 0.0, 5, 1, "x"), (2, "A", T0, None, None, 1, "x")]
    assert [(r.seq, r.field, r.reason) for r in flag_readings(spark.createDataFrame(one, SCHEMA), **args).collect()] == [(1, "price", "impossible")]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_query(spark):
    import duckdb

    from streamloom.plans.problems import flagged

    tick = dict(duckdb.sql(f"SELECT ticker, tick FROM '{TABLES}/instruments.parquet'").fetchall())
    quotes = duckdb.sql(f"SELECT seq, ticker, time, bid, ask, bidDepth, askDepth FROM '{TABLES}/quotes.parquet'").fetchall()
    trades = duckdb.sql(f"SELECT seq, ticker, time, price, quantity, board, source, buyer, seller, initiator FROM '{TABLES}/trades.parquet'").fetchall()
    want = {("quotes", *x) for x in brute(quotes, tick, ("bid", "ask"), (), ("seq", "ticker", "time", "bid", "ask"))} | {("trades", *x) for x in brute(trades, tick)}
    got = [(r.tbl, r.seq, r.field, r.reason) for r in flagged(spark, TABLES).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def series(values: list[float], seconds: float = 20.0):
    return [(i, "A", T0 + dt.timedelta(seconds=seconds * i), v, 10 + i % 3, 1, "x") for i, v in enumerate(values)]


def flags(spark, rows, **more):
    ticks = spark.createDataFrame([("A", 0.01)], "src string, tick double")
    args = {"table": "t", "source": "ticker", "time": "time", "seq": "seq", "levels": ["price"], "sizes": ["quantity"], "ticks": ticks, "slice_seconds": 300} | more
    return {(r.seq, r.field, r.reason) for r in flag_readings(spark.createDataFrame(rows, SCHEMA), **args).collect()}


def walk(n: int, seed: int) -> list[float]:
    rng = random.Random(seed)
    x = [100.0]
    for _ in range(n - 1):
        x.append(round(x[-1] + rng.choice([0.01, -0.01, 0]), 2))
    return x


def test_long_to_and_fro(spark):
    """No calm reading for many slices: the state is that of the whole date."""
    for seed, period in ((1, 2), (2, 3), (3, 5), (4, 7)):
        x = walk(900, seed)
        for i in range(100, 800):
            x[i] += 5 * (i % period == 0) + 3 * (i % 11 == 0)
        rows = series(x)
        assert flags(spark, rows) == brute([r[:5] for r in rows], {"A": 0.01})


def test_the_filter_decides(spark, monkeypatch):
    """A first reading at the level that follows is no spike, by the filter alone; without a filter that finds
    candidates there are no spikes at all."""
    import streamloom.operators.spikes as m

    x = [v + (5 if i == 60 or i >= 63 else 0) + (9 if i == 30 else 0) for i, v in enumerate(walk(120, 1))]
    assert flags(spark, series(x)) == {(30, "price", "spike")}
    every = lambda v, *_: (np.ones(len(v), bool), np.ones(len(v), bool))
    usual = np.full(120, 0.01)
    found, known = m.hampel(np.array(x), usual, 3)
    assert known.sum() == 106 and set(np.flatnonzero(found)) >= {30} and not found[60]
    assert set(np.flatnonzero(m.confirmed(np.array(x), every(x)[0], usual, 12, 3))) == {30, 60}
    assert set(np.flatnonzero(m.confirmed(np.array(x), found, usual, 12, 3))) == {30}
    assert not m.confirmed(np.array(x), ~every(x)[0], usual, 12, 3).any()


def test_rolling():
    import streamloom.operators.spikes as m

    x = np.random.default_rng(1).normal(size=500)
    for width in (7, 5):
        med, mad = m.rolling(x, width)
        views = np.lib.stride_tricks.sliding_window_view(x, width)
        assert np.array_equal(med, np.median(views, axis=1)) and np.allclose(mad, np.median(np.abs(views - med[:, None]), axis=1))


def test_many_sources_and_no_tick(spark):
    """Sources beyond what is sent to the tasks; continuous changes without a tick, whose median is selected by ranges."""
    rng = random.Random(5)
    rows = [(i, "AB"[i % 2], T0 + dt.timedelta(seconds=i), 50 + rng.gauss(0, 1) + (200 if i % 501 == 77 else 0), rng.randrange(1, 10**6), 1, "x") for i in range(2000)]
    want = brute([r[:5] for r in rows], {})
    ticks = spark.createDataFrame([("A", None), ("C", 1.0)], "src string, tick double")
    for few in (0, 1000):
        assert flags(spark, rows, few_sources=few, ticks=ticks) == want and want


def test_one_exchange(spark):
    """Both passes read one exchange."""
    rows = series(walk(50, 1))
    ticks = spark.createDataFrame([("A", 0.01)], "src string, tick double")
    df = flag_readings(spark.createDataFrame(rows, SCHEMA), table="t", source="ticker", time="time", seq="seq", levels=["price"], ticks=ticks)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
