"""Golden sequences of the expression language, with Python lists as oracles."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from streamloom.core import Stream
from streamloom.functions import aggs as A
from streamloom.functions.folds import EwmaRefFold, LatestFold, SlicedFold, SumFold, WindowFold, reduce_fold, scan_fold
from streamloom.operators import vector as V
from streamloom.operators.bind import bind
from streamloom.operators.buckets import Every, events
from streamloom.operators.joins import join, sample, take
from streamloom.operators.windows import toggled
from streamloom.order import merge_sources, prefix
from streamloom.sources.basic import as_vector, from_values, lazy_vector, on_trigger, random_walk, read_ticks, timer, with_arrival
from streamloom.sinks import emitted, out, series, table_view, trace

VALUE = A.Collect("value", "list")


def text(df, *by, column="list"):
    rows = df.orderBy(*by).collect()
    return ["".join(r[column]) for r in rows]


def chars(spark, s="abcdefghijk"):
    return from_values(spark, s, "string")


def ints(spark, values):
    return from_values(spark, values, "int")


def alnum(spark):
    s = from_values(spark, "a0b1c2d3e4f5g6h7i8j9k", "string")
    return s.by(key=F.when(F.col("value").rlike("[0-9]"), "Digit").otherwise("Alpha"))


def test_scan_chars(spark):
    out = chars(spark).scan(VALUE)
    assert ["".join(x) for x in emitted(out, "list")] == ["abcdefghijk"[: i + 1] for i in range(11)]


def test_group_three(spark):
    g = chars(spark).group(events(3))
    assert text(g.reduce(VALUE), "bucket") == ["abc", "def", "ghi", "jk"]
    assert ["".join(x) for x in emitted(g.scan(VALUE), "list")] == ["a", "ab", "abc", "d", "de", "def", "g", "gh", "ghi", "j", "jk"]
    # nine events: the bucket at termination is empty
    nine = chars(spark, "abcdefghi").group(events(3))
    assert text(nine.reduce(VALUE), "bucket") == ["abc", "def", "ghi", ""]
    assert text(nine.reduce(VALUE, emit_empty=False), "bucket") == ["abc", "def", "ghi"]


def test_sum_of_three(spark):
    assert [r.sum for r in ints(spark, range(1, 12)).group(events(3)).reduce(A.Sum("value")).orderBy("bucket").collect()] == [6, 15, 24, 21]


def test_set_scan(spark):
    assert emitted(chars(spark, "abab").scan(A.SetOf("value", "set")), "set") == [["a"], ["a", "b"], ["a", "b"], ["a", "b"]]


@pytest.mark.parametrize("align,buckets,running", [("before", [3, 13], [1, 2, 3, 10, 11, 12, 13]), ("after", [13, 3], [1, 2, 3, 13, 1, 2, 3])])
def test_slices(spark, align, buckets, running):
    s = ints(spark, [1, 1, 1, 10, 1, 1, 1])
    for trigger in (F.col("value") == 10, s.filter(F.col("value") == 10)):
        g = s.group(trigger, align)
        assert [r.sum for r in g.reduce(A.Sum("value")).orderBy("bucket").collect()] == buckets
        assert emitted(g.scan(A.Sum("value")), "sum") == running


@pytest.mark.parametrize("align,alpha,digit", [("after", ["ab", "cd", "efghijk"], ["012345", "6789"]), ("before", ["a", "bc", "defghijk"], ["01234", "56789"])])
def test_keyed_trigger(spark, align, alpha, digit):
    s = alnum(spark)
    for trigger in (F.col("value").isin("b", "5", "d"), s.filter(F.col("value").isin("b", "5", "d"))):
        out = s.group(trigger, align).reduce(VALUE)
        assert text(out.where("key = 'Alpha'"), "bucket") == alpha
        assert text(out.where("key = 'Digit'"), "bucket") == digit


def counter(spark):
    s = ints(spark, range(27)).with_columns(x=F.col("value"), y=F.when(F.col("value") % 5 == 0, F.col("value")))
    return s.by(key=F.when(F.col("value") % 2 == 0, "Even").otherwise("Odd"))


@pytest.mark.parametrize(
    "align,even,odd,totals",
    [
        ("before", [(0, 10, 4, 2), (12, 20, 4, 1), (22, 26, 3, 0)], [(1, 9, 4, 1), (11, 21, 5, 1), (23, 25, 1, 1)], [11, 11, 5]),
        ("after", [(0, 10, 4, 2), (12, 22, 5, 1), (24, 26, 2, 0)], [(1, 11, 5, 1), (13, 21, 4, 1), (23, 25, 1, 1)], [12, 11, 4]),
    ],
)
def test_counter(spark, align, even, odd, totals):
    s = counter(spark)
    trigger = ints(spark, range(27)).filter((F.col("value") > 0) & (F.col("value") % 11 == 0))
    aggs = [A.First("x"), A.Last("x"), A.CountIf(F.col("y").isNull(), "n_x"), A.CountIf(F.col("y").isNotNull(), "n_both")]
    out = s.group(trigger, align).reduce(*aggs)
    for key, want in (("Even", even), ("Odd", odd)):
        assert [(r.first, r.last, r.n_x, r.n_both) for r in out.where(f"key = '{key}'").orderBy("bucket").collect()] == want
    assert [r.n for r in s.to_stream().group(Stream(trigger.df, trigger.order), align).reduce(A.Count()).orderBy("bucket").collect()] == totals


def test_window_chars(spark):
    s = chars(spark)
    opened = F.col("seq").between(0, 2) | F.col("seq").between(5, 8)
    assert ["".join(x) for x in emitted(s.window(opened).scan(VALUE), "list")] == ["a", "ab", "abc", "f", "fg", "fgh", "fghi"]
    assert text(s.window(opened).reduce(VALUE), "window_id") == ["abc", "fghi"]
    # as a stream of its own, with edges between the values
    edges = Stream(spark.createDataFrame([(0, 0, True), (3, 3, False), (5, 5, True), (9, 9, False)], "ts bigint, seq bigint, open boolean"))
    assert text(s.window(edges).reduce(VALUE), "window_id") == ["abc", "fghi"]


def test_window_mixed(spark):
    rows = [1, 2, "Open", 3, 4, "Open", 113, "Close", 5, "Open", 128, 128, "Close", 6, "Open", 9]
    df = spark.createDataFrame([(i, i, None if isinstance(v, str) else v, v if isinstance(v, str) else None) for i, v in enumerate(rows)], "ts bigint, seq bigint, num int, tag string")
    s = Stream(df)
    numbers, flags = s.filter(F.col("num").isNotNull()).map(num=F.col("num")), s.filter(F.col("tag").isNotNull()).map(open=F.col("tag") == "Open")
    assert [r.sum for r in numbers.window(flags).reduce(A.Sum("num")).orderBy("window_id").collect()] == [120, 256]


def test_window_keyed_and_shared(spark):
    s = alnum(spark)
    keyed_ = s.window((F.col("seq").between(0, 5)) | F.col("seq").between(10, 15)).reduce(VALUE)
    assert text(keyed_, "key", "window_id") == ["abc", "fgh", "012", "567"]
    shared = Stream(spark.createDataFrame([(0, 0, True), (6, 6, False), (10, 10, True), (16, 16, False), (20, 21, True), (21, 22, False)], "ts bigint, seq bigint, open boolean"))
    got = {(r.key, r.window_id): "".join(r.list) for r in s.window(shared).reduce(VALUE).collect()}
    steps = [(r.key, r.seq, "".join(r.list)) for r in s.window(shared).scan(VALUE).df.where("key = 'Alpha'").orderBy("seq").collect()]
    assert steps == [("Alpha", 0, "a"), ("Alpha", 2, "ab"), ("Alpha", 4, "abc"), ("Alpha", 10, "f"), ("Alpha", 12, "fg"), ("Alpha", 14, "fgh"), ("Alpha", 21, "")]
    late = Stream(s.df.where("seq >= 7"), s.order, s.keys)
    assert {(r.key, "".join(r.list)) for r in late.window(shared).reduce(VALUE).collect()} == {("Alpha", "fgh"), ("Digit", "567"), ("Alpha", ""), ("Digit", "")}
    assert got[("Alpha", 1)] == "abc" and got[("Digit", 2)] == "567" and got[("Digit", 3)] == ""


def test_toggle(spark):
    s = ints(spark, range(10))
    assert [r.n for r in s.window(toggled(s.filter(F.col("value").isin(2, 5, 7)))).reduce(A.Count()).collect()] == [3]


def test_bind_upper(spark):
    s = chars(spark)
    upper = s.every(2).map(upper=F.upper("value"))
    both = bind(s, upper).with_columns(parts=F.array_compact(F.array("upper", "value")))
    g = both.group(events(3))
    flat = lambda rows: ["".join("".join(p) for p in r) for r in rows]
    assert flat(emitted(g.scan(A.Collect("parts", "list")), "list")) == ["Aa", "Aab", "AabCc", "d", "dEe", "dEef", "Gg", "Ggh", "GghIi", "j", "jKk"]
    assert flat(r.list for r in g.reduce(A.Collect("parts", "list")).orderBy("bucket").collect()) == ["AabCc", "dEef", "GghIi", "jKk"]


def test_value_set_order(spark):
    s = from_values(spark, ["FOO", "BAR", "BAZ", "FOOBAR", "BAR"], "string", lambda v, i: i + 1)
    out = V.value_set(s, F.array(F.concat("value", F.lit(".1")), F.concat("value", F.lit(".2"))), "v")
    assert emitted(out, "v") == [f"{n}.{i}" for n in ("FOO", "BAR", "BAZ", "FOOBAR") for i in (1, 2)]


def abc(spark):
    rows = [(k, 10 * i + j + 1, 10 * i + j + 1, 10 * j + i) for j, k in enumerate("ABC") for i in range(6)]
    return Stream(spark.createDataFrame(rows, "key string, ts bigint, seq bigint, v int"), keys=("key",))


def test_keys(spark):
    s = abc(spark)
    lower = s.map_keys(unique=True, key=F.lower("key"))
    assert emitted(lower.apply("a"), "v") == list(range(6)) and emitted(lower.apply("A"), "v") == []
    assert emitted(s.subset(F.col("key") == "C").apply("C"), "v") == list(range(20, 26))
    assert emitted(V.key_count(s.subset(F.col("key") == "C")), "n_keys") == [1] * 6
    assert emitted(V.key_list(s), "key_list") == [["A"], ["A", "B"], ["A", "B", "C"]]
    assert emitted(s.to_stream(), "v") == [10 * j + i for i in range(6) for j in range(3)]
    assert {(r.key, r.v) for r in V.entries(s).collect()} == {("A", 5), ("B", 15), ("C", 25)}
    with pytest.raises(Exception, match="two keys become one"):
        s.map_keys(unique=True, key=F.lit("x")).df.collect()
    totals, latest = [], {}
    for r in s.df.orderBy("seq").collect():
        latest[r.key] = r.v
        totals.append(sum(latest.values()))
    assert emitted(V.map_vector_sum(s, v=F.col("v"))) == totals
    assert emitted(V.snapshot(s, "v", ["A", "C"]))[:3] == [(0, None), (0, None), (0, 20)]


def test_joins_single(spark):
    x = ints(spark, [1, 2, 3, 4]).map(x=F.col("value"))
    y = Stream(spark.createDataFrame([(1, 1, "p"), (2, 5, "q")], "ts bigint, seq bigint, y string"))
    assert emitted(take(x, y)) == [(1, None), (2, "p"), (3, "p"), (4, "q")]
    assert emitted(join(x, y)) == [(1, None), (2, "p"), (3, "p"), (3, "q"), (4, "q")]
    assert emitted(sample(x, y.filter(F.col("y") == "q"))) == [3]
    with pytest.raises(ValueError):
        join(x, x)


def test_feed_prices(spark):
    """Right rows before the left key's birth seed the state and aren't emitted."""
    x = Stream(spark.createDataFrame([("r1", 2, 2, 10.0), ("r1", 4, 4, 11.0), ("r2", 5, 5, 7.0)], "k string, ts bigint, seq bigint, x double"), keys=("k",))
    y = Stream(spark.createDataFrame([("c1", 1, 1, 9.0), ("c1", 3, 3, 9.5), ("c9", 3, 6, 0.0)], "k string, ts bigint, seq bigint, y double"), keys=("k",))
    to_y = lambda k: F.concat(F.lit("c"), F.substring(k, 2, 1))
    rows = lambda s: [(r.k, r.x, r.y) for r in s.df.orderBy("ts", "seq").collect()]
    assert rows(join(x, y, to_y)) == [("r1", 10.0, 9.0), ("r1", 10.0, 9.5), ("r1", 11.0, 9.5), ("r2", 7.0, None)]
    assert rows(take(x, y, to_y)) == [("r1", 10.0, 9.0), ("r1", 11.0, 9.5), ("r2", 7.0, None)]


def test_prefix_over_slices(spark):
    """Two-level prefixes equal one window."""
    df = spark.range(500).select(F.col("id").alias("ts"), F.col("id").alias("seq"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    wanted = {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "i": ("min", F.col("v"), True), "l": ("last", F.col("v"), False)}
    for keys in ([], ["k"]):
        one = prefix(df, keys, ["ts", "seq"], wanted)
        two = prefix(df, keys, ["ts", "seq"], wanted, F.floor(F.col("ts") / 50))
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_folds(spark):
    s = ints(spark, range(1, 8)).map(value=F.col("value").cast("double"), open=F.col("value").between(3, 5))
    run = lambda make: [r.out for r in scan_fold(s.df, [], s.order, make, "out", "double").orderBy("seq").collect()]
    state, want = 0.0, []
    for v in range(1, 8):
        state = v**0.02 + state**0.98
        want.append(state)
    assert run(lambda: EwmaRefFold()) == pytest.approx(want)
    assert s.reduce(A.EwmaRef("value")).first().ewma == pytest.approx(want[-1])
    assert run(lambda: SlicedFold(SumFold, 3)) == [1, 3, 6, 4, 9, 15, 7]
    assert [None if v is None or v != v else v for v in run(lambda: WindowFold(SumFold, "open"))] == [None, None, 3, 7, 12, None, None]


def test_empty_values(spark):
    s = ints(spark, [1]).filter(F.lit(False))
    r = s.reduce(A.Sum("value"), A.Avg("value"), A.Count(), VALUE).first()
    assert (r.sum, r.n, r.list) == (0.0, 0, []) and r.avg != r.avg


def test_duration_and_timer(spark):
    t = lambda m: dt.datetime(2020, 1, 1, 9, m)
    s = Stream(spark.createDataFrame([(t(1), 1, 5), (t(2), 2, 6), (t(8), 3, 7)], "ts timestamp_ntz, seq bigint, v int"))
    assert [(r.bucket, r.sum) for r in s.group(Every(120)).reduce(A.Sum("v")).orderBy("bucket").collect()] == [(0, 11), (1, 0), (2, 0), (3, 7)]
    assert [r.v for r in s.group(Every(120)).last("v").orderBy("bucket").collect()] == [6, 6, 6, 7]
    ticks = timer(spark, "2020-01-01 09:01:00", "2020-01-01 09:05:00", 120)
    assert [r.ts for r in ticks.df.orderBy("seq").collect()] == [t(1), t(3), t(5)]
    assert emitted(on_trigger(ticks, one=F.lit(1))) == [1, 1, 1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("ticker\ttime\tprice\nA\t20200101T140000\t1.5\n")
    row = read_ticks(spark, str(tmp_path / "t.tsv"), "ticker string, time string, price double", "time").first()
    assert (row.ticker, row.time, row.price) == ("A", dt.datetime(2020, 1, 1, 14), 1.5)
    assert emitted(as_vector(spark, ["x", "y", "x"]), "value") == ["x", "y"]
    assert random_walk(spark, ["a", "b"], 5).scan(A.Sum("value")).df.count() == 10
    assert [r.seq for r in with_arrival(spark.range(100).select((100 - F.col("id")).alias("o")), "o").orderBy("o").collect()] == list(range(100))
    merged = merge_sources(*[spark.createDataFrame([(1, 1, v)], "ts bigint, seq bigint, v string") for v in "ab"])
    assert [r.v for r in merged.orderBy("ts", "seq").collect()] == ["a", "b"]
    assert {(r.series, r.value) for r in series(abc(spark), "v").collect()} >= {("A", 0), ("C", 25)}


def test_variant(spark):
    df = spark.range(3).select(F.col("id").alias("ts"), F.col("id").alias("seq"), F.expr("CASE id WHEN 1 THEN parse_json('\"x\"') ELSE parse_json(cast(id AS string)) END AS v"))
    assert emitted(Stream(df).filter_variant("v", "BIGINT"), "value") == [0, 2]


def test_iterator_source(spark):
    from streamloom.sources.iterator import register

    register(spark)
    df = spark.read.format("event_iterator").schema("n int").option("module", "builtins").option("function", "range").option("partitions", 3).load()
    assert sorted(r.n for r in df.collect()) == [0, 1, 1, 2, 2, 2]


def test_running_folds(spark):
    """Modes and averages as running values, in a stream, per key and per slice; a NaN is a value, a null none."""
    nan = float("nan")
    rows = [("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 4, 5.0), ("a", 5, 2.0), ("a", 6, 2.0), ("b", 7, None), ("b", 8, nan)]
    s = Stream(spark.createDataFrame([(k, i, i, v) for k, i, v in rows], "key string, ts bigint, seq bigint, value double"), keys=("key",))
    whole = s.subset(F.col("key") == "a")
    assert emitted(whole.scan(A.Mode("value")), "mode") == [2.0, 1.0, 1.0, 1.0, 2.0]
    assert emitted(whole.group(events(2)).scan(A.Mode("value")), "mode") == [2.0, 1.0, 1.0, 1.0, 2.0]
    assert emitted(whole.scan(A.Ewma("value", 0.5)), "ewma") == [1.0, 1.0, 1.0, 1.5, 1.75]
    latest = scan_fold(s.df.where("key = 'b'"), ["key"], s.order, lambda: LatestFold("value"), "last", "double").orderBy("seq").collect()
    assert latest[0].last == latest[1].last == 5.0 and latest[2].last != latest[2].last


def test_bucket_folds(spark):
    class Log:
        def __init__(self):
            self.text = ""

        def add(self, tag, row):
            self.text += f"{tag}{row[tag]}"

        def close(self):
            self.text += "."

        def value(self):
            return self.text

    s = ints(spark, range(7))
    x, y = s.map(x=F.col("value")), s.every(3).map(y=F.col("value") * 10)
    got = bind(x, y).group(events(3)).collapse(Log, "log", "string", tags={"y": "y", "x": "x"})
    assert [r.log for r in got.orderBy("bucket").collect()] == ["y0x0x1x2.", "y30x3x4x5.", "y60x6."]
    six = bind(x, y).filter(F.col("x") < 6).group(events(3)).collapse(Log, "log", "string", tags={"x": "x"})
    assert [r.log for r in six.orderBy("bucket").collect()] == ["x0x1x2.", "x3x4x5.", "."]
    assert reduce_fold(s.df.where("false"), ["seq"], ["ts"], SumFold, "sum", "double").count() == 0


def test_empty_slices(spark):
    s = ints(spark, [1, 2, 3, 4]).map(value=F.col("value"))
    trigger = Stream(spark.createDataFrame([(0, 0), (1, 10), (1, 11), (3, 12), (9, 9)], "ts bigint, seq bigint"))
    assert emitted(s.group(trigger).scan(A.Sum("value")), "sum") == [1, 2, 0, 3, 7, 0]
    assert emitted(s.group(trigger).scan(A.Sum("value"), emit_empty=False), "sum") == [1, 2, 3, 7]
    assert emitted(s.group(trigger).all(), "value") == [1, 2, 2, 3, 4, 4]
    per_key = s.by(key=F.col("value") % 2).group(trigger).scan(A.Count())
    assert [(r.key, r.bucket, r.n) for r in per_key.df.orderBy("key", "bucket", "ts", "seq").collect()] == [
        (0, 1, 1), (0, 2, 0), (0, 3, 1), (0, 4, 0), (1, 0, 1), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 0)]
    t = lambda m: dt.datetime(2020, 1, 1, 9, m)
    timed = Stream(spark.createDataFrame([(t(1), 1, 5), (t(8), 3, 7)], "ts timestamp_ntz, seq bigint, v int"))
    assert [(r.ts, r.sum) for r in timed.group(Every(120)).scan(A.Sum("v")).df.orderBy("bucket").collect()] == [(t(1), 5), (t(5), 0), (t(7), 0), (t(8), 7)]


def test_windows_by_key(spark):
    s = alnum(spark)
    opened = Stream(spark.createDataFrame([("A", 0, 0, True), ("A", 4, 4, False), ("D", 3, 3, True), ("D", 7, 7, False)], "g string, ts bigint, seq bigint, open boolean"), keys=("g",))
    assert text(s.window(opened, key_map=lambda k: F.substring(k, 1, 1)).reduce(VALUE), "key") == ["ab", "12"]


def test_scan_has_no_window_over_all_rows(spark):
    """A stream without keys and slices gets slices, so every window over its rows has a partition."""
    s = ints(spark, range(1000)).map(value=F.col("value"))
    plan = trace(s.scan(A.Sum("value"), A.First("value"), A.SetOf("value", "set")))
    windows = [x for x in plan.split("\n") if "windowspecdefinition" in x and "value" in x]
    assert windows and all("__slice" in x for x in windows)
    marks = s.filter(F.col("value") % 100 == 0)
    plan = trace(sample(s.by(key=F.col("value") % 3), marks))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_grid(spark):
    assert timer(spark, "2020-01-01 00:00:00", "2021-01-01 00:00:00", 1).df.count() == 366 * 86_400 + 1
    s = Stream(spark.createDataFrame([(0, 1, 5), (86_400_000 * 30, 2, 7)], "ts bigint, seq bigint, v int"))
    r = s.group(Every(1)).reduce(A.Sum("v")).agg(F.count("*"), F.sum("sum")).first()
    assert tuple(r) == (86_400 * 30 + 1, 12)


def test_vector_of_all_keys(spark):
    s = abc(spark)
    got = V.map_vector(s, "v", lambda latest: sorted(latest.values())[-1] - sorted(latest.values())[0], "spread", "int")
    latest, want = {}, []
    for r in s.df.orderBy("seq").collect():
        latest[r.key] = r.v
        want.append(max(latest.values()) - min(latest.values()))
    assert emitted(got, "spread") == want
    made = lazy_vector(s, lambda k: [(i, i, k * i) for i in range(3)], "ts bigint, seq bigint, text string")
    assert sorted((r.key, r.text) for r in made.df.collect()) == sorted((k, k * i) for k in "ABC" for i in range(3))


def test_checked_and_printed(spark, capsys):
    s = abc(spark)
    assert s.checked().df.count() == 18
    with pytest.raises(Exception, match="two rows of one key"):
        Stream(s.df.withColumn("seq", F.lit(1)).withColumn("ts", F.lit(1)), s.order, s.keys).checked().df.collect()
    assert out("all of it", s, 2) is s
    printed = capsys.readouterr().out
    assert printed.startswith("all of it") and "only showing top 2 rows" in printed
    assert [(r.key, r.v) for r in table_view(s).collect()] == [("A", 5), ("B", 15), ("C", 25)]
    assert "Physical Plan" in trace(s)
