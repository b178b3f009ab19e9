"""Streaming twins over the same rows as their batch forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from streamloom.functions.folds import EwmaRefFold, SlicedFold, SumFold, WindowFold, scan_fold
from streamloom.streaming import keyed as K

SCHEMA = "user_id bigint, seq bigint, ts timestamp, value double, open boolean"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    df = spark.range(60).select(
        (F.col("id") % 3).alias("user_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 7 % 11).cast("double").alias("value"), (F.col("id") % 9 < 5).alias("open")
    )
    for part in range(3):  # three files, read one per micro-batch
        df.where(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, path, make, tmp, mode="append"):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out")


@pytest.mark.parametrize("make", [lambda: SumFold("value"), lambda: SlicedFold(lambda: SumFold("value"), 4), lambda: WindowFold(lambda: SumFold("value"), "open"), lambda: EwmaRefFold("value")])
def test_folds(spark, rows, tmp_path, make):
    pytest.importorskip("pandas")
    batch = scan_fold(spark.read.parquet(rows).select("user_id", "seq", "ts", "value", "open"), ["user_id"], ["ts", "seq"], make, "out", "double")
    got = streamed(spark, rows, lambda s: K.scan_fold(s, ["user_id"], ["ts", "seq"], make, "out", "double"), tmp_path)
    pick = lambda df: {r.seq: None if r.out is None or r.out != r.out else round(r.out, 9) for r in df.collect()}
    assert pick(got) == pick(batch)


def test_take(spark, rows, tmp_path):
    def make(s):
        left = s.where("seq % 2 = 0").select("user_id", "ts", "seq", F.col("value").alias("x"))
        right = s.where("seq % 2 = 1").select("user_id", "ts", "seq", "value")
        return K.take(left, right, ["user_id"], ["ts", "seq"], "value", "double")

    got = {r.seq: r.value for r in streamed(spark, rows, make, tmp_path).collect()}
    data = {r.seq: r for r in spark.read.parquet(rows).collect()}
    for seq, value in got.items():
        earlier = [s for s in data if s % 2 == 1 and s < seq and s % 3 == seq % 3]
        assert (value if value == value else None) == (data[max(earlier)].value if earlier else None)
    assert len(got) == 30


def test_windows_and_first_seen(spark, rows, tmp_path):
    got = streamed(spark, rows, lambda s: K.tumbling(s, "ts", "10 minutes", "1 minute", ["user_id"], F.sum("value").alias("sum")), tmp_path / "a")
    # windows that the watermark has passed are complete
    want = {}
    for i in range(60):
        want[i * 60 // 600, i % 3] = want.get((i * 60 // 600, i % 3), 0) + i * 7 % 11
    rows_ = {(int(r.window.start.timestamp()) // 600, r.user_id): r.sum for r in got.collect()}
    assert len(rows_) >= 12 and all(want[k] == v for k, v in rows_.items())
    firsts = streamed(spark, rows, lambda s: K.first_seen(s.select("ts", "value"), "ts", "10 days", ["value"]), tmp_path / "b")
    assert sorted(r.value for r in firsts.collect()) == [float(v) for v in range(11)]


def test_join_and_bind(spark, rows, tmp_path):
    """Both sides of a join, and inputs of one cycle."""
    from streamloom.core import Stream
    from streamloom.operators import joins as J
    from streamloom.operators.bind import bind

    left = lambda s: s.where("seq % 2 = 0").select("user_id", "ts", "seq", F.col("value").alias("x"))
    right = lambda s: s.where("seq % 3 <> 1").select("user_id", "ts", "seq", F.when(F.col("seq") % 4 > 0, F.col("value")).alias("y"))
    table = spark.read.parquet(rows)
    x, y = (Stream(f(table), ("ts", "seq"), ("user_id",)) for f in (left, right))
    pick = lambda df: sorted(((r.user_id, r.seq, r.x, r.y) for r in df.collect()), key=str)
    got = streamed(spark, rows, lambda s: K.join(left(s), right(s), ["user_id"], ["ts", "seq"]), tmp_path / "a")
    latest = pick(got)
    plain = []
    state: dict = {}
    data = {r.seq: r for r in table.collect()}
    for seq in sorted(data):
        r, mine = data[seq], state.setdefault(data[seq].user_id, [None, None])
        if seq % 2 == 0:
            mine[0] = r.value
        if seq % 3 != 1:
            mine[1] = r.value if seq % 4 > 0 else None
        if mine[0] is not None and (seq % 2 == 0 or seq % 3 != 1):
            plain.append((r.user_id, seq, *mine))
    assert latest == sorted(plain, key=str)
    assert len(pick(J.join(x, y).df)) == len(plain)
    got = streamed(spark, rows, lambda s: K.bind([left(s), right(s)], ["user_id"], ["ts", "seq"]), tmp_path / "b")
    assert pick(got) == pick(bind(x, y).df)


@pytest.mark.parametrize("align", ["after", "before"])
def test_slices_and_flush(spark, rows, tmp_path, align):
    """Slices that another stream ends, and an end marker that flushes the last one."""
    from streamloom.core import Stream
    from streamloom.functions import aggs as A

    make = lambda s: K.reduce_slices(
        s.select("user_id", "ts", "seq", "value"), s.where("value > 7"), ["user_id"], ["ts", "seq"], lambda: SumFold("value"), "sum", "double", align, end=F.lit(False)
    )
    table = Stream(spark.read.parquet(rows).select("user_id", "ts", "seq", "value"), ("ts", "seq"), ("user_id",))
    want = {(r.user_id, r.bucket): r.sum for r in table.group(table.filter(F.col("value") > 7), align).reduce(A.Sum("value")).collect()}
    got = {(r.user_id, r.bucket): r.sum for r in streamed(spark, rows, make, tmp_path / "a").collect()}
    last = {k: max(b for u, b in want if u == k) for k in range(3)}
    assert got == {k: v for k, v in want.items() if k[1] < last[k[0]]}

    def ended(s):
        """The last row of each key is followed by a marker, as a source that knows its end would send it."""
        marks = s.where("seq >= 57").withColumns({"seq": F.col("seq") + 1000, "value": F.lit(None).cast("double")})
        both = s.select("user_id", "ts", "seq", "value").unionByName(marks.select("user_id", "ts", "seq", "value"))
        return K.reduce_slices(both, s.where("value > 7"), ["user_id"], ["ts", "seq"], lambda: SumFold("value"), "sum", "double", align, end=F.col("seq") >= 1000)

    assert {(r.user_id, r.bucket): r.sum for r in streamed(spark, rows, ended, tmp_path / "b").collect()} == want
