"""Queries of the general training-data operators: spikes (2), hot keys (4), orphans (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators.orphans import clean_key, life_spans, orphan_report, orphan_rows, period_of
from streamloom.operators.skew import aggregate_by_key, heavy_keys, join_by_key, running_by_key
from streamloom.operators.spikes import flag_readings
from streamloom.sources.tables import table


def flagged(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "instruments").select(F.col("ticker").alias("src"), "tick")
    common = {"source": "ticker", "time": "time", "seq": "seq", "ticks": ticks}
    quotes = flag_readings(table(spark, d, "quotes"), table="quotes", levels=["bid", "ask"], **common)
    trades = flag_readings(table(spark, d, "trades"), table="trades", levels=["price"], sizes=["quantity"], **common)
    return quotes.unionByName(trades)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("tbl", "seq", "field")


def p2_by_source(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("tbl", "source", "field", "reason").agg(F.count(F.lit(1)).alias("n"))


KEYED = (("new_orders", "stock"), ("simple_trades", "name"))


def keyed(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """Rows under their key in upper case without outer spaces; blank is null."""
    return table(spark, d, name).withColumn("hot_key", clean_key(F.col(key)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    new_orders, trades = (heavy_keys(keyed(spark, d, t, k), "hot_key").select(F.lit(t).alias("tbl"), "hot_key") for t, k in KEYED)
    return new_orders.unionByName(trades)


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and volume of every key."""
    new_orders, trades = (
        aggregate_by_key(keyed(spark, d, t, k), "hot_key", {"volume": F.col("qty").cast("decimal(38,4)")}).select(F.lit(t).alias("tbl"), "hot_key", "n_rows", F.col("volume").cast("double").alias("volume"))
        for t, k in KEYED
    )
    return new_orders.unionByName(trades)


def p4_running(spark: SparkSession, d: str) -> DataFrame:
    """Rows and volume so far, in time order, at every row with a key."""
    new_orders, trades = (
        running_by_key(keyed(spark, d, t, k), "hot_key", ["time", "seq"], F.col("qty").cast("decimal(28,4)"), F.floor(F.col("time") / 3_600_000)).select(
            F.lit(t).alias("tbl"), "hot_key", "seq", "running_n", F.col("running_sum").cast("double").alias("running_volume")
        )
        for t, k in KEYED
    )
    return new_orders.unionByName(trades)


def p4_board_volume(spark: SparkSession, d: str) -> DataFrame:
    """Trades with the board of their instrument, as volume per board and UTC date."""
    boards = table(spark, d, "instruments").select(clean_key(F.col("ticker")).alias("hot_key"), "board")
    rows = keyed(spark, d, "simple_trades", "name").select("hot_key", "time", "qty")
    joined = join_by_key(rows, boards, "hot_key", ["board"])
    return joined.groupBy("board", period_of(F.col("time")).alias("period")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("qty").cast("decimal(38,4)")), F.lit(0)).cast("double").alias("volume"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    spans = life_spans(table(spark, d, "new_orders"), "orderId", "time", F.col("op") == "new", F.col("op") == "del")
    fills, ends = (orphan_rows(table(spark, d, t), spans, "orderId", "time", "seq", t) for t in ("fills", "terminates"))
    return fills.unionByName(ends)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).select("tbl", period_of(F.col("time")).alias("period"), "seq")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_source, p4_found, p4_totals, p4_running, p4_board_volume, p5_found, p5_report)}

_KEYED_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, nullif(upper(trim({k})), '') AS hot_key, seq, time, coalesce(CAST(qty AS DECIMAL(28,4)), 0) AS v, qty FROM {t}" for t, k in KEYED
)
_ORPHANS = """WITH spans AS (
  SELECT upper(trim(orderId)) AS k, min(CASE WHEN op = 'new' THEN time END) AS born, min(CASE WHEN op = 'del' THEN time END) AS gone
  FROM new_orders WHERE orderId IS NOT NULL GROUP BY 1),
refs AS (
  SELECT 'fills' AS tbl, min(seq) AS seq, time, upper(trim(orderId)) AS k FROM fills GROUP BY time, orderId, px, qty
  UNION ALL SELECT 'terminates', min(seq), time, upper(trim(orderId)) FROM terminates GROUP BY time, orderId),
orphans AS (
  SELECT tbl, strftime(epoch_ms(time), '%Y-%m-%d') AS period, seq, refs.k FROM refs LEFT JOIN spans USING (k)
  WHERE k IS NOT NULL AND k <> '' AND (born IS NULL OR born > time OR coalesce(gone <= time, FALSE))) """

_NAN = "(CAST(v AS VARCHAR) = 'nan')"
_OF = "PARTITION BY tbl, field, ticker, day ORDER BY time, seq"


def _off(side: str) -> str:
    """Whether a reading stands off the median of a list by more than three scaled deviations, or what is taken for them."""
    return f"(len({side}) > 0 AND abs(v - list_median({side})) > least(greatest(3 * CAST(1.4826 AS DOUBLE) * list_median(list_transform({side}, lambda x: abs(x - list_median({side})))), 3 * u), 6 * u))"


_FLAGS = f"""WITH RECURSIVE t AS (SELECT min(seq) AS seq, ticker, time, price, quantity FROM trades GROUP BY ticker, time, price, quantity, board, source, buyer, seller, initiator),
q AS (SELECT min(seq) AS seq, ticker, time, bid, ask FROM quotes GROUP BY ticker, time, bid, bidDepth, ask, askDepth),
r AS (SELECT *, CAST(time AS DATE) AS day FROM (SELECT 'trades' AS tbl, 'price' AS field, seq, ticker, time, price AS v FROM t UNION ALL SELECT 'trades', 'quantity', seq, ticker, time, CAST(quantity AS DOUBLE) FROM t
  UNION ALL SELECT 'quotes', 'bid', seq, ticker, time, bid FROM q UNION ALL SELECT 'quotes', 'ask', seq, ticker, time, ask FROM q) WHERE v IS NOT NULL AND ticker IS NOT NULL AND time IS NOT NULL),
runs AS (SELECT *, sum(new) OVER ({_OF} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN {_NAN} OR v IS DISTINCT FROM lag(v) OVER ({_OF}) THEN 1 ELSE 0 END AS new FROM r)),
f AS (SELECT *, v > 0 AND NOT {_NAN} AS possible, count(*) OVER (PARTITION BY tbl, field, ticker, day, run) >= 25 AS frozen FROM runs),
c AS (SELECT tbl, field, ticker, v, coalesce(tick, 0) AS tick, abs(v - lag(v) OVER ({_OF})) AS x FROM f LEFT JOIN (SELECT ticker AS name, tick FROM instruments) ON f.ticker = name WHERE possible),
usual AS (SELECT tbl, field, ticker, CASE WHEN field = 'quantity' THEN median(v) ELSE median(CASE WHEN tick > 0 THEN round(x / tick, 3) ELSE x END) FILTER (x > 0 AND x >= tick * (1 - 1e-6)) * CASE WHEN any_value(tick) > 0 THEN any_value(tick) ELSE 1 END END AS u FROM c GROUP BY tbl, field, ticker),
e0 AS (SELECT f.*, u, row_number() OVER ({_OF}) AS rn, list(v) OVER ({_OF} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b, list(v) OVER ({_OF} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS a
  FROM f JOIN usual USING (tbl, field, ticker) WHERE possible AND NOT frozen AND u > 0 AND field <> 'quantity'),
e1 AS (SELECT tbl, field, ticker, day, time, seq, rn, v, 12 * u AS far, {_off("b")} AND {_off("a")} AS cand FROM e0),
e AS (SELECT *, lead(v, 1) OVER w AS x1, lead(v, 2) OVER w AS x2, lead(v, 3) OVER w AS x3, lead(cand, 1) OVER w AS c1, lead(cand, 2) OVER w AS c2 FROM e1 WINDOW w AS ({_OF})),
s AS (SELECT tbl, field, ticker, day, rn AS at, CAST(0 AS BIGINT) AS k, rn + 1 AS nxt, v AS sound FROM e WHERE rn = 1
  UNION ALL SELECT tbl, field, ticker, day, rn, k, rn + greatest(k, 1), CASE WHEN k > 0 THEN sound ELSE v END FROM (
    SELECT e.tbl, e.field, e.ticker, e.day, e.rn, v, sound, CAST(CASE WHEN NOT cand OR abs(v - sound) <= far THEN 0 WHEN (v - x1) * sign(v - sound) > far THEN 1
      WHEN c1 AND (x1 - sound) * sign(v - sound) > far AND (v - x2) * sign(v - sound) > far AND (x1 - x2) * sign(v - sound) > far THEN 2
      WHEN c1 AND c2 AND (x1 - sound) * sign(v - sound) > far AND (x2 - sound) * sign(v - sound) > far AND (v - x3) * sign(v - sound) > far AND (x1 - x3) * sign(v - sound) > far AND (x2 - x3) * sign(v - sound) > far THEN 3 ELSE 0 END AS BIGINT) AS k
    FROM s JOIN e ON e.tbl = s.tbl AND e.field = s.field AND e.ticker = s.ticker AND e.day = s.day AND e.rn = s.nxt)),
flags AS (SELECT tbl, seq, field, ticker, 'impossible' AS reason FROM f WHERE NOT possible UNION ALL SELECT tbl, seq, field, ticker, 'frozen' FROM f WHERE possible AND frozen
  UNION ALL SELECT e.tbl, e.seq, e.field, e.ticker, 'spike' FROM e JOIN s ON e.tbl = s.tbl AND e.field = s.field AND e.ticker = s.ticker AND e.day = s.day AND k > 0 AND e.rn BETWEEN s.at AND s.at + k - 1
  UNION ALL SELECT f.tbl, f.seq, f.field, f.ticker, 'spike' FROM f JOIN usual USING (tbl, field, ticker) WHERE possible AND NOT frozen AND field = 'quantity' AND u > 0 AND v > 25 * u) """

SQL = {
    "p2_found": _FLAGS + "SELECT tbl, seq, field FROM flags",
    "p2_by_source": _FLAGS + "SELECT tbl, ticker AS source, field, reason, count(*) AS n FROM flags GROUP BY ALL",
    "p4_found": f"""WITH r AS ({_KEYED_ROWS}), c AS (SELECT tbl, hot_key, count(*) AS n FROM r WHERE hot_key IS NOT NULL GROUP BY ALL)
SELECT tbl, hot_key FROM (SELECT *, sum(n) OVER (PARTITION BY tbl) AS total FROM c) WHERE n > 0.04 * total""",
    "p4_totals": f"""WITH r AS ({_KEYED_ROWS})
SELECT tbl, hot_key, count(*) AS n_rows, CAST(sum(CAST(qty AS DECIMAL(28,4))) AS DOUBLE) AS volume FROM r WHERE hot_key IS NOT NULL GROUP BY ALL""",
    "p4_running": f"""WITH r AS ({_KEYED_ROWS})
SELECT tbl, hot_key, seq, count(*) OVER w AS running_n, CAST(sum(v) OVER w AS DOUBLE) AS running_volume FROM r WHERE hot_key IS NOT NULL
WINDOW w AS (PARTITION BY tbl, hot_key ORDER BY time, seq ROWS UNBOUNDED PRECEDING)""",
    "p4_board_volume": """SELECT board, strftime(epoch_ms(t.time), '%Y-%m-%d') AS period, count(*) AS n_rows, CAST(coalesce(sum(CAST(qty AS DECIMAL(28,4))), 0) AS DOUBLE) AS volume
FROM simple_trades t LEFT JOIN instruments i ON upper(trim(t.name)) = upper(trim(i.ticker)) GROUP BY ALL""",
    "p5_found": _ORPHANS + "SELECT tbl, period, seq FROM orphans",
    "p5_report": _ORPHANS + "SELECT tbl, period, count(*) AS n_orphans, count(DISTINCT k) AS n_keys FROM orphans GROUP BY ALL",
}
