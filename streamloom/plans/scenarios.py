"""End-to-end market questions over ``trades``, ``quotes``, ``simple_trades`` and the order tables.

Copies (rows equal in all but ``seq``) are dropped first; time order is ``(time, seq)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.bounds import one_of_copies
from streamloom.core import Stream, keyed
from streamloom.functions import aggs as A
from streamloom.operators.bind import bind
from streamloom.operators.buckets import Every, events
from streamloom.operators.joins import take
from streamloom.operators.windows import toggled
from streamloom.plans.expressions import rounded
from streamloom.sources.tables import table


def trades(spark: SparkSession, d: str) -> Stream:
    df = one_of_copies(table(spark, d, "trades"), "seq").where("price > 0 and not isnan(price) and quantity > 0")
    return keyed(df, ["ticker"], "time", "seq", "price", "quantity")


def quotes(spark: SparkSession, d: str) -> Stream:
    df = one_of_copies(table(spark, d, "quotes"), "seq").where("bid > 0 and ask > 0 and not isnan(bid) and not isnan(ask)")
    return keyed(df, ["ticker"], "time", "seq", "bid", "ask")


def accumulated_volume(spark, d):
    return trades(spark, d).scan(A.Sum("quantity", "volume")).df.select("ticker", "time", "seq", "volume")


def vwap_per_hundred(spark, d):
    out = trades(spark, d).group(events(100)).reduce(A.Sum("quantity", "volume"), A.Vwap("price", "quantity"))
    return rounded(out, "vwap")


def pairs_of_pairs(spark, d):
    """Buckets of two trades, then buckets of two such buckets."""
    pairs = trades(spark, d).group(events(2)).reduce(A.Sum("quantity", "volume"), emit_empty=False)
    again = Stream(pairs.withColumn("seq", F.col("bucket")).withColumnRenamed("bucket", "ts"), ("ts", "seq"), ("ticker",))
    return again.group(events(2)).reduce(A.Sum("volume"), emit_empty=False)


def volume_between_big_prints(spark, d):
    return trades(spark, d).group(F.col("quantity") > 5000).reduce(A.Sum("quantity", "volume"), A.Count())


def volume_in_toggled_window(spark, d):
    s = trades(spark, d)
    return s.window(toggled(s.filter(F.col("quantity") > 5000))).reduce(A.Sum("quantity", "volume"), A.Count())


def buy_sell_pressure(spark, d):
    """Trades at or beyond the latest quote's sides, counted as they come."""
    side = F.when(F.col("price") >= F.col("ask"), "buy").when(F.col("price") <= F.col("bid"), "sell")
    both = take(trades(spark, d), quotes(spark, d)).map(side=side, quantity=F.col("quantity")).filter(F.col("side").isNotNull())
    return both.nest(side=F.col("side")).scan(A.Count(), A.Sum("quantity", "volume")).df.select("ticker", "side", "time", "seq", "n", "volume")


def modal_spread(spark, d):
    """The most frequent spread of every hundred quotes, in hundredths of a percent of the bid."""
    spread = F.round((F.col("ask") - F.col("bid")) / F.col("bid") * 10_000).cast("bigint")
    out = quotes(spark, d).map(spread=spread).group(events(100)).reduce(A.Mode("spread"), A.Count(), emit_empty=False)
    return out


def minute_summary(spark, d):
    """Trades and quotes of one minute in one bucket, per ticker, for minutes with any."""
    both = bind(trades(spark, d), quotes(spark, d))
    grouped = both.group(Every(60))
    return grouped.reduce(
        A.Last("price", "price"), A.Last("bid", "bid"), A.Last("ask", "ask"), A.CountIf(F.col("price").isNotNull(), "n_trades"), A.CountIf(F.col("bid").isNotNull(), "n_quotes"), emit_empty=False
    )


def order_events(spark, d):
    """Openings, fills and ends of orders as one stream per order; events of one time come in that order."""
    parts = (
        table(spark, d, "new_orders").where("op = 'new'").select("orderId", "time", F.lit(0).alias("kind"), "seq", F.col("qty").alias("ordered")),
        one_of_copies(table(spark, d, "fills"), "seq").select("orderId", "time", F.lit(1).alias("kind"), "seq", F.col("qty").alias("filled"), "px"),
        one_of_copies(table(spark, d, "terminates"), "seq").select("orderId", "time", F.lit(2).alias("kind"), "seq", F.lit(True).alias("ended")),
    )
    union = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    union = union.withColumn("order_id", F.upper(F.trim("orderId"))).drop("orderId").where("order_id <> ''")
    return Stream(union, ("time", "kind", "seq"), ("order_id",))


def order_state(spark, d):
    """State per order after all its events: quantity ordered and filled, average price, whether ended."""
    out = order_events(spark, d).reduce(
        A.Max("ordered", "ordered"), A.Sum("filled", "filled"), A.Vwap("px", "filled", "avg_px"), A.CountIf(F.col("filled").isNotNull(), "n_fills"), A.AnyTrue(F.coalesce("ended", F.lit(False)), "ended")
    )
    return out.withColumn("avg_px", F.round("avg_px", 9))


def order_state_running(spark, d):
    """State per order after each of its events."""
    s = order_events(spark, d)
    out = s.scan(A.Max("ordered", "ordered_"), A.Sum("filled", "filled_"), A.CountIf(F.col("filled").isNotNull(), "n_fills"), A.AnyTrue(F.coalesce("ended", F.lit(False)), "ended_"))
    state = F.when(F.col("ended_"), "ended").when(F.col("ordered_").isNull(), "unknown").when(F.col("filled_") >= F.col("ordered_"), "filled").when(F.col("n_fills") > 0, "working").otherwise("new")
    return out.df.select("order_id", "time", "kind", "seq", F.col("filled_").alias("filled"), "n_fills", state.alias("state"))


def volume_while_open(spark, d):
    """Volume of simple trades in a stock while an order in it is open: the window of each order is cut out
    of the running volume of its stock by two as-of lookups, so no trade is copied per order."""
    stock = F.upper(F.trim("stock"))
    orders = table(spark, d, "new_orders").where("op = 'new' and stock is not null")
    orders = orders.groupBy(F.upper(F.trim("orderId")).alias("order_id")).agg(F.min("time").alias("a"), F.min_by(stock, F.struct("time", "seq")).alias("k"))
    ends = one_of_copies(table(spark, d, "terminates"), "seq").where("orderId is not null").groupBy(F.upper(F.trim("orderId")).alias("order_id")).agg(F.min("time").alias("z"))
    spans = orders.join(ends, "order_id").where("z > a")
    # in one time, trades come before marks, and marks are told apart by their order
    at = lambda late, seq, order_id, side: F.struct(F.lit(late).alias("late"), seq.alias("seq"), order_id.alias("order_id"), side.alias("side"))
    ticks = one_of_copies(table(spark, d, "simple_trades"), "seq").where("name is not null").select(
        F.upper(F.trim("name")).alias("k"), "time", at(False, F.col("seq"), F.lit(""), F.lit(0)).alias("seq"), F.coalesce("qty", F.lit(0.0)).alias("qty")
    )
    volume = keyed(ticks, ["k"], "time", "seq", "qty", slice=F.floor(F.col("time") / 3_600_000)).scan_sum("qty", "volume").map(volume=F.col("volume"))
    marks = spans.select("k", F.explode(F.array(F.struct(F.col("a").alias("time"), F.lit(0).alias("side")), F.struct(F.col("z").alias("time"), F.lit(1).alias("side")))).alias("m"), "order_id")
    marks = keyed(marks.select("k", "m.time", at(True, F.lit(0).cast("bigint"), F.col("order_id"), F.col("m.side")).alias("seq"), "order_id", "m.side"), ["k"], "time", "seq", "order_id", "side", slice=F.floor(F.col("time") / 3_600_000))
    out = take(marks, volume).df.groupBy("order_id").agg(F.sum(F.when(F.col("side") == 1, F.coalesce("volume", F.lit(0.0))).otherwise(-F.coalesce("volume", F.lit(0.0)))).alias("volume"))
    return rounded(out, "volume")


def feed_difference(spark, d):
    """Latest prices of two tables of one ticker side by side, at every trade."""
    x = trades(spark, d).map(price=F.col("price"))
    ticks = one_of_copies(table(spark, d, "quotes"), "seq").where("bid is not null")
    y = keyed(ticks, ["ticker"], "time", "seq", "bid")
    return rounded(take(x, y).with_columns(difference=F.col("price") - F.col("bid")).df, "difference").select("ticker", "time", "seq", "difference")


# stored NaNs are told by their text: statistics without NaN would let isnan() be folded away
_T = """WITH t AS (SELECT ticker, time, price, quantity, min(seq) AS seq FROM trades GROUP BY ticker, time, price, quantity, board, source, buyer, seller, initiator
HAVING price > 0 AND CAST(price AS VARCHAR) <> 'nan' AND quantity > 0) """
_Q = """, q0 AS (SELECT ticker, time, bid, bidDepth, ask, askDepth, min(seq) AS seq FROM quotes GROUP BY ALL), q AS (SELECT * FROM q0 WHERE bid > 0 AND ask > 0 AND CAST(bid AS VARCHAR) <> 'nan' AND CAST(ask AS VARCHAR) <> 'nan') """
_RUN = "(PARTITION BY ticker ORDER BY time, seq ROWS UNBOUNDED PRECEDING)"

SQL = {
    "accumulated_volume": _T + f"SELECT ticker, time, seq, CAST(sum(quantity) OVER {_RUN} AS DOUBLE) AS volume FROM t",
    "vwap_per_hundred": _T + """, b AS (SELECT *, (row_number() OVER (PARTITION BY ticker ORDER BY time, seq) - 1) // 100 AS bucket FROM t), s AS (SELECT ticker, unnest(generate_series(0, count(*) // 100)) AS bucket FROM t GROUP BY ticker)
SELECT ticker, bucket, CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS volume, round(sum(price * quantity) / sum(quantity), 6) AS vwap FROM s LEFT JOIN b USING (ticker, bucket) GROUP BY ALL""",
    "pairs_of_pairs": _T + """, b AS (SELECT *, (row_number() OVER (PARTITION BY ticker ORDER BY time, seq) - 1) // 4 AS bucket FROM t) SELECT ticker, bucket, CAST(sum(quantity) AS DOUBLE) AS sum FROM b GROUP BY ALL""",
    "volume_between_big_prints": _T + """, b AS (SELECT *, CAST(coalesce(sum(CASE WHEN quantity > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bucket FROM t),
s AS (SELECT ticker, unnest(generate_series(0, count(*) FILTER (quantity > 5000))) AS bucket FROM t GROUP BY ticker)
SELECT ticker, bucket, CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS volume, count(quantity) AS n FROM s LEFT JOIN b USING (ticker, bucket) GROUP BY ALL""",
    "volume_in_toggled_window": _T + f""", b AS (SELECT *, CAST(sum(CASE WHEN quantity > 5000 THEN 1 ELSE 0 END) OVER {_RUN} AS BIGINT) AS k FROM t), c AS (SELECT ticker, count(*) AS n FROM t WHERE quantity > 5000 GROUP BY ticker)
SELECT ticker, (k + 1) // 2 AS window_id, CAST(sum(quantity) AS DOUBLE) AS volume, count(*) AS n FROM b JOIN c USING (ticker) WHERE k % 2 = 1 AND k < c.n GROUP BY ALL""",
    "buy_sell_pressure": _T + _Q + """, j AS (SELECT t.ticker, t.time, t.seq, t.quantity, CASE WHEN t.price >= q.ask THEN 'buy' WHEN t.price <= q.bid THEN 'sell' END AS side FROM t ASOF LEFT JOIN (SELECT ticker, time, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM q GROUP BY ALL) q ON t.ticker = q.ticker AND t.time >= q.time)
SELECT ticker, side, time, seq, count(*) OVER w AS n, CAST(sum(quantity) OVER w AS DOUBLE) AS volume FROM j WHERE side IS NOT NULL WINDOW w AS (PARTITION BY ticker, side ORDER BY time, seq ROWS UNBOUNDED PRECEDING)""",
    "modal_spread": _T + _Q + """, b AS (SELECT ticker, (row_number() OVER (PARTITION BY ticker ORDER BY time, seq) - 1) // 100 AS bucket, CAST(round((ask - bid) / bid * 10000) AS BIGINT) AS s FROM q), c AS (SELECT ticker, bucket, s, count(*) AS k FROM b GROUP BY ALL)
SELECT ticker, bucket, s AS mode, total AS n FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY ticker, bucket) AS BIGINT) AS total, row_number() OVER (PARTITION BY ticker, bucket ORDER BY k DESC, s) AS rn FROM c) WHERE rn = 1""",
    "minute_summary": _T + _Q + """, u AS (SELECT ticker, time, seq, price, NULL AS bid, NULL AS ask FROM t UNION ALL SELECT ticker, time, seq, NULL, bid, ask FROM q), m AS (SELECT min(epoch_us(time)) AS a FROM u),
b AS (SELECT *, (epoch_us(time) - a) // 60000000 AS bucket FROM u, m)
SELECT ticker, bucket, arg_max(price, (time, seq)) FILTER (price IS NOT NULL) AS price, arg_max(bid, (time, seq)) FILTER (bid IS NOT NULL) AS bid, arg_max(ask, (time, seq)) FILTER (ask IS NOT NULL) AS ask, count(price) AS n_trades, count(bid) AS n_quotes FROM b GROUP BY ALL""",
    "order_state": """WITH f AS (SELECT min(seq) AS seq, time, orderId, px, qty FROM fills GROUP BY time, orderId, px, qty), e AS (SELECT DISTINCT time, orderId FROM terminates),
u AS (SELECT upper(trim(orderId)) AS order_id, qty AS ordered, NULL AS filled, NULL AS px, FALSE AS ended FROM new_orders WHERE op = 'new' UNION ALL SELECT upper(trim(orderId)), NULL, qty, px, FALSE FROM f UNION ALL SELECT upper(trim(orderId)), NULL, NULL, NULL, TRUE FROM e)
SELECT order_id, max(ordered) AS ordered, CAST(coalesce(sum(filled), 0) AS DOUBLE) AS filled, round(sum(px * filled) / sum(filled) FILTER (px IS NOT NULL), 9) AS avg_px, count(filled) AS n_fills, bool_or(ended) AS ended FROM u WHERE order_id <> '' GROUP BY order_id""",
    "order_state_running": """WITH f AS (SELECT min(seq) AS seq, time, orderId, qty FROM fills GROUP BY time, orderId, px, qty), e AS (SELECT min(seq) AS seq, time, orderId FROM terminates GROUP BY time, orderId),
u AS (SELECT upper(trim(orderId)) AS order_id, time, 0 AS kind, seq, qty AS o, NULL AS q, FALSE AS z FROM new_orders WHERE op = 'new' UNION ALL SELECT upper(trim(orderId)), time, 1, seq, NULL, qty, FALSE FROM f UNION ALL SELECT upper(trim(orderId)), time, 2, seq, NULL, NULL, TRUE FROM e),
r AS (SELECT order_id, time, kind, seq, max(o) OVER w AS o, CAST(coalesce(sum(q) OVER w, 0) AS DOUBLE) AS filled, count(q) OVER w AS n_fills, bool_or(z) OVER w AS z FROM u WHERE order_id <> '' WINDOW w AS (PARTITION BY order_id ORDER BY time, kind, seq ROWS UNBOUNDED PRECEDING))
SELECT order_id, time, kind, seq, filled, n_fills, CASE WHEN z THEN 'ended' WHEN o IS NULL THEN 'unknown' WHEN filled >= o THEN 'filled' WHEN n_fills > 0 THEN 'working' ELSE 'new' END AS state FROM r""",
    "volume_while_open": """WITH o AS (SELECT upper(trim(orderId)) AS order_id, min(time) AS a, arg_min(upper(trim(stock)), (time, seq)) AS k FROM new_orders WHERE op = 'new' AND stock IS NOT NULL GROUP BY 1),
e AS (SELECT upper(trim(orderId)) AS order_id, min(time) AS z FROM terminates WHERE orderId IS NOT NULL GROUP BY 1), s AS (SELECT * FROM o JOIN e USING (order_id) WHERE z > a),
t AS (SELECT upper(trim(name)) AS k, time, qty, min(seq) AS seq FROM simple_trades WHERE name IS NOT NULL GROUP BY name, time, price, qty),
r AS (SELECT k, time, max(v) AS v FROM (SELECT k, time, sum(coalesce(qty, 0)) OVER (PARTITION BY k ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS v FROM t) GROUP BY ALL)
SELECT s.order_id, round(coalesce(y.v, 0) - coalesce(x.v, 0), 6) AS volume FROM s ASOF LEFT JOIN r x ON s.k = x.k AND s.a >= x.time ASOF LEFT JOIN r y ON s.k = y.k AND s.z >= y.time""",
    "feed_difference": _T + """, q AS (SELECT ticker, time, arg_max(bid, seq) AS bid FROM (SELECT ticker, time, bid, min(seq) AS seq FROM quotes GROUP BY ticker, time, bid, bidDepth, ask, askDepth) WHERE bid IS NOT NULL GROUP BY ALL)
SELECT t.ticker, t.time, t.seq, round(t.price - q.bid, 6) AS difference FROM t ASOF LEFT JOIN q ON t.ticker = q.ticker AND t.time >= q.time""",
}
QUERIES = {
    f.__name__: f
    for f in (
        accumulated_volume, vwap_per_hundred, pairs_of_pairs, volume_between_big_prints, volume_in_toggled_window, buy_sell_pressure, modal_spread,
        minute_summary, order_state, order_state_running, volume_while_open, feed_difference,
    )
}
