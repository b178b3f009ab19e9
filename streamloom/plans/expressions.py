"""A query per operator of the expression language, over ``events``, ``orders`` and ``lineitem``.

``events`` is the natural stream: time ``ts``, total order ``(ts, event_id)``, keys ``user_id`` or
``event_type``. Its slices are the hours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.core import Stream, keyed, stream
from streamloom.functions import aggs as A
from streamloom.functions.folds import EwmaRefFold, scan_fold
from streamloom.operators import vector as V
from streamloom.operators.bind import bind
from streamloom.operators.buckets import Every, events
from streamloom.operators.joins import join, sample, take
from streamloom.operators.windows import toggled
from streamloom.order import merge_sources
from streamloom.sinks import series
from streamloom.sources.basic import as_vector, lazy_vector, timer
from streamloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def all_events(spark: SparkSession, d: str) -> Stream:
    return stream(table(spark, d, "events"), "ts", "event_id", "user_id", "event_type", "value", slice=F.date_trunc("hour", "ts"))


def by_user(spark: SparkSession, d: str) -> Stream:
    return keyed(table(spark, d, "events"), ["user_id"], "ts", "event_id", "event_type", "value")


def of_type(spark: SparkSession, d: str, kind: str, **columns) -> Stream:
    return all_events(spark, d).filter_type("event_type", kind).map(**columns)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


W_ALL = "(ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
W_USER = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


# --- projections, filters, keys -----------------------------------------------------------------------
@query("SELECT ts, event_id, value * 2 + 1 AS doubled, upper(event_type) AS kind FROM events")
def map_value(spark, d):
    return all_events(spark, d).map(doubled=F.col("value") * 2 + 1, kind=F.upper("event_type")).df


@query("SELECT ts, event_id, CASE WHEN value > 50 THEN value END AS big FROM events WHERE value > 50")
def map_hide_null(spark, d):
    return all_events(spark, d).map(expose_null=False, big=F.when(F.col("value") > 50, F.col("value"))).df


@query("SELECT ts, event_id, user_id, event_type, value FROM events WHERE value > 50 AND event_type LIKE '%e%'")
def filter_value(spark, d):
    return all_events(spark, d).filter((F.col("value") > 50) & F.col("event_type").contains("e")).df


@query("SELECT ts, event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'")
def filter_type(spark, d):
    return all_events(spark, d).filter_type("event_type", "purchase").df


@query("SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 2 = 1")
def filter_every_other(spark, d):
    return by_user(spark, d).every(2).df


@query("SELECT user_id % 10 AS key, ts, event_id, event_type, value FROM events WHERE user_id % 10 <> 3")
def map_keys(spark, d):
    return by_user(spark, d).map_keys(key=F.when(F.col("user_id") % 10 != 3, F.col("user_id") % 10)).df


@query("SELECT user_id, ts, event_id, event_type, value FROM events WHERE user_id BETWEEN 10 AND 19")
def subset(spark, d):
    return by_user(spark, d).subset(F.col("user_id").between(10, 19)).df


@query("SELECT ts, event_id, event_type, value FROM events WHERE user_id = 7")
def apply_key(spark, d):
    return by_user(spark, d).apply(7).df


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY user_id")
def entries(spark, d):
    return V.entries(by_user(spark, d)).select("user_id", "value", "event_type")


@query("SELECT event_type, ts, event_id, event_type AS event_type_value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def to_key_set(spark, d):
    return V.key_set(all_events(spark, d).by(event_type=F.col("event_type"))).df


@query("""WITH f AS (SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1)
SELECT ts, event_id, array_to_string(list(event_type) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), ',') AS key_list FROM f""")
def key_list(spark, d):
    out = V.key_list(all_events(spark, d).by(event_type=F.col("event_type"))).df
    return out.withColumn("key_list", F.array_join("key_list", ","))


@query("""WITH x AS (SELECT ts, event_id, 0 AS pos, event_type AS value FROM events UNION ALL SELECT ts, event_id, 1, event_type || '.' || CAST(user_id % 3 AS VARCHAR) FROM events)
SELECT ts, event_id, CAST(pos AS INTEGER) AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY ts, event_id, pos) AS rn FROM x) WHERE rn = 1""")
def value_set(spark, d):
    elements = F.array("event_type", F.concat_ws(".", "event_type", (F.col("user_id") % 3).cast("string")))
    return V.value_set(all_events(spark, d), elements).df


@query("""SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def key_to_stream(spark, d):
    orders = keyed(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), ["o_orderkey"], "o_orderdate", "o_custkey")
    lines = keyed(table(spark, d, "lineitem"), ["l_orderkey"], "l_shipdate", "l_linenumber", "l_quantity")
    return V.key_to_stream(orders, lines).df


@query("SELECT user_id, ts, event_id, event_type, value FROM events WHERE user_id IN (SELECT CAST(round(value) AS BIGINT) FROM events WHERE event_type = 'purchase')")
def take_by_value(spark, d):
    values = of_type(spark, d, "purchase", v=F.round("value").cast("bigint"))
    return V.take_by_value(values, "v", by_user(spark, d)).df


@query(f"""WITH d AS (SELECT ts, event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS x FROM events)
SELECT ts, event_id, round(sum(x) OVER {W_ALL}, 6) AS total FROM d""")
def map_vector_sum(spark, d):
    s = all_events(spark, d).by(user_id=F.col("user_id"))
    return rounded(V.map_vector_sum(s, value=F.col("value")).df, "total")


@query(f"""SELECT ts, event_id, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER {W_ALL} AS BIGINT) AS n_keys
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""")
def map_vector_size(spark, d):
    return V.key_count(all_events(spark, d).by(user_id=F.col("user_id"))).df


@query(f"""SELECT ts, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER {W_ALL} AS click,
last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER {W_ALL} AS purchase FROM events""")
def map_vector_snapshot(spark, d):
    return V.snapshot(all_events(spark, d).by(event_type=F.col("event_type")), "value", ["click", "purchase"]).df


@query("SELECT user_id % 10 AS outer_key, user_id, count(*) AS n, round(sum(value), 6) AS sum FROM events GROUP BY ALL")
def nested_groupby(spark, d):
    return rounded(by_user(spark, d).nest(outer_key=F.col("user_id") % 10).reduce(A.Count("n"), A.Sum("value", "sum")), "sum")


@query("SELECT ts, event_id, user_id, count(*) OVER (ORDER BY ts, event_id, user_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def to_stream(spark, d):
    merged = by_user(spark, d).to_stream()
    out = merged.with_df(merged.df.select(*merged.order, "value"))
    numbered = Stream(out.df, out.order, (), F.date_trunc("hour", "ts")).prefix(n=("sum", F.lit(1), True))
    return numbered.df.select("ts", "event_id", "user_id", F.col("n").cast("bigint").alias("n"))


# --- folds ----------------------------------------------------------------------------------------------
@query(f"SELECT ts, event_id, round(sum(value) OVER {W_ALL}, 6) AS sum FROM events")
def scan_sum(spark, d):
    return rounded(all_events(spark, d).map(value=F.col("value")).scan_sum("value").df, "sum").select("ts", "event_id", "sum")


@query(f"SELECT user_id, ts, event_id, round(sum(value) OVER {W_USER}, 6) AS sum, count(*) OVER {W_USER} AS n, round(avg(value) OVER {W_USER}, 10) AS avg FROM events")
def by_scan_sum(spark, d):
    out = by_user(spark, d).scan(A.Sum("value"), A.Count(), A.Avg("value")).df
    return rounded(out, "sum").withColumn("avg", F.round("avg", 10)).select("user_id", "ts", "event_id", "sum", "n", "avg")


@query(f"SELECT user_id, ts, event_id, array_to_string(list_sort(list_distinct(list(event_type) OVER {W_USER})), ',') AS seen FROM events")
def scan_collect_set(spark, d):
    out = by_user(spark, d).scan(A.SetOf("event_type", "seen")).df
    return out.select("user_id", "ts", "event_id", F.array_join("seen", ",").alias("seen"))


@query("SELECT round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events")
def reduce_all(spark, d):
    return rounded(all_events(spark, d).reduce(A.Sum("value"), A.Avg("value"), A.Count(), A.Min("value", "lo"), A.Max("value", "hi")), "sum", "avg")


@query("SELECT CAST(0.0 AS DOUBLE) AS sum, CAST(0 AS BIGINT) AS n")
def reduce_empty(spark, d):
    return all_events(spark, d).filter(F.lit(False)).reduce(A.Sum("value"), A.Count())


@query("""SELECT user_id, count(*) AS n, round(sum(value), 6) AS sum, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last,
array_to_string(list(event_type ORDER BY ts, event_id), ',') AS list, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS set FROM events GROUP BY user_id""")
def keyed_reduce(spark, d):
    out = by_user(spark, d).reduce(A.Count(), A.Sum("value"), A.First("value"), A.Last("value"), A.Collect("event_type"), A.SetOf("event_type"))
    return rounded(out, "sum").withColumns({"list": F.array_join("list", ","), "set": F.array_join("set", ",")})


_FOLD = "list_reduce(list_prepend(CAST(0.0 AS DOUBLE), {values}), lambda s, x: {step})"
_POWERS = "pow(x, CAST(1 - 0.98 AS DOUBLE)) + pow(s, CAST(0.98 AS DOUBLE))"


@query(f"SELECT user_id, ts, event_id, value, round({_FOLD.format(values=f'list(value) OVER {W_USER}', step=_POWERS)}, 9) AS ewma FROM events")
def ewma_ref(spark, d):
    s = by_user(spark, d)
    out = scan_fold(s.df.select("user_id", "ts", "event_id", "value"), s.keys, s.order, lambda: EwmaRefFold("value"), "ewma", "double")
    return out.withColumn("ewma", F.round("ewma", 9))


@query(f"SELECT user_id, round({_FOLD.format(values='list(value ORDER BY ts, event_id)', step=_POWERS)}, 9) AS ewma, count(*) AS n FROM events GROUP BY user_id")
def ewma_ref_reduce(spark, d):
    return by_user(spark, d).reduce(A.EwmaRef("value", name="ewma"), A.Count()).withColumn("ewma", F.round("ewma", 9))


@query("""WITH c AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS b, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, b AS mode FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, b) AS rn FROM c) WHERE rn = 1""")
def mode_per_key(spark, d):
    return all_events(spark, d).by(event_type=F.col("event_type")).with_columns(b=F.floor(F.col("value") / 10)).reduce(A.Mode("b"))


# --- slices -----------------------------------------------------------------------------------------------
_N = """WITH b AS (SELECT *, {bucket} AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),
spine AS (SELECT user_id, unnest(generate_series({first}, count(*) // 3)) AS bucket FROM events GROUP BY user_id) """


@query(_N.format(bucket="(rn - 1) // 3", first="0") + "SELECT user_id, bucket, coalesce(round(sum(value), 6), 0) AS sum, count(value) AS n FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL")
def group_n_reduce(spark, d):
    out = by_user(spark, d).group(events(3)).reduce(A.Sum("value"), A.CountIf(F.col("value").isNotNull()))
    return rounded(out, "sum")


@query(_N.format(bucket="rn // 3", first="0") + "SELECT user_id, bucket, coalesce(round(sum(value), 6), 0) AS sum FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL")
def group_n_before_reduce(spark, d):
    return rounded(by_user(spark, d).group(events(3), "before").reduce(A.Sum("value")), "sum")


@query(_N.format(bucket="(rn - 1) // 3", first="0") + "SELECT user_id, ts, event_id, bucket, round(sum(value) OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS sum FROM b")
def group_n_scan(spark, d):
    out = by_user(spark, d).group(events(3)).scan(A.Sum("value")).df
    return rounded(out, "sum").select("user_id", "ts", "event_id", "bucket", "sum")


@query("""WITH b AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS bucket FROM events), spine AS (SELECT unnest(generate_series(0, count(*) // 100)) AS bucket FROM events)
SELECT bucket, coalesce(round(sum(value), 6), 0) AS sum, count(value) AS n FROM spine LEFT JOIN b USING (bucket) GROUP BY ALL""")
def group_n_single(spark, d):
    return rounded(all_events(spark, d).group(events(100)).reduce(A.Sum("value"), A.CountIf(F.col("value").isNotNull())), "sum")


_TRIG = """WITH b AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER ({by} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), 0) AS BIGINT) AS bucket FROM events),
spine AS (SELECT {key} unnest(generate_series({first}, {total})) AS bucket FROM {source}) """
_TRIG_ONE = {"by": "", "key": "", "first": "0", "total": "count(*)", "source": "events WHERE event_type = 'purchase'"}
_TRIG_KEY = {"by": "PARTITION BY user_id", "key": "user_id,", "first": "min(bucket)", "total": "count(*) FILTER (event_type = 'purchase')", "source": "b GROUP BY user_id"}
_SUMS = "coalesce(round(sum(value), 6), 0) AS sum"


def purchase():
    return F.col("event_type") == "purchase"


@query(_TRIG.format(**_TRIG_ONE, end="1 PRECEDING") + f"SELECT bucket, {_SUMS} FROM spine LEFT JOIN b USING (bucket) GROUP BY ALL")
def group_trigger_after_reduce(spark, d):
    return rounded(all_events(spark, d).group(purchase()).reduce(A.Sum("value")), "sum")


@query(_TRIG.format(**_TRIG_ONE, end="CURRENT ROW") + f"SELECT bucket, {_SUMS} FROM spine LEFT JOIN b USING (bucket) GROUP BY ALL")
def group_trigger_before_reduce(spark, d):
    return rounded(all_events(spark, d).group(purchase(), "before").reduce(A.Sum("value")), "sum")


@query(_TRIG.format(**_TRIG_ONE, end="1 PRECEDING") + "SELECT ts, event_id, bucket, round(sum(value) OVER (PARTITION BY bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS sum FROM b")
def group_trigger_after_scan(spark, d):
    return rounded(all_events(spark, d).group(purchase()).scan(A.Sum("value")).df, "sum").select("ts", "event_id", "bucket", "sum")


@query(_TRIG.format(**_TRIG_ONE, end="CURRENT ROW") + "SELECT ts, event_id, bucket, round(sum(value) OVER (PARTITION BY bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS sum FROM b")
def group_trigger_before_scan(spark, d):
    return rounded(all_events(spark, d).group(purchase(), "before").scan(A.Sum("value")).df, "sum").select("ts", "event_id", "bucket", "sum")


@query(_TRIG.format(**_TRIG_KEY, end="1 PRECEDING") + f"SELECT user_id, bucket, {_SUMS} FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL")
def group_keyed_trigger_after(spark, d):
    return rounded(by_user(spark, d).group(purchase()).reduce(A.Sum("value")), "sum")


@query(_TRIG.format(**_TRIG_KEY, end="CURRENT ROW") + f"SELECT user_id, bucket, {_SUMS} FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL")
def group_keyed_trigger_before(spark, d):
    return rounded(by_user(spark, d).group(purchase(), "before").reduce(A.Sum("value")), "sum")


@query(_TRIG.format(**_TRIG_KEY, end="1 PRECEDING") + f"SELECT user_id, bucket, {_SUMS} FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL")
def group_keyed_trigger_stream(spark, d):
    """As above with the trigger given as a stream per key of its own."""
    s = by_user(spark, d)
    return rounded(s.group(s.filter(purchase())).reduce(A.Sum("value")), "sum")


@query(f"""WITH b AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND value > 90 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bucket FROM events),
total AS (SELECT count(*) AS t FROM events WHERE event_type = 'purchase' AND value > 90),
spine AS (SELECT user_id, unnest(generate_series(min(bucket), max(t))) AS bucket FROM b, total GROUP BY user_id)
SELECT user_id, bucket, {_SUMS} FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL""")
def group_global_trigger_keyed(spark, d):
    """One trigger for all keys."""
    s = all_events(spark, d)
    keyed_ = Stream(by_user(spark, d).map(value=F.col("value")).df, s.order, ("user_id",), s.slice)
    return rounded(keyed_.group(s.filter(purchase() & (F.col("value") > 90))).reduce(A.Sum("value")), "sum")


@query(f"""WITH t AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events), b AS (SELECT *, (epoch_us(ts) - a) // 3600000000 AS bucket FROM events, t),
spine AS (SELECT unnest(generate_series(0, (z - a) // 3600000000)) AS bucket FROM t)
SELECT bucket, {_SUMS}, count(value) AS n, avg(value) IS NULL AS is_empty FROM spine LEFT JOIN b USING (bucket) GROUP BY ALL""")
def group_duration_gapfill(spark, d):
    out = all_events(spark, d).group(Every(3600)).reduce(A.Sum("value"), A.CountIf(F.col("value").isNotNull()), A.Avg("value"))
    return rounded(out, "sum").withColumn("is_empty", F.isnan("avg")).drop("avg")


@query("""WITH t AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events), b AS (SELECT *, (epoch_us(ts) - a) // 86400000000 AS bucket FROM events, t),
l AS (SELECT user_id, bucket, arg_max(value, (ts, event_id)) AS v FROM b GROUP BY ALL),
spine AS (SELECT user_id, unnest(generate_series(min(bucket), max((z - a) // 86400000000))) AS bucket FROM b GROUP BY user_id)
SELECT user_id, bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket) AS value FROM spine LEFT JOIN l USING (user_id, bucket)""")
def group_last_carried(spark, d):
    return by_user(spark, d).group(Every(86400)).last("value")


@query("SELECT user_id, CAST(0 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY user_id")
def group_termination(spark, d):
    return by_user(spark, d).group(None).reduce(A.Count())


# --- Boolean windows ---------------------------------------------------------------------------------------
_WIN = """WITH o AS (SELECT *, value > 60 AS open FROM events), e AS (SELECT *, coalesce(lag(open) OVER ({by} ORDER BY ts, event_id), FALSE) AS was FROM o),
w AS (SELECT *, CAST(sum(CASE WHEN open AND NOT was THEN 1 ELSE 0 END) OVER ({by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_id FROM e) """


@query(_WIN.format(by="PARTITION BY user_id") + """SELECT user_id, window_id, round(sum(value) FILTER (open), 6) AS sum, count(*) FILTER (open) AS n FROM w GROUP BY ALL HAVING bool_or(NOT open AND was)""")
def window_reduce_keyed(spark, d):
    return rounded(by_user(spark, d).window(F.col("value") > 60).reduce(A.Sum("value"), A.Count()), "sum")


@query(_WIN.format(by="PARTITION BY user_id") + """SELECT user_id, ts, event_id, window_id, round(sum(value) OVER (PARTITION BY user_id, window_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS sum FROM w WHERE open""")
def window_scan_keyed(spark, d):
    return rounded(by_user(spark, d).window(F.col("value") > 60).scan(A.Sum("value")).df, "sum").select("user_id", "ts", "event_id", "window_id", "sum")


@query(_WIN.format(by="") + "SELECT window_id, round(sum(value) FILTER (open), 6) AS sum FROM w GROUP BY ALL HAVING bool_or(NOT open AND was)")
def window_reduce(spark, d):
    return rounded(all_events(spark, d).window(F.col("value") > 60).reduce(A.Sum("value")), "sum")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) % 2 = 1 AS flag FROM events WHERE event_type = 'purchase' AND value > 90),
s AS (SELECT e.user_id, e.ts, e.event_id, e.value, count(t.event_id) OVER (ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING) AS n FROM events e LEFT JOIN t ON e.event_id = t.event_id)
SELECT (n + 1) // 2 AS window_id, round(sum(value), 6) AS sum, count(*) AS n_events FROM s WHERE n % 2 = 1 AND (n + 1) // 2 <= (SELECT count(*) // 2 FROM t) GROUP BY ALL""")
def window_toggled(spark, d):
    """A window that opens and closes at alternate events of another stream."""
    s = all_events(spark, d)
    flips = toggled(s.filter(purchase() & (F.col("value") > 90)))
    return rounded(s.window(flips).reduce(A.Sum("value"), A.Count("n_events")), "sum")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase' AND value > 95), n AS (SELECT count(*) // 2 AS closed FROM t),
s AS (SELECT e.*, count(t.event_id) OVER (ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING) AS c FROM events e LEFT JOIN t ON e.event_id = t.event_id),
born AS (SELECT user_id, arg_min(c, (ts, event_id)) AS c0 FROM s GROUP BY user_id), spine AS (SELECT user_id, c0, unnest(generate_series(1, closed)) AS w FROM born, n),
k AS (SELECT user_id, w FROM spine WHERE 2 * w > c0)
SELECT k.user_id, row_number() OVER (PARTITION BY k.user_id ORDER BY k.w) AS window_id, coalesce(round(sum(value), 6), 0) AS sum FROM k LEFT JOIN s ON k.user_id = s.user_id AND s.c = 2 * k.w - 1 GROUP BY k.user_id, k.w""")
def window_shared_keyed(spark, d):
    """One toggling window for all keys."""
    s = all_events(spark, d)
    flips = toggled(s.filter(purchase() & (F.col("value") > 95)))
    keyed_ = Stream(by_user(spark, d).map(value=F.col("value")).df, s.order, ("user_id",), s.slice)
    return rounded(keyed_.window(flips).reduce(A.Sum("value")), "sum")


@query("""SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS seq FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 15 MINUTE)) AS ts)""")
def timer_grid(spark, d):
    return timer(spark, "2024-01-01 00:00:00", "2024-01-31 00:00:00", 900).df


@query(f"SELECT user_id, round({_FOLD.format(values='list(value ORDER BY ts, event_id)', step='x * CAST(0.1 AS DOUBLE) + s * CAST(0.9 AS DOUBLE)')}, 9) AS ewma FROM events GROUP BY user_id")
def ewma_reduce(spark, d):
    return by_user(spark, d).reduce(A.Ewma("value", 0.9)).withColumn("ewma", F.round("ewma", 9))


@query(f"SELECT user_id, ts, event_id, round({_FOLD.format(values=f'list(value) OVER {W_USER}', step='x * CAST(0.1 AS DOUBLE) + s * CAST(0.9 AS DOUBLE)')}, 9) AS ewma FROM events")
def ewma_scan(spark, d):
    out = by_user(spark, d).map(value=F.col("value")).scan(A.Ewma("value", 0.9)).df
    return out.select("user_id", "ts", "event_id", F.round("ewma", 9).alias("ewma"))


# --- joins -------------------------------------------------------------------------------------------------
def clicks(spark, d) -> Stream:
    return of_type(spark, d, "click", user_id=F.col("user_id"), click=F.col("value"))


def purchases(spark, d) -> Stream:
    return of_type(spark, d, "purchase", user_id=F.col("user_id"), purchase=F.col("value"))


_LATEST = """WITH l AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS purchase
FROM events WINDOW w AS ({by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) """


@query(_LATEST.format(by="") + "SELECT ts, event_id, click, purchase FROM l WHERE event_type IN ('click', 'purchase')")
def join_latest(spark, d):
    x, y = (s.with_df(s.df.drop("user_id")) for s in (clicks(spark, d), purchases(spark, d)))
    return join(x, y).df


@query("SELECT c.ts, c.event_id, c.value AS click, p.value AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.ts >= p.ts")
def take_asof(spark, d):
    x, y = (s.with_df(s.df.drop("user_id")) for s in (clicks(spark, d), purchases(spark, d)))
    return take(x, y).df


@query(_LATEST.format(by="PARTITION BY user_id") + """SELECT user_id, ts, event_id, click, purchase FROM l WHERE event_type IN ('click', 'purchase') AND click IS NOT NULL""")
def keyed_join(spark, d):
    x, y = (s.by(user_id=F.col("user_id")) for s in (clicks(spark, d), purchases(spark, d)))
    return join(x, y).df


@query("SELECT c.user_id, c.ts, c.event_id, c.value AS click, p.value AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts")
def keyed_take(spark, d):
    x, y = (s.by(user_id=F.col("user_id")) for s in (clicks(spark, d), purchases(spark, d)))
    return take(x, y).df


@query("""WITH p AS (SELECT user_id % 10 AS g, ts, event_id, value FROM events WHERE event_type = 'purchase' AND user_id < 10)
SELECT c.user_id, c.ts, c.event_id, c.value AS click, p.value AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id % 10 = p.g AND c.ts >= p.ts""")
def keyed_take_keymap(spark, d):
    x = clicks(spark, d).by(user_id=F.col("user_id"))
    y = purchases(spark, d).filter(F.col("user_id") < 10).by(user_id=F.col("user_id"))
    return take(x, y, key_map=lambda k: k % 10).df


@query("""WITH keys AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'),
u AS (SELECT user_id, ts, event_id, value AS x, NULL AS y FROM events WHERE event_type = 'click'
UNION ALL SELECT k.user_id, ts, event_id, NULL, value FROM events e JOIN keys k ON e.user_id = k.user_id % 10 WHERE event_type = 'purchase' AND e.user_id < 10),
l AS (SELECT user_id, ts, event_id, last_value(x IGNORE NULLS) OVER w AS click, last_value(y IGNORE NULLS) OVER w AS purchase FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT * FROM l WHERE click IS NOT NULL""")
def keyed_join_keymap(spark, d):
    x = clicks(spark, d).by(user_id=F.col("user_id"))
    y = purchases(spark, d).filter(F.col("user_id") < 10).by(user_id=F.col("user_id"))
    return join(x, y, key_map=lambda k: k % 10).df


@query("SELECT e.ts, e.event_id, c.value AS click FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.ts >= c.ts")
def sample_single(spark, d):
    x = clicks(spark, d)
    return sample(x.with_df(x.df.drop("user_id")), purchases(spark, d)).df


@query("""WITH keys AS (SELECT user_id, min(ts) AS born FROM events WHERE event_type = 'click' GROUP BY ALL), e AS (SELECT ts, event_id FROM events WHERE event_type = 'purchase' AND value > 90),
s AS (SELECT k.user_id, e.ts, e.event_id FROM keys k JOIN e ON e.ts >= k.born)
SELECT s.user_id, s.ts, s.event_id, c.value AS click FROM s ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON s.user_id = c.user_id AND s.ts >= c.ts""")
def sample_keyed(spark, d):
    x = clicks(spark, d).by(user_id=F.col("user_id"))
    marks = purchases(spark, d).filter(F.col("purchase") > 90)
    return sample(x, marks.map(one=F.lit(1))).df


# --- several inputs in one bucket -----------------------------------------------------------------------------
@query("""WITH b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS bucket FROM events WHERE event_type IN ('click', 'purchase')),
spine AS (SELECT user_id, unnest(generate_series(0, count(*) // 5)) AS bucket FROM b GROUP BY user_id)
SELECT user_id, bucket, arg_min(CASE WHEN event_type = 'click' THEN value END, (ts, event_id)) FILTER (event_type = 'click') AS first_click, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_purchase,
count(*) FILTER (event_type = 'click') AS n_clicks, CAST(0 AS BIGINT) AS n_both FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL""")
def bind_multi_input(spark, d):
    x, y = (s.by(user_id=F.col("user_id")) for s in (clicks(spark, d), purchases(spark, d)))
    return bind(x, y).group(events(5)).reduce(
        A.First("click", "first_click"), A.Last("purchase", "last_purchase"), A.CountIf(F.col("click").isNotNull(), "n_clicks"),
        A.CountIf(F.col("click").isNotNull() & F.col("purchase").isNotNull(), "n_both"),
    )


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT *, (rn - 1) // 5 AS bucket FROM x), spine AS (SELECT user_id, unnest(generate_series(0, count(*) // 5)) AS bucket FROM b GROUP BY user_id)
SELECT user_id, bucket, count(event_id) AS n_x, count(*) FILTER (value > 50) AS n_y, count(*) FILTER (value > 50) AS n_both, arg_max(value, (ts, event_id)) AS last_x, arg_max(value, (ts, event_id)) FILTER (value > 50) AS last_y
FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL""")
def bind_same_cycle(spark, d):
    """Two inputs of one cycle, a stream and what is filtered from it, are in a bucket together before its value is taken."""
    s = by_user(spark, d)
    x, y = s.map(x=F.col("value")), s.filter(F.col("value") > 50).map(y=F.col("value"))
    return bind(x, y).group(events(5)).reduce(
        A.CountIf(F.col("x").isNotNull(), "n_x"), A.CountIf(F.col("y").isNotNull(), "n_y"), A.CountIf(F.col("x").isNotNull() & F.col("y").isNotNull(), "n_both"), A.Last("x", "last_x"), A.Last("y", "last_y")
    )


class Balance:
    """Clicks less purchases, each counted by the input that it comes from; a bucket's value is fixed when it closes."""

    def __init__(self):
        self.total, self.result, self.steps = 0, None, 0

    def add(self, tag, row):
        self.total += 1 if tag == "click" else -1
        self.steps += 1

    def close(self):
        self.result = 1000 * self.steps + self.total

    def value(self):
        return self.result


@query("""WITH b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS bucket FROM events WHERE event_type IN ('click', 'purchase')),
spine AS (SELECT user_id, unnest(generate_series(0, count(*) // 4)) AS bucket FROM b GROUP BY user_id)
SELECT user_id, bucket, 1000 * count(event_id) + count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'purchase') AS balance FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL""")
def collapse_tagged(spark, d):
    """Two inputs added to an object per bucket by adders of their own."""
    x, y = (s.by(user_id=F.col("user_id")) for s in (clicks(spark, d), purchases(spark, d)))
    return bind(x, y).group(events(4)).collapse(Balance, "balance", "bigint", tags={"click": "click", "purchase": "purchase"})


# --- sliced running values, empty slices, keys that choose ------------------------------------------------------
@query(f"""SELECT ts, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 9) AS avg, min(value) OVER w AS lo, max(value) OVER w AS hi, first_value(value) OVER w AS first, last_value(value) OVER w AS last,
array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ',') AS seen, round(sum(value * event_id) OVER w / nullif(sum(event_id) OVER w, 0), 6) AS vwap, bool_or(value > 99) OVER w AS any
FROM events WINDOW w AS {W_ALL}""")
def scan_stats(spark, d):
    """Running values of one stream without slices of its own: they come from the quantiles of its time."""
    s = stream(table(spark, d, "events"), "ts", "event_id", "event_type", "value").with_columns(id=F.col("event_id"))
    out = s.scan(A.Count(), A.Avg("value"), A.Min("value", "lo"), A.Max("value", "hi"), A.First("value"), A.Last("value"), A.SetOf("event_type", "seen"), A.Vwap("value", "id"), A.AnyTrue(F.col("value") > 99))
    return out.df.select("ts", "event_id", "n", F.round("avg", 9).alias("avg"), "lo", "hi", "first", "last", F.array_join("seen", ",").alias("seen"), F.round("vwap", 6).alias("vwap"), "any")


@query("SELECT event_type, ts, event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS sum FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def scan_hot_keys(spark, d):
    """Few keys with many rows each, cut into hours."""
    s = keyed(table(spark, d, "events"), ["event_type"], "ts", "event_id", "value", slice=F.date_trunc("hour", "ts"))
    return rounded(s.scan(A.Count(), A.Sum("value")).df, "sum").select("event_type", "ts", "event_id", "n", "sum")


@query("""WITH t AS (SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'),
x AS (SELECT e.ts, e.event_id, e.value, e.event_type, count(*) FILTER (event_type = 'purchase') OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bucket FROM events e),
v AS (SELECT * FROM x WHERE event_type = 'error')
SELECT ts, event_id, bucket, count(*) OVER (PARTITION BY bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM v
UNION ALL SELECT ts, event_id, k - 1, 0 FROM t WHERE k - 1 NOT IN (SELECT bucket FROM v)""")
def group_scan_empty(spark, d):
    """Running counts in slices cut by another stream; a slice without events shows its empty value when it ends."""
    s = all_events(spark, d)
    return s.filter_type("event_type", "error").group(s.filter(purchase())).scan(A.Count()).df.select("ts", "event_id", "bucket", "n")


@query("""WITH t AS (SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'),
x AS (SELECT e.*, count(*) FILTER (event_type = 'purchase') OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bucket FROM events e),
v AS (SELECT * FROM x WHERE event_type = 'error'), e AS (SELECT ts, event_id, k - 1 AS bucket FROM t WHERE k - 1 NOT IN (SELECT bucket FROM v))
SELECT ts, event_id, bucket, value FROM v UNION ALL SELECT e.ts, e.event_id, e.bucket, v.value FROM e ASOF LEFT JOIN v ON e.ts >= v.ts""")
def group_all(spark, d):
    """The latest values in slices; an empty slice shows the one before."""
    s = all_events(spark, d)
    return s.filter_type("event_type", "error").map(value=F.col("value")).group(s.filter(purchase())).all().df.select("ts", "event_id", "bucket", "value")


@query("""WITH b AS (SELECT *, CAST(count(*) FILTER (event_type = 'purchase') OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bucket FROM events),
spine AS (SELECT unnest(generate_series(0, count(*))) AS bucket FROM events WHERE event_type = 'purchase')
SELECT bucket, coalesce(round(sum(value) FILTER (event_type <> 'purchase'), 6), 0) AS sum FROM spine LEFT JOIN b USING (bucket) GROUP BY ALL""")
def group_stream_trigger(spark, d):
    """A single stream cut by another single stream."""
    s = stream(table(spark, d, "events"), "ts", "event_id", "event_type", "value")
    return rounded(s.filter(~purchase()).group(s.filter(purchase())).reduce(A.Sum("value")), "sum")


@query(_N.format(bucket="(rn - 1) // 3", first="0") + "SELECT user_id, bucket, coalesce(round(sum(value * (1 + user_id % 3)), 6), 0) AS sum, count(value) FILTER (value > user_id) AS n FROM spine LEFT JOIN b USING (user_id, bucket) GROUP BY ALL")
def reduce_by_key(spark, d):
    """Aggregates that depend on the key."""
    make = lambda k: [A.Sum(F.col("value") * (1 + k % 3)), A.CountIf(F.col("value") > k)]
    return rounded(by_user(spark, d).group(events(3)).reduce_k(make), "sum")


@query(_N.format(bucket="(rn - 1) // 3", first="0") + "SELECT user_id, ts, event_id, bucket, round(sum(value * (1 + user_id % 3)) OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS sum FROM b")
def scan_by_key(spark, d):
    out = by_user(spark, d).group(events(3)).scan_k(lambda k: [A.Sum(F.col("value") * (1 + k % 3))]).df
    return rounded(out, "sum").select("user_id", "ts", "event_id", "bucket", "sum")


@query("""WITH t AS (SELECT user_id % 10 AS g, ts, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'),
m AS (SELECT u.user_id, t.ts, t.event_id, t.k FROM (SELECT DISTINCT user_id FROM events) u JOIN t ON t.g = u.user_id % 10),
a AS (SELECT e.user_id, e.ts, e.event_id, e.value, m.k FROM events e LEFT JOIN m ON e.user_id = m.user_id AND e.event_id = m.event_id UNION ALL SELECT m.user_id, m.ts, m.event_id, NULL, m.k FROM m WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = m.user_id AND e.event_id = m.event_id)),
s AS (SELECT *, coalesce(max(k) OVER w, 0) AS n, count(value) OVER w AS born FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, n % 2 = 1 AS open FROM s WHERE born > 0), e AS (SELECT *, coalesce(lag(open) OVER w, FALSE) AS was FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (SELECT *, CAST(sum(CASE WHEN open AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_id FROM e)
SELECT user_id, window_id, coalesce(round(sum(value) FILTER (open), 6), 0) AS sum, count(value) FILTER (open) AS n FROM w GROUP BY ALL HAVING bool_or(NOT open AND was)""")
def window_by_key_map(spark, d):
    """Each key's window is that of its group, which opens and closes at alternate purchases of the group."""
    groups = all_events(spark, d).filter(purchase()).by(g=F.col("user_id") % 10)
    flips = toggled(groups)
    return rounded(by_user(spark, d).map(value=F.col("value")).window(flips, key_map=lambda k: k % 10).reduce(A.Sum("value"), A.Count()), "sum")


@query("SELECT user_id % 7 AS part, ts, event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS sum FROM events WHERE user_id % 2 = 0 WINDOW w AS (PARTITION BY user_id % 7 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def rekey(spark, d):
    """A keyed stream under another key that many old keys share."""
    out = by_user(spark, d).subset(F.col("user_id") % 2 == 0).by(part=F.col("user_id") % 7).scan(A.Count(), A.Sum("value")).df
    return rounded(out, "sum").select("part", "ts", "event_id", "n", "sum")


@query("SELECT user_id, ts, event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE event_id % 2 = 0")
def filter_variant(spark, d):
    """Values of mixed type, of which the whole numbers are taken."""
    mixed = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise(F.to_json(F.struct("event_type")))
    s = keyed(table(spark, d, "events"), ["user_id"], "ts", "event_id", "event_type", "props").with_columns(v=F.parse_json(mixed))
    return s.filter_variant("v", "BIGINT", "k").df.select("user_id", "ts", "event_id", "k")


@query("""WITH m AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, 0 AS source, o_orderkey AS seq, o_totalprice AS x FROM orders UNION ALL SELECT CAST(date_trunc('day', ts) AS TIMESTAMP), 1, event_id, value FROM events)
SELECT source, seq, row_number() OVER (ORDER BY ts, source, seq) AS n FROM m""")
def merged_sources(spark, d):
    """Two independent sources in one order; equal times are ordered by source."""
    x = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("double").alias("x"))
    y = table(spark, d, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("x"))
    out = Stream(merge_sources(x, y), ("ts", "seq")).scan(A.Count()).df
    return out.select("seq.source", "seq.seq", "n")


@query(f"""WITH w AS (SELECT ts, event_id, {', '.join(f"last_value(CASE WHEN event_type = '{t}' THEN value END IGNORE NULLS) OVER {W_ALL} AS {t}" for t in ('click', 'error', 'purchase', 'signup', 'view'))} FROM events)
SELECT ts, event_id, list_max([click, error, purchase, signup, view]) - list_min([click, error, purchase, signup, view]) AS spread FROM w""")
def map_vector_general(spark, d):
    """Any function of all keys' latest values, here the distance between the largest and the smallest."""
    s = all_events(spark, d).by(event_type=F.col("event_type"))
    return V.map_vector(s, "value", lambda latest: max(latest.values()) - min(latest.values()), "spread", "double").df


@query("SELECT user_id, CAST(i AS BIGINT) AS ts, CAST(i AS BIGINT) AS seq, CAST(user_id * 10 + i AS DOUBLE) AS value FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), generate_series(0, 4) g(i)")
def lazy_source(spark, d):
    """A source made for each key that is asked for."""
    return lazy_vector(all_events(spark, d).filter_type("event_type", "error").by(user_id=F.col("user_id")), lambda k: ((i, i, float(k * 10 + i)) for i in range(5))).df


@query("SELECT user_id AS series, ts, value FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, value FROM events)")
def plot_series(spark, d):
    return series(by_user(spark, d), "value")


@query("SELECT event_type AS key, ts, seq, value FROM (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS ts, event_type AS value FROM events), (SELECT CAST(0 AS BIGINT) AS seq) WHERE event_type = 'click'")
def fixed_keys(spark, d):
    """A fixed set of keys."""
    return as_vector(spark, ["click"]).df
