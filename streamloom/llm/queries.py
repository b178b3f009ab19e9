"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.contamination import find_leaks
from streamloom.llm.mixing import mix_sources
from streamloom.llm.nearest import match_nearest
from streamloom.llm.runs import collapse_runs
from streamloom.llm.splitting import split_oversized
from streamloom.sources.tables import table


def quote_runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    half_tick = table(spark, d, "instruments").select(F.col("ticker").alias("ent"), (F.col("tick") / 2).alias("tol"))
    return collapse_runs(
        table(spark, d, "quotes"), entity="ticker", time="time", seq="seq", absolute=["bid", "ask"], relative=["bidDepth", "askDepth"],
        tolerance=half_tick, rel_tolerance=0.02, least=least,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quote_runs(spark, d, 2).select("ticker", "first_seq", "last_seq")


def told_apart(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as null with a flag beside it, since NaN equals nothing where rows are compared."""
    return df.withColumns({f"{c}_nan": F.coalesce(F.isnan(c), F.lit(False)) for c in columns}).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every quote or run of quotes as one, with its number of quotes and its duration."""
    return told_apart(quote_runs(spark, d, 1), "bid", "ask")


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Every trade with the bid and ask of the quote nearest to it, nulls where none is within five seconds."""
    quotes = table(spark, d, "quotes").where("bid is not null and ask is not null")
    return match_nearest(
        table(spark, d, "trades"), quotes, entity="ticker", time="time", left_id="seq", right_id="seq", tolerance_us=5_000_000,
        left_columns=["ticker", "price"], right_columns=["bid", "ask"],
    )


def p3_matched(spark: SparkSession, d: str) -> DataFrame:
    return told_apart(matched(spark, d), "left_price", "right_bid", "right_ask")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).where("right_seq is not null").select(F.col("left_seq").alias("trade_seq"), F.col("right_seq").alias("quote_seq"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _mixed(spark: SparkSession, d: str, **more) -> tuple[DataFrame, DataFrame]:
    return mix_sources(
        table(spark, d, "documents"), table(spark, d, "mix_targets"), doc_id="doc_id", text="text", source="source",
        language=F.element_at(F.split(F.lower(F.trim("lang")), "-"), 1), languages=["en", "de", "es", "ja"],
        topic=F.col("namespace").cast("string"), topics=["0", "1", "100"], **more,
    )


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].select("doc_id", "source", "n_tokens", "repeats")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


LANGUAGE_SHARES = {"en": 0.4, "de": 0.25, "es": 0.25, "ja": 0.05, "other": 0.05}


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """The mix with target shares of languages beside those of the sources, as actual shares of both."""
    chosen = _mixed(spark, d, language_shares=LANGUAGE_SHARES)[0]
    used = chosen.groupBy("language", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    total = used.agg(F.sum("n_tokens").alias("__all"))  # one row
    return used.join(F.broadcast(total)).select("language", "source", "n_tokens", (F.col("n_tokens") / F.col("__all")).alias("actual_share"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"), item_id="doc_id", text="text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pieces(spark, d).where("piece = 0").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p3_found, p3_matched, p6_found, p7_mix, p7_shares, p7_languages, p8_found, p8_pieces)}
_MATCHED = """WITH t AS (SELECT min(seq) AS seq, ticker, time, price FROM trades GROUP BY ticker, time, price, quantity, board, source, buyer, seller, initiator),
q AS (SELECT ticker, time, min(seq) AS seq, arg_min(bid, seq) AS bid, arg_min(ask, seq) AS ask FROM quotes
  WHERE bid IS NOT NULL AND ask IS NOT NULL AND ticker IS NOT NULL AND time IS NOT NULL GROUP BY ticker, time),
pairs AS (SELECT t.seq, t.ticker, t.price, epoch_us(t.time) AS tt, b.seq AS bs, b.bid AS bb, b.ask AS ba, epoch_us(b.time) AS bt, f.seq AS fs, f.bid AS fb, f.ask AS fa, epoch_us(f.time) AS ft
  FROM t ASOF LEFT JOIN q b ON t.ticker = b.ticker AND t.time >= b.time ASOF LEFT JOIN q f ON t.ticker = f.ticker AND t.time <= f.time),
near AS (SELECT *, CASE WHEN tt - bt <= 5000000 AND (ft IS NULL OR tt - bt <= ft - tt) THEN 'b' WHEN ft - tt <= 5000000 THEN 'f' END AS side FROM pairs) """



def _nan(c: str) -> str:
    """Whether a price is NaN. Stored NaNs are told by their text: statistics without NaN would let isnan() be folded away."""
    return f"(CAST({c} AS VARCHAR) = 'nan')"


def _as_number(c: str, name: str) -> str:
    return f"CASE WHEN {_nan(c)} THEN NULL ELSE {c} + 0.0 END AS {name}, coalesce({_nan(c)}, FALSE) AS {name}_nan"


def _alike(new: str, old: str, within: str) -> str:
    return f"CASE WHEN {new} IS NULL OR {old} IS NULL THEN {new} IS NULL AND {old} IS NULL ELSE abs({new} - {old}) <= {within} END"


_PRICE, _DEPTH = "tol * (1 + 1e-6) OR ({0} AND {1})", "CAST(0.02 AS DOUBLE) * abs({1}) * (1 + 1e-9)"
_ALIKE = " AND ".join(
    [*[_alike(x, y, _PRICE.format(_nan(x), _nan(y))) for x, y in (("bid", "b"), ("ask", "a"))], *[_alike(x, y, _DEPTH.format(x, y)) for x, y in (("bidDepth", "bd"), ("askDepth", "ad"))]]
)
_RUNS = f"""WITH RECURSIVE q AS (SELECT min(seq) AS seq, ticker, time, bid, bidDepth, ask, askDepth FROM quotes GROUP BY ALL),
n AS (SELECT q.*, CAST(time AS DATE) AS day, coalesce(tick, 0) / 2 AS tol, row_number() OVER (PARTITION BY q.ticker, CAST(time AS DATE) ORDER BY time, seq) AS rn
  FROM q LEFT JOIN instruments i ON q.ticker = i.ticker WHERE q.ticker IS NOT NULL AND time IS NOT NULL),
r AS (SELECT ticker, day, rn, seq, time, bid AS b, ask AS a, bidDepth AS bd, askDepth AS ad, rn AS run FROM n WHERE rn = 1
  UNION ALL SELECT ticker, day, rn, seq, time, CASE WHEN ok THEN b ELSE bid END, CASE WHEN ok THEN a ELSE ask END, CASE WHEN ok THEN bd ELSE bidDepth END, CASE WHEN ok THEN ad ELSE askDepth END, CASE WHEN ok THEN run ELSE rn END
  FROM (SELECT n.*, r.b, r.a, r.bd, r.ad, r.run, {_ALIKE} AS ok FROM r JOIN n ON n.ticker = r.ticker AND n.day = r.day AND n.rn = r.rn + 1)) """

SQL: dict[str, str] = {
    "p1_found": _RUNS + "SELECT ticker, arg_min(seq, rn) AS first_seq, arg_max(seq, rn) AS last_seq FROM r GROUP BY ticker, day, run HAVING count(*) >= 2",
    "p1_collapsed": _RUNS + f"""SELECT ticker, day, first_seq, last_seq, n_events, start_time, end_time, epoch_us(end_time) - epoch_us(start_time) AS duration_us, {_as_number("b", "bid")}, {_as_number("a", "ask")}, bd AS bidDepth, ad AS askDepth
FROM (SELECT ticker, day, arg_min(seq, rn) AS first_seq, arg_max(seq, rn) AS last_seq, count(*) AS n_events, min(time) AS start_time, max(time) AS end_time,
  any_value(b) AS b, any_value(a) AS a, any_value(bd) AS bd, any_value(ad) AS ad FROM r GROUP BY ticker, day, run)""",
    "p3_found": _MATCHED + "SELECT seq AS trade_seq, CASE side WHEN 'b' THEN bs ELSE fs END AS quote_seq FROM near WHERE side IS NOT NULL",
    "p3_matched": _MATCHED + f"""SELECT left_seq, left_ticker, {_as_number("p", "left_price")}, right_seq, {_as_number("xb", "right_bid")}, {_as_number("xa", "right_ask")}, gap_us FROM (
SELECT seq AS left_seq, ticker AS left_ticker, price AS p, CASE side WHEN 'b' THEN bs WHEN 'f' THEN fs END AS right_seq,
CASE side WHEN 'b' THEN bb WHEN 'f' THEN fb END AS xb, CASE side WHEN 'b' THEN ba WHEN 'f' THEN fa END AS xa,
CASE side WHEN 'b' THEN bt - tt WHEN 'f' THEN ft - tt END AS gap_us FROM near)""",
}
