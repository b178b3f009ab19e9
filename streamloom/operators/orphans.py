"""References to records that do not exist, are withdrawn, or come later.

A reference is an orphan if at its time no parent of that key had arrived, or the parent was withdrawn.
The distinct (key, time) pairs of non-null, non-blank references are anti-joined with the parents' spans
of life; the pairs left over are joined back to the rows.

Defined cases: keys are compared without outer spaces and case; a null or blank key is no reference; a
parent row with a null key or time counts for nothing; a reference with a null time is an orphan only if
its key has no parent at all; of equal rows that differ in ``seq`` alone the smallest counts once; an
empty child table gives an empty result, an empty parent table makes every reference an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.bounds import one_of_copies
from streamloom.operators.skew import SHARE, few_heavy_keys
from streamloom.session import durable


def clean_key(key: Column) -> Column:
    """Upper case without outer spaces; null if nothing is left."""
    return F.nullif(F.upper(F.trim(key)), F.lit(""))


def life_spans(parents: DataFrame, key: str, time: str, born: Column, dead: Column) -> DataFrame:
    """``p_key, p_from, p_until``: the earliest birth and the earliest withdrawal per key."""
    return (
        parents.select(clean_key(F.col(key)).alias("p_key"), F.when(born, F.col(time)).alias("b"), F.when(dead, F.col(time)).alias("d"))
        .where("p_key is not null")
        .groupBy("p_key")
        .agg(F.min("b").alias("p_from"), F.min("d").alias("p_until"))
        .where("p_from is not null")
    )


def orphan_rows(children: DataFrame, spans: DataFrame, key: str, time: str, seq: str, table: str) -> DataFrame:
    """``tbl, seq, time, ref_key`` of every orphan row of one child table (epoch milliseconds in ``time``)."""
    # a column named like one of ours can't clash: rows are packed before anything is added
    rows = one_of_copies(children, seq).select(F.col(seq).alias("seq"), F.col(time).alias("time"), clean_key(F.col(key)).alias("ref_key")).where("ref_key is not null")
    rows = durable(rows)  # used for hot keys, for pairs and in the join back
    pairs = rows.groupBy("ref_key", "time").agg(F.count(F.lit(1)).alias("n"))
    alive = (F.col("ref_key") == F.col("p_key")) & (
        F.col("time").isNull() | ((F.col("p_from") <= F.col("time")) & (F.col("p_until").isNull() | (F.col("p_until") > F.col("time"))))
    )
    # a reference to one key may be repeated in a third of all rows: such keys (fewer than 25) meet a broadcast
    hot = F.broadcast(few_heavy_keys(rows, "ref_key", SHARE, "h_key"))
    few = F.broadcast(spans.join(hot, F.col("p_key") == F.col("h_key"), "left_semi"))
    is_hot = F.col("ref_key") == F.col("h_key")
    missing = pairs.join(hot, is_hot, "left_semi").join(few, alive, "left_anti").unionByName(pairs.join(hot, is_hot, "left_anti").join(spans, alive, "left_anti"))
    missing = missing.select(F.col("ref_key").alias("m_key"), F.col("time").alias("m_time"))
    back = (F.col("ref_key") == F.col("m_key")) & F.col("time").eqNullSafe(F.col("m_time"))
    # a hot key's references of one time, null for one, may be very many: they are joined in parts
    salts = F.lit(64)
    is_salted = F.col("__hot").isNotNull()
    mark = hot.withColumnRenamed("h_key", "__hot")
    rows = rows.join(mark, F.col("ref_key") == F.col("__hot"), "left").withColumn("__salt", F.when(is_salted, F.pmod("seq", salts)).otherwise(F.lit(0)).cast("int"))
    missing = missing.join(mark, F.col("m_key") == F.col("__hot"), "left").withColumn("m_salt", F.explode(F.when(is_salted, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    back = back & (F.col("__salt") == F.col("m_salt"))
    return rows.join(missing.drop("__hot"), back, "left_semi").select(F.lit(table).alias("tbl"), "seq", "time", "ref_key")


def period_of(time: Column) -> Column:
    """UTC date of epoch milliseconds as ``yyyy-MM-dd``, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(time / 86_400_000).cast("int")), "yyyy-MM-dd")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``tbl, period, n_orphans, n_keys`` per table and date."""
    # two steps, so that the keys of one date are counted in many tasks
    per_key = orphans.groupBy("tbl", period_of(F.col("time")).alias("period"), "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("tbl", "period").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
