"""Combines the records of several sources to target shares of the total number of tokens.

1. Every document gets its number of tokens; the narrow result is kept as a table.
2. Tokens are added up per cell of source, language and topic: listed sources times listed languages and
   topics, everything else being ``other``. Only these sums come to the driver.
3. Iterative proportional fitting rakes the cells' token weights to the marginals of language and topic
   (as found in the listed sources, unless given) and, last, of source, no cell going beyond its source's
   cap on repeats.
4. A cell's weight over its tokens is the expected number of uses of its documents. The whole part is used
   by all; the fraction by the documents of the smallest hashes, as many as make up the tokens. Where they
   end is found in Spark: sums per range of hashes tell the range, and only that range's documents are put
   in order. What whole documents leave the cells of a source short of or beyond their weights, its largest
   cell makes up for.

Defined cases: sources are compared without outer spaces and case, ``-`` being ``_``; a document of a null
or unlisted source, or without tokens, is never chosen; the shares of listed sources without documents are
spread over the others in proportion; without a total the largest one is taken at which every source
reaches its share; with a larger total, capped sources fall short and the report says by how much; documents
with the same id are chosen alike; an empty table gives an empty mix. A source's share can't come nearer to
its target than the size of one document allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.bounds import broadcast_if_small
from streamloom.llm.tokens import DIRECTORY, VOCABULARY, tokenizer
from streamloom.session import durable

#: Ranges of hashes per cell.
RANGES = 1024
CELL = ("source", "language", "topic")


def clean_source(source: Column) -> Column:
    return F.nullif(F.translate(F.lower(F.trim(source)), "-", "_"), F.lit(""))


def _one_of(values: Sequence[str], col: Column) -> Column:
    return F.when(col.isin(*values), col).otherwise(F.lit("other"))


def _counted(directory: str, vocabulary: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = tokenizer(directory, vocabulary)
        for batch in batches:
            counts = [tok.count(t.as_py()) for t in batch.column("text")]
            kept = [batch.column(c) for c in ("id", "source", "language", "topic")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], ["id", "source", "language", "topic", "n_tokens"])

    return run


def fill(weights: np.ndarray, caps: np.ndarray, group: np.ndarray, target: np.ndarray) -> np.ndarray:
    """In every group, ``weights`` times a common factor, none above its cap, adding up to the group's
    ``target`` or to all its caps."""
    n = len(target)
    base = np.maximum(weights, caps * 1e-12)
    total = lambda factor: np.bincount(group, np.minimum(base * factor[group], caps), n)
    full = target >= np.bincount(group, caps, n)
    low, high = np.zeros(n), np.ones(n)
    while (short := ~full & (total(high) < target)).any():
        high[short] *= 2
    for _ in range(100):
        mid = (low + high) / 2
        under = total(mid) < target
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(full[group], caps, np.minimum(base * high[group], caps))


def rake(tokens: np.ndarray, caps: np.ndarray, margins: Sequence[tuple[np.ndarray, np.ndarray]], rounds: int = 200) -> np.ndarray:
    """Iterative proportional fitting of cell weights within caps. A margin is the cells' group numbers and
    the groups' targets; the last margin holds exactly wherever its caps allow."""
    w = tokens.astype(float).copy()
    for _ in range(rounds):
        before = w.copy()
        for group, target in margins:
            w = fill(w, caps, group, target)
        if np.abs(w - before).max(initial=0) <= 1e-9 * max(1.0, w.max(initial=0)):
            break
    return w


def _margin(names: np.ndarray, amounts: np.ndarray, given: Mapping[str, float] | None, total: float) -> tuple[np.ndarray, np.ndarray]:
    groups, number = np.unique(names.astype(str), return_inverse=True)
    share = np.array([given.get(g, 0.0) for g in groups]) if given else np.bincount(number, amounts, len(groups))
    return number, share / share.sum() * total if share.sum() else share


def _extra(sized: DataFrame, ranges: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with ``base`` and ``extra``: whether a document is among those of the smallest hashes of its
    cell that make up the cell's ``want``."""
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*CELL).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = ranges.withColumn("before", before).join(plan, list(CELL))
    ends = reached.where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("m")))
    ends = ends.select(*CELL, F.col("range").alias("end"), (F.col("want") - F.col("before")).alias("left"))
    cells = durable(plan.join(ends, list(CELL), "left"))  # a row per cell
    rows = sized.join(broadcast_if_small(cells), list(CELL))
    settled = rows.where(F.col("end").isNull() | (F.col("range") != F.col("end")))
    # a cell without an end uses all its documents; nothing is wanted of one of 0
    settled = settled.withColumn("extra", F.col("end").isNull() & (F.col("want") > 0) | F.coalesce(F.col("range") < F.col("end"), F.lit(False)))
    w = Window.partitionBy(*CELL)
    last = rows.where(F.col("range") == F.col("end")).withColumns({"upto": F.sum("n_tokens").over(w.orderBy("u")), "alike": F.sum("n_tokens").over(Window.partitionBy(*CELL, "u"))})
    last = last.withColumn("extra", F.col("upto") - F.col("alike") / 2 <= F.col("left")).drop("upto", "alike")
    return settled.unionByName(last).drop("end", "left")


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, doc_id: str, text: str, source: str, language: Column, topic: Column,
    languages: Sequence[str], topics: Sequence[str], total_tokens: float | None = None,
    language_shares: Mapping[str, float] | None = None, topic_shares: Mapping[str, float] | None = None,
    seed: int = 7, directory: str = DIRECTORY, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents ``doc_id, source, language, topic, n_tokens, repeats`` and the report ``source,
    target_share, max_repeats, n_tokens, actual_share``. ``targets`` has ``source, target_share, max_repeats``."""
    spark = documents.sparkSession
    listed = targets.groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("source is not null")
    rows = documents.select(
        F.col(doc_id).alias("id"), clean_source(F.col(source)).alias("source"), _one_of(languages, language).alias("language"), _one_of(topics, topic).alias("topic"), F.col(text).alias("text")
    ).where(F.length("text") > 0)
    rows = rows.join(broadcast_if_small(listed.select("source")), "source", "left_semi").select("id", *CELL, "text")
    kind = dict(rows.dtypes)["id"]
    counted = durable(rows.mapInArrow(_counted(directory, vocabulary), f"id {kind}, source string, language string, topic string, n_tokens bigint"))
    # a document without language or topic is among the others
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))
    sized = counted.withColumn("u", u).withColumn("range", F.floor(F.col("u") * RANGES).cast("int"))
    ranges = durable(sized.groupBy(*CELL, "range").agg(F.sum("n_tokens").alias("m")))

    cells = ranges.groupBy(*CELL).agg(F.sum("m").alias("tokens")).join(listed, "source").select(*CELL, "tokens", "share", "cap").toPandas()
    cells = cells.sort_values(list(CELL)).reset_index(drop=True)
    amounts, sources = cells["tokens"].to_numpy(float), cells["source"].to_numpy()
    names, number = np.unique(sources.astype(str), return_inverse=True)
    first = np.unique(number, return_index=True)[1]
    share, repeats = np.maximum(cells["share"].fillna(0).to_numpy(float), 0)[first], np.maximum(cells["cap"].fillna(0).to_numpy(float), 0)
    caps = repeats * amounts
    whole = share.sum() or 1.0
    reach = (np.bincount(number, caps, len(names)) / np.where(share > 0, share, 1) * whole)[share > 0]
    total = total_tokens if total_tokens is not None else reach.min(initial=np.inf) if len(reach) else 0.0
    margins = [_margin(cells["language"].to_numpy(), amounts, language_shares, total), _margin(cells["topic"].to_numpy(), amounts, topic_shares, total), (number, share / whole * total)]
    weights = rake(amounts, caps, margins)

    def planned(weights: np.ndarray) -> DataFrame:
        base = np.floor(np.minimum(weights, caps) / np.maximum(amounts, 1) + 1e-9)
        rows = [(*key, int(b), float(max(0.0, w - b * a))) for key, b, w, a in zip(cells[list(CELL)].itertuples(index=False, name=None), base, np.minimum(weights, caps), amounts)]
        return spark.createDataFrame(rows, "source string, language string, topic string, base int, want double")

    if len(cells):
        used = _extra(sized, ranges, planned(weights)).groupBy(*CELL).agg(F.sum(F.col("n_tokens") * (F.col("base") + F.col("extra").cast("int"))).alias("used"))
        used = cells[list(CELL)].merge(used.toPandas(), on=list(CELL), how="left")["used"].to_numpy(float)
        largest = np.lexsort((amounts, number))[np.append(np.flatnonzero(np.diff(np.sort(number))), len(number) - 1)]
        owed = np.bincount(number, weights - used, len(names)) - (weights - used)[largest]
        weights[largest] = np.clip(weights[largest] + owed, 0, caps[largest])
    chosen = _extra(sized, ranges, planned(weights)).withColumn("repeats", F.col("base") + F.col("extra").cast("int")).where("repeats > 0")
    chosen = chosen.select(F.col("id").alias(doc_id), *CELL, "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    in_all = F.sum("n_tokens").over(_everything())
    report = listed.join(used, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce(F.col("n_tokens") / in_all, F.lit(0.0)).alias("actual_share")
    )
    return chosen, report


def _everything():
    """A window over the report's rows, one per listed source."""
    return Window.partitionBy(F.lit(0))
