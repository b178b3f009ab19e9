"""Pairs each record with the record of another table nearest in time, per entity and within a tolerance.

Rows of both sides are hash-partitioned by entity and time bucket; a right row within the tolerance of a
bucket's border is sent to the neighbouring bucket too. So a hot entity is spread over its buckets, and
every candidate of a left row is in its own bucket. Each partition, sorted, is cut at bucket borders into
Arrow groups of a bounded number of rows; inside a group DuckDB makes one ASOF join backward and one
forward, and the nearer candidate within tolerance is taken.

Defined cases: of two equally near candidates the earlier is taken, of equal times the smaller right id; a
left row without candidate comes out with nulls; a left row with a null entity or time too; right rows with
a null entity or time are no candidates; of left rows equal in all columns but the id only the one with the
smallest id counts (-0.0 equals 0.0 and NaN equals NaN); empty tables are allowed on either side; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.bounds import second_of_day

FLUSH = 200_000
_ASOF = """
WITH r AS (SELECT k, t, min(i) AS i FROM right_rows GROUP BY k, t)
SELECT l.i AS li, b.i AS bi, l.t - b.t AS bgap, f.i AS fi, f.t - l.t AS fgap
FROM left_rows l
ASOF LEFT JOIN r b ON l.k = b.k AND l.t >= b.t
ASOF LEFT JOIN r f ON l.k = f.k AND l.t <= f.t
"""


def nearest_in_group(connection, left, right, tolerance_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of left rows and of their nearest right rows (-1: none). Both are Arrow tables ``k, t, i``."""
    connection.register("left_rows", left)
    connection.register("right_rows", right)
    found = connection.sql(_ASOF).to_arrow_table()
    at = found.column("li").to_numpy()
    far = np.iinfo(np.int64).max
    b, f, bgap, fgap = (found.column(c).combine_chunks().fill_null(x).to_numpy(zero_copy_only=False) for c, x in (("bi", -1), ("fi", -1), ("bgap", far), ("fgap", far)))
    nearest = np.where(bgap <= fgap, b, f)
    return at, np.where(np.minimum(bgap, fgap) <= tolerance_us, nearest, -1)


def _match(left_cols: Sequence[str], right_cols: Sequence[str], tolerance_us: int):
    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa
        import pyarrow.compute as pc

        connection = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})

        def work(table, wait=None):
            """Matches the left rows; those marked in ``wait`` come later."""
            right = table.column("right").to_numpy(zero_copy_only=False)
            group = np.zeros(table.num_rows, bool)
            for c in ("ent", "bucket"):
                x = table.column(c).combine_chunks()
                group[1:] |= pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True).to_numpy(zero_copy_only=False)
            k = np.cumsum(group)
            t = pc.fill_null(table.column("t").cast("int64"), 0).to_numpy()
            i = np.arange(table.num_rows)
            copy = np.zeros(table.num_rows, bool)
            same = table.column("same").combine_chunks()
            copy[1:] = ~group[1:] & ~right[1:] & ~right[:-1] & pc.fill_null(pc.equal(same.slice(1), same.slice(0, len(same) - 1)), False).to_numpy(zero_copy_only=False)
            null_key = table.column("ent").is_null().to_numpy() | table.column("bucket").is_null().to_numpy()
            copy[1:] |= null_key[1:] & null_key[:-1] & pc.fill_null(pc.equal(same.slice(1), same.slice(0, len(same) - 1)), False).to_numpy(zero_copy_only=False)
            right = right | copy  # a copy takes no part on either side
            if wait is not None:
                copy, right = copy | (wait & ~right), right | wait
            ok = table.column("ent").is_valid().to_numpy() & table.column("t").is_valid().to_numpy()
            lefts, rights = np.flatnonzero(~right & ok), np.flatnonzero(right & ok & ~copy)
            at, nearest = np.flatnonzero(~right & ~ok), np.full(int((~right & ~ok).sum()), -1)
            if len(lefts):
                sides = [pa.table({"k": k[x], "t": t[x], "i": i[x]}) for x in (lefts, rights)]
                a, b = nearest_in_group(connection, *sides, tolerance_us)
                at, nearest = np.concatenate([a, at]), np.concatenate([b, nearest])
            if not len(at):
                return
            out = table.select(["t", *left_cols]).take(pa.array(at))
            picks = pa.array(nearest, mask=nearest < 0)
            out = out.rename_columns(["lt", *left_cols])
            for c in ("t", *right_cols):
                out = out.append_column("rt" if c == "t" else c, table.column(c).take(picks))
            yield from out.to_batches()

        rest, size = [], 0
        for batch in batches:
            rest.append(batch)
            size += batch.num_rows
            if size < FLUSH:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            last = (table.column("ent")[-1], table.column("bucket")[-1])
            same = pc.and_(pc.equal(table.column("ent"), last[0]), pc.equal(table.column("bucket"), last[1]))
            cut = table.num_rows - int(pc.sum(pc.fill_null(same, False)).as_py() or 0)
            if last[0].is_valid and last[1].is_valid and table.num_rows - cut > FLUSH // 2:
                # a crowded bucket goes in parts: a left row can be matched once a tolerance's worth of later
                # rows is there, and a right row is needed as long as a left row in reach may come
                t = table.column("t").cast("int64").to_numpy()
                is_right, mine = table.column("right").to_numpy(zero_copy_only=False), np.arange(table.num_rows) >= cut
                horizon = int(t[-1]) - tolerance_us
                yield from work(table, mine & ~is_right & (t >= horizon))
                table = table.filter(pa.array(mine & np.where(is_right, t >= horizon - tolerance_us, t >= horizon))).combine_chunks()
            elif cut and last[0].is_valid:
                yield from work(table.slice(0, cut).combine_chunks())
                table = table.slice(cut).combine_chunks()
            elif not last[0].is_valid or not last[1].is_valid:  # such rows need no company but their copies
                alike = pc.fill_null(pc.equal(table.column("same"), table.column("same")[-1]), False)
                cut = table.num_rows - int(pc.sum(alike).as_py())
                yield from work(table.slice(0, cut).combine_chunks()) if cut else ()
                table = table.slice(cut).combine_chunks()
                table = table if cut else table.slice(0, 1)
            rest, size = table.to_batches(), table.num_rows
        if size:
            yield from work(pa.Table.from_batches(rest).combine_chunks())

    return run


def _bucket(time: Column, shift: int, seconds: int) -> Column:
    return F.floor((F.unix_date(F.to_date(time)).cast("bigint") * 86400 + second_of_day(time) + shift) / seconds)


def match_nearest(
    left: DataFrame, right: DataFrame, *, entity: str, time: str, left_id: str, right_id: str, tolerance_us: int,
    left_columns: Sequence[str] = (), right_columns: Sequence[str] = (), bucket_seconds: int = 600,
) -> DataFrame:
    """Every left row once: ``left_<id>``, ``left_<column>…``, ``right_<id>``, ``right_<column>…`` and
    ``gap_us``, how much later the right row is."""
    lefts = {c: f"l{i}" for i, c in enumerate([left_id, *left_columns])}
    rights = {c: f"r{i}" for i, c in enumerate([right_id, *right_columns])}
    kinds = {**{lefts[c]: dict(left.dtypes)[c] for c in lefts}, **{rights[c]: dict(right.dtypes)[c] for c in rights}}
    seconds = max(bucket_seconds, 1)
    reach = math.ceil(tolerance_us / 1e6) + 1

    # copies are equal in all columns, so also in entity and time: they are neighbours in the sorted partition
    others = [F.col(c) for c in left.columns if c != left_id]
    # what is equal in all of them has one hash of 128 bits; the nulls' places are hashed, too, as nulls leave no trace
    nulls = F.array(*[c.isNull() for c in others])
    same = F.concat(F.hex(F.xxhash64(nulls, *others)), F.lit(":"), F.hex(F.xxhash64(F.lit(1), *others, nulls)))
    l_row = left.select(F.col(entity).alias("ent"), F.col(time).alias("t"), F.lit(False).alias("right"), same.alias("same"), *[F.col(c).alias(n) for c, n in lefts.items()])
    l_row = l_row.withColumn("bucket", _bucket(F.col("t"), 0, seconds))
    l_row = l_row.withColumn("salt", F.when(F.col("ent").isNull() | F.col("t").isNull(), F.pmod(F.xxhash64("same"), F.lit(1024))).otherwise(F.lit(0)).cast("int"))
    r_row = right.select(F.col(entity).alias("ent"), F.col(time).alias("t"), F.lit(True).alias("right"), *[F.col(c).alias(n) for c, n in rights.items()])
    r_row = r_row.where("ent is not null and t is not null").withColumn("bucket", F.explode(F.sequence(_bucket(F.col("t"), -reach, seconds), _bucket(F.col("t"), reach, seconds))))
    columns = ["ent", "bucket", "salt", "t", "right", "same", *lefts.values(), *rights.values()]

    def whole(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns])

    r_row = r_row.withColumn("salt", F.lit(0))
    rows = whole(l_row).unionByName(whole(r_row)).repartition("ent", "bucket", "salt")
    rows = rows.sortWithinPartitions("ent", "bucket", "t", "right", rights[right_id], "same", lefts[left_id])
    types = dict(rows.dtypes)
    schema = ", ".join([f"lt {types['t']}", *[f"{n} {types[n]}" for n in lefts.values()], f"rt {types['t']}", *[f"{n} {types[n]}" for n in rights.values()]])
    out = rows.mapInArrow(_match(list(lefts.values()), list(rights.values()), tolerance_us), schema)
    gap = F.unix_micros(F.col("rt").cast("timestamp")) - F.unix_micros(F.col("lt").cast("timestamp"))
    return out.select(*[F.col(n).alias(f"left_{c}") for c, n in lefts.items()], *[F.col(n).alias(f"right_{c}") for c, n in rights.items()], gap.alias("gap_us"))
