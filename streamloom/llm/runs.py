"""Runs of equal or almost equal consecutive events, collapsed into one event each.

A run is taken from the start of the date onward and as long as possible: every event is within tolerance
of the run's first event, its anchor; null equals only null.

1. Canonical values. Events are cut by entity, date and slice of the day, so a hot entity is spread over its
   slices. One pass over each sorted slice gives every event the values of its run's anchor; consecutive
   events of one anchor leave it as one part with their number (the map side of the later aggregate) and the
   number of its first event within the slice.
2. Slices. What a slice's first events belong to depends on the anchor that comes in. It only matters where
   that anchor first fails, which is one of the few events that go beyond all before them; for each of these
   the pass follows the runs until they meet, and hands on a summary. The summaries of a date, a few rows a
   slice however long it is, are chained in order; the parts that belong to other ways are dropped.
3. Row numbers. The number of an event within its entity less its number within entity and canonical values
   is constant over a run and differs between runs of equal values. Grouping by it gives count and duration:
   first within slices, then, over the first and last run of each slice, across them.

Defined cases: an event with a null entity or time stands alone; equal times are ordered by ``seq``; of
events equal in all columns but ``seq`` only the one with the smallest counts; an entity without a
tolerance gets 0; -0.0 equals 0.0 and NaN equals NaN; an empty table gives an empty result; other columns
are kept out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.arrow import changes, stretches
from streamloom.bounds import broadcast_if_small, clock_slice, one_of_copies
from streamloom.session import durable

_GROUP = ("ent", "day", "slice")
_SLICE = (*_GROUP, "sub")
#: A summary row's number of the way on which the anchor that comes in lasts.
_LASTS = 2**30


def _numbers(table, fields: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values and null masks as matrices, a column per field; NaN counts as a value."""
    values = np.empty((table.num_rows, len(fields)))
    nulls = np.empty((table.num_rows, len(fields)), bool)
    for i, f in enumerate(fields):
        col = table.column(f)
        nulls[:, i] = col.is_null().to_numpy()
        values[:, i] = col.cast("float64", safe=False).fill_null(0.0).to_numpy()
    return values, nulls


class Rule:
    """Who is within tolerance of whom, over rows of values ``x`` and null masks ``u``."""

    def __init__(self, x: np.ndarray, u: np.ndarray, tol: np.ndarray, n_abs: int, rel: float):
        self.x, self.u, self.tol, self.n_abs, self.rel = x, u, tol, n_abs, rel

    def fits(self, anchor, event) -> np.ndarray:
        """Whether rows ``event`` belong to runs that rows ``anchor`` start."""
        return within(self.x[anchor], self.u[anchor], self.x[event], self.u[event], self.tol[event], self.n_abs, self.rel)

    def apart(self, x: np.ndarray, y: np.ndarray, tol: np.ndarray) -> np.ndarray:
        """Whether values can't both lie within tolerance of any third."""
        both = ~(np.isnan(x) & np.isnan(y))
        with np.errstate(invalid="ignore"):
            most = np.empty(x.shape)
            most[:, : self.n_abs] = 2 * tol[:, None] * (1 + 1e-6)
            # |x - y| <= 2 rel |a| where |a| <= min(|x|, |y|) / (1 - rel)
            most[:, self.n_abs :] = 2 * self.rel / (1 - self.rel) * np.minimum(np.abs(x), np.abs(y))[:, self.n_abs :] * (1 + 1e-9)
            return both & ~(np.abs(x - y) <= most)

    def breaks(self) -> np.ndarray:
        """Whether a row and the one before it can't belong to one run, from the second row on."""
        differ = self.u[1:] != self.u[:-1]
        return (differ | (~self.u[1:] & self.apart(self.x[:-1], self.x[1:], self.tol[1:]))).any(1)

    def next_anchor(self, anchor: int, end: int) -> int:
        """The first row after ``anchor`` that does not belong to its run, or ``end``."""
        at, step = anchor + 1, 8
        while at < end:
            stop = min(at + step, end)
            out = ~self.fits(np.full(stop - at, anchor), np.arange(at, stop))
            if out.any():
                return at + int(out.argmax())
            at, step = stop, min(2 * step, 8192)
        return end


def within(a: np.ndarray, a_null: np.ndarray, b: np.ndarray, b_null: np.ndarray, tol: np.ndarray, n_abs: int, rel: float) -> np.ndarray:
    """Whether events ``b`` belong to the runs that ``a`` start, row by row."""
    with np.errstate(invalid="ignore"):
        far = np.abs(a - b)
        ok = np.empty(far.shape, bool)
        ok[:, :n_abs] = far[:, :n_abs] <= tol[:, None] * (1 + 1e-6)
        ok[:, n_abs:] = far[:, n_abs:] <= rel * np.abs(a[:, n_abs:]) * (1 + 1e-9)
    ok |= np.isnan(a) & np.isnan(b)
    return np.where(a_null | b_null, a_null & b_null, ok).all(1)


def anchors(rule: Rule, broken: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Rows that start a run, in every stretch that begins at a certain break; ``head`` marks the first rows
    of slices, whose stretch is left out."""
    n = len(broken)
    mark = broken & ~head
    begins = np.flatnonzero(broken)
    ends = np.append(begins[1:], n)
    known = ~head[begins] & (ends - begins > 1)
    anchor, at, end = begins[known], begins[known] + 1, ends[known]
    for _ in range(8):  # all stretches side by side while there are many
        if len(at) < 16:
            break
        fits = rule.fits(anchor, at)
        mark[at[~fits]] = True
        anchor, at = np.where(fits, anchor, at), at + 1
        more = at < end
        anchor, at, end = anchor[more], at[more], end[more]
    for a, i, e in zip(anchor.tolist(), at.tolist(), end.tolist()):
        fits = rule.fits(np.full(e - i, a), np.arange(i, e)) if e - i <= 8 else None
        j = rule.next_anchor(a, e) if fits is None else (i + int((~fits).argmax()) if not fits.all() else e)
        while j < e:
            mark[j] = True
            j = rule.next_anchor(j, e)
    return mark


def ways(rule: Rule, first: int, end: int) -> tuple[list[int], bool, dict[int, int], dict[int, int]]:
    """How the rows of a slice up to its first certain break may be cut, whatever anchor comes in.

    Returns the rows at which that anchor can fail, in order; whether it can last; and for every row that
    starts a run on some way the next such row and the ways, as bits in the order of the first list."""
    if end - first == 1:
        return [first], True, {first: end}, {first: 1}
    x = rule.x[first:end]
    high, low = np.fmax.accumulate(x), np.fmin.accumulate(x)
    record = np.ones(end - first, bool)
    record[1:] = ((high[1:] > high[:-1]) | (low[1:] < low[:-1])).any(1)
    at = np.flatnonzero(record)
    # beyond a row that no anchor of all rows before can reach, none is left
    dead = (rule.apart(low[at], high[at], rule.tol[first + at]) & ~rule.u[first + at]).any(1)
    lasts = not dead.any()
    if not lasts:
        at = at[: int(dead.argmax()) + 1]
    starts = (first + at).tolist()
    after: dict[int, int] = {}
    on = {row: 1 << i for i, row in enumerate(starts)}
    waiting = sorted(on)
    import heapq

    while waiting:
        row = heapq.heappop(waiting)
        if row in after:
            continue
        after[row] = rule.next_anchor(row, end)
        if after[row] < end:
            on[after[row]] = on.get(after[row], 0) | on[row]
            heapq.heappush(waiting, after[row])
    return starts, lasts, after, on


def _canonical_pass(fields: Sequence[str], others: Sequence[str], n_abs: int, rel: float, least: int, flush: int | None):
    """Sorted events to parts of runs and summaries of slices (see ``_columns``)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table, groups in stretches(batches, _GROUP, [*fields, *others], flush):
            n = table.num_rows
            begins = np.array([g[0] for g in groups])
            starts = np.zeros(n, bool)
            starts[begins] = True
            event = np.flatnonzero(changes(table, fields) | starts)  # equal events in a row are one row from here
            bound = np.append(event, n)
            small = table.select(list(fields)).take(pa.array(event)).combine_chunks()
            rule = Rule(*_numbers(small, fields), table.column("tol").to_numpy()[event], n_abs, rel)
            head = starts[event]
            broken = head.copy()
            broken[1:] |= rule.breaks()
            mark = anchors(rule, broken, head)
            edges = np.flatnonzero(broken)
            heads = np.flatnonzero(head)
            parts: list[tuple] = []  # first row, end row, ways, whether its canonical values come in
            summary: list[tuple] = []  # first row of slice, number of the way, row at which the anchor fails, row of the last anchor
            for first, stop in zip(heads.tolist(), np.append(heads[1:], len(event)).tolist()):
                i = int(np.searchsorted(edges, first, side="right"))
                end = int(edges[i]) if i < len(edges) else len(event)
                fails, lasts, after, on = ways(rule, first, end)
                every = (1 << len(fails)) - 1
                for row, nxt in after.items():
                    if on[row] == every and not lasts:
                        mark[row] = True  # all ways have met
                    else:
                        parts.append((row, nxt, [i for i in range(len(fails)) if on[row] >> i & 1], False))
                parts += [(first, row, [i], True) for i, row in enumerate(fails) if row > first]
                if lasts:
                    parts.append((first, end, [_LASTS], True))
                last = int(np.flatnonzero(mark[first:stop])[-1]) + first if end < stop else -1
                for i, row in enumerate(fails):
                    while last < 0 and after[row] < end:
                        row = after[row]
                    summary.append((first, i, fails[i], last if last >= 0 else row))
                if lasts:
                    summary.append((first, _LASTS, -1, last))
            limits = np.append(np.flatnonzero(mark | head), len(event))
            sure = np.flatnonzero(mark)
            until = limits[np.searchsorted(limits, sure, side="right")]
            slice_of = lambda row: np.searchsorted(begins, event[row], side="right") - 1
            ends_slice = np.append(head[1:], True)[until - 1]
            keep = (bound[until] - event[sure] >= least) | ends_slice
            sure, until = sure[keep], until[keep]
            first = np.concatenate([sure, np.array([p[0] for p in parts], np.int64)]).astype(np.int64)
            stop = np.concatenate([until, np.array([p[1] for p in parts], np.int64)]).astype(np.int64)
            of = slice_of(first)
            sizes = np.array([g[1] - g[0] for g in groups])
            subs = np.array([g[2] for g in groups], np.int32)
            e0, e1 = event[first], bound[stop] - 1
            m = len(first)
            coming = np.concatenate([np.zeros(len(sure), bool), np.array([p[3] for p in parts], bool)])
            out = {c: table.column(c).take(pa.array(e0)) for c in _GROUP}
            out |= {"sub": pa.array(subs[of]), "kind": pa.array(np.zeros(m, np.int32)), "way": pa.nulls(m, pa.int32())}
            out["ways"] = pa.array([None] * len(sure) + [p[2] for p in parts], pa.list_(pa.int32()))
            out |= {"idx": pa.array(e0 - begins[of]), "n": pa.array(e1 - e0 + 1), "total": pa.array(sizes[of])}
            out |= {a: table.column(c).take(pa.array(x)) for a, c, x in (("t0", "t", e0), ("s0", "s", e0), ("t1", "t", e1), ("s1", "s", e1))}
            out |= {"tol": pa.nulls(m, pa.float64())} | {c: small.column(c).take(pa.array(first, mask=coming)) for c in fields}
            out |= {f"e{c}": pa.nulls(m, small.column(c).type) for c in fields} | {"coming": pa.array(coming)}
            yield from pa.table(out).to_batches()
            k = len(summary)
            lead, way, fail, last = (np.array(x, np.int64) for x in zip(*summary))
            e0, of = event[lead], slice_of(lead)
            none = {c: pa.nulls(k, out[c].type) for c in ("ways", "idx", "n", "total", "t0", "s0", "t1", "s1")}
            rows = {c: table.column(c).take(pa.array(e0)) for c in _GROUP}
            rows |= {"sub": pa.array(subs[of]), "kind": pa.array(np.ones(k, np.int32)), "way": pa.array(way.astype(np.int32)), **none, "tol": pa.array(rule.tol[lead])}
            rows |= {c: small.column(c).take(pa.array(fail, mask=fail < 0)) for c in fields} | {f"e{c}": small.column(c).take(pa.array(last, mask=last < 0)) for c in fields}
            # here: whether the anchor that came in is also the one that goes out
            yield from pa.table(rows | {"coming": pa.array(last < 0)}).to_batches()

    return run


def _chain_pass(fields: Sequence[str], n_abs: int, rel: float):
    """Summaries in order to the way that each slice takes, and the anchor that comes in."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, key, anchor, done = None, None, None, False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x, u = _numbers(table, fields)
            ends = table.select([f"e{c}" for c in fields]).rename_columns(list(fields))
            ex, eu = _numbers(ends, fields)
            tol, way, stays = table.column("tol").to_numpy(), table.column("way").to_numpy(), table.column("coming").to_numpy(zero_copy_only=False)
            found, values, masks = [], [], []
            for i, (group, name) in enumerate(zip(zip(*[table.column(c).to_pylist() for c in ("ent", "day")]), zip(*[table.column(c).to_pylist() for c in _SLICE]))):
                if group != of:
                    of, anchor = group, None
                if name != key:
                    key, done = name, False
                if done:
                    continue
                fits = anchor is not None and (way[i] == _LASTS or within(anchor[0], anchor[1], x[i : i + 1], u[i : i + 1], tol[i : i + 1], n_abs, rel)[0])
                if fits and way[i] != _LASTS:
                    continue
                done = True
                found.append(i)
                values.append(anchor[0][0] if anchor else np.zeros(len(fields)))
                masks.append(anchor[1][0] if anchor else np.ones(len(fields), bool))
                if not stays[i]:
                    anchor = ex[i : i + 1], eu[i : i + 1]
            if found:
                out = table.select([*_SLICE, "way"]).take(pa.array(found))
                for j, c in enumerate(fields):
                    out = out.append_column(f"e{c}", pa.array(np.array(values)[:, j], mask=np.array(masks)[:, j]).cast(table.column(c).type, safe=False))
                yield from out.combine_chunks().to_batches()

    return run


def collapse_runs(
    df: DataFrame, *, entity: str, time: str, seq: str, absolute: Sequence[str], relative: Sequence[str] = (),
    tolerance: DataFrame | None = None, rel_tolerance: float = 0.0, least: int = 1, slice_seconds: int = 1800, flush: int | None = None,
) -> DataFrame:
    """One row per run of at least ``least`` events: ``entity, day, first_seq, last_seq, n_events,
    start_time, end_time, duration_us`` and the fields of its first event.

    ``tolerance`` has ``ent`` and ``tol``: by how much the ``absolute`` fields of an entity may differ from
    the first event's. The ``relative`` fields may differ by ``rel_tolerance`` times the first event's. A
    slice of more than ``flush`` events is cut further."""
    fields = [*absolute, *relative]
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    kinds = dict(df.dtypes)
    names = [f"f{i}" for i in range(len(fields))]
    others = [c for n, c in place.items() if n not in (entity, time, seq, *fields)]

    def canonical(c: str):
        col = F.col(place[c])
        return col + F.lit(0.0) if kinds[c] in ("double", "float") else col  # -0.0 becomes 0.0

    raw = df.toDF(*place.values()).select(
        F.col(place[entity]).alias("ent"), F.col(place[time]).alias("t"), F.col(place[seq]).alias("s"), *[canonical(c).alias(n) for c, n in zip(fields, names)], *others
    )
    alone = F.col("ent").isNull() | F.col("t").isNull()
    placed = raw.where(~alone).withColumns({"day": F.to_date("t"), "slice": clock_slice(F.col("t"), slice_seconds), "tol": F.lit(0.0)})
    if tolerance is not None:
        side = tolerance.select(F.col("ent").alias("of_ent"), F.col("tol").cast("double").alias("of_tol"))
        placed = placed.join(broadcast_if_small(side), F.col("ent") == F.col("of_ent"), "left").withColumn("tol", F.coalesce("of_tol", "tol")).drop("of_ent", "of_tol")
    # nothing is joined between this exchange and the pass, so no slice can be split
    events = placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "t", "s")
    types = dict(events.dtypes)
    columns = {c: types[c] for c in _GROUP} | {"sub": "int", "kind": "int", "way": "int", "ways": "array<int>"} | dict.fromkeys(("idx", "n", "total"), "bigint")
    columns |= {"t0": types["t"], "s0": types["s"], "t1": types["t"], "s1": types["s"], "tol": "double"}
    columns |= {c: types[c] for c in names} | {f"e{c}": types[c] for c in names} | {"coming": "boolean"}
    sizes = (len(absolute), rel_tolerance)
    passed = events.mapInArrow(_canonical_pass(names, others, *sizes, least, flush), ", ".join(f"{c} {k}" for c, k in columns.items()))
    local = durable(passed)

    # the way that each slice takes
    chained = local.where("kind = 1").select(*_SLICE, "way", "tol", "coming", *names, *[f"e{c}" for c in names])
    chained = chained.repartition("ent", "day").sortWithinPartitions("ent", "day", "slice", "sub", "way")
    taken = chained.mapInArrow(_chain_pass(names, *sizes), ", ".join(f"{c} {columns[c]}" for c in (*_SLICE, "way", *[f"e{c}" for c in names])))
    span = ["idx", "n", "total", "t0", "s0", "t1", "s1"]
    parts = local.where("kind = 0")
    known = parts.where("ways is null").select(*_SLICE, *names, *span)
    open_ = parts.where("ways is not null").select(*_SLICE, "ways", "coming", *names, *span).join(taken, [*_SLICE])
    open_ = open_.where(F.array_contains("ways", F.col("way"))).select(*_SLICE, *[F.when(F.col("coming"), F.col(f"e{c}")).otherwise(F.col(c)).alias(c) for c in names], *span)

    def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], number) -> DataFrame:
        """Parts grouped by the difference between the number of an event within ``by`` and its number within
        ``by`` and canonical values: one row per run."""
        of_value = F.coalesce(F.sum("n").over(Window.partitionBy(*by, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = F.struct(*order)
        firsts = [F.min_by(c, at).alias(c) for c in ("t0", "s0", "slice", "sub", "idx") if c not in by]
        lasts = [F.max_by(c, at).alias(c) for c in ("t1", "s1")]
        return rows.withColumn("difference", number - of_value).groupBy(*by, *names, "difference").agg(F.sum("n").alias("n"), F.max("total").alias("total"), *firsts, *lasts).drop("difference")

    in_slices = numbered(known.unionByName(open_), _SLICE, ["idx"], F.col("idx"))
    at_edge = (F.col("idx") == 0) | (F.col("idx") + F.col("n") == F.col("total"))
    # the first and last run of every slice: at most two rows a slice meet here, numbered by the events of all slices before
    earlier = Window.partitionBy("ent", "day").orderBy("slice", "sub", "idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("idx") + F.col("n") == F.col("total"), F.col("total"))).over(earlier), F.lit(0))
    edges = in_slices.where(at_edge).withColumn("number", before + F.col("idx"))
    across = numbered(edges, ["ent", "day"], ["number"], F.col("number"))
    rows = ["ent", "day", *names, "t0", "s0", "t1", "s1", "n"]
    out = in_slices.where(~at_edge).select(*rows).unionByName(across.select(*rows))
    if least <= 1:
        lone = one_of_copies(raw.where(alone), "s").select("ent", F.to_date("t").alias("day"), *names, F.col("t").alias("t0"), F.col("s").alias("s0"), F.col("t").alias("t1"), F.col("s").alias("s1"), F.lit(1).cast("bigint").alias("n"))
        out = out.unionByName(lone)
    micros = F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    return out.where(F.col("n") >= least).select(
        F.col("ent").alias(entity), "day", F.col("s0").alias("first_seq"), F.col("s1").alias("last_seq"), F.col("n").alias("n_events"),
        F.col("t0").alias("start_time"), F.col("t1").alias("end_time"), micros.alias("duration_us"), *[F.col(n).alias(c) for c, n in zip(fields, names)],
    )
