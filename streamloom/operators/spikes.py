"""Wrong, frozen and impossible readings, judged by what is usual for their source.

Readings are cut by source, date and slice of the day, so a hot source is spread over as many tasks as it
has slices; all passes read the same exchange.

1. What is usual for each source: an exact median, from counts per distinct change. It is selected by
   refinement: counts per narrow range of values first, then only the range that holds the median.
2. A Hampel filter over every possible reading of a source's date: a reading is a candidate if it stands off
   the rolling median of the ``2 * longest + 1`` readings before it and of those after it, each by more than
   three scaled median absolute deviations of that window, taken as at least three and at most six usual
   changes. (Two one-sided windows keep a level's move from hiding or making candidates.) A reading that is no
   candidate is sound.
3. Candidates are confirmed along the order: at most ``longest`` in a row that depart to one side, by more than
   ``jump`` times the usual change, from the last sound reading before and the next one after. A candidate that
   isn't confirmed is sound, too.
4. Slices meet: between its first and last sound reading a slice settles all by itself. What lies outside
   goes, with the readings that its windows need, to a pass in which the slices of a date meet, so the result
   is that of the whole date, however the slices are cut. Only a slice in which every reading is a candidate
   goes there whole.

Rules, each per source and field:
- impossible: not a number, zero or negative;
- frozen: one of at least ``stuck`` equal non-null readings in a row within a date;
- spike of a level: a confirmed candidate of the filter (frozen and impossible readings take no part in it);
- spike of a size: more than ``burst`` times the source's median.

Defined cases: null readings are skipped; a null source or time gives no flags; equal times are ordered by
``seq``; of rows equal in all columns but ``seq`` only the smallest counts; a source without a tick has no
smallest change; without any usual change there is no spike; the first and last readings of a date are no
spikes; a single reading at a level to which the source moves within the next ``longest`` readings or so is
the first of that level, no spike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.arrow import changes, stretches
from streamloom.bounds import clock_slice, has_at_most
from streamloom.session import durable

IMPOSSIBLE, FROZEN, SPIKE = 1, 2, 3
FEW_SOURCES = 100_000
#: Exchanges that leave the middle of seven values in place 3, and the factor that makes a
#: median absolute deviation of normal values their standard deviation.
_MIDDLE_OF_7 = ((0, 5), (0, 3), (1, 6), (2, 4), (0, 1), (3, 5), (2, 6), (2, 3), (3, 6), (4, 5), (1, 4), (1, 3), (3, 4))
_NORMAL = 1.4826


def _middle(rows: list[np.ndarray]) -> np.ndarray:
    """The median of each column of an odd number of rows."""
    if len(rows) != 7:
        return np.median(np.stack(rows), axis=0)
    rows = list(rows)
    for i, j in _MIDDLE_OF_7:
        rows[i], rows[j] = np.minimum(rows[i], rows[j]), np.maximum(rows[i], rows[j])
    return rows[3]


def rolling(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0), np.zeros(0)
    rows = [x[i : i + n] for i in range(width)]
    med = _middle(rows)
    return med, _middle([np.abs(r - med) for r in rows])


def stands_off(x: np.ndarray, med: np.ndarray, mad: np.ndarray, usual: np.ndarray) -> np.ndarray:
    return np.abs(x - med) > np.clip(3 * _NORMAL * mad, 3 * usual, 6 * usual)


def hampel(x: np.ndarray, usual: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates, and for which readings that is known: those with whole windows on both sides."""
    w = 2 * longest + 1
    known, out = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if len(x) > 2 * w:
        with np.errstate(invalid="ignore"):
            med, mad = rolling(x, w)
            mid = slice(w, len(x) - w)
            out[mid] = stands_off(x[mid], med[: -w - 1], mad[: -w - 1], usual[mid]) & stands_off(x[mid], med[w + 1 :], mad[w + 1 :], usual[mid])
        known[mid] = True
    return out, known


def hampel_at_ends(x: np.ndarray, at: np.ndarray, usual: float, longest: int) -> np.ndarray:
    """The same for the readings ``at``, with shorter windows where the date begins or ends."""
    w, out = 2 * longest + 1, np.zeros(len(at), bool)
    with np.errstate(invalid="ignore"):
        for k, i in enumerate(at.tolist()):
            sides = x[max(0, i - w) : i], x[i + 1 : i + 1 + w]
            if len(sides[0]) and len(sides[1]):
                meds = [np.median(s) for s in sides]
                mads = [np.median(np.abs(s - m)) for s, m in zip(sides, meds)]
                out[k] = all(stands_off(x[i], m, d, usual) for m, d in zip(meds, mads))
    return out


def confirmed(x: np.ndarray, candidate: np.ndarray, usual: np.ndarray, jump: float, longest: int) -> np.ndarray:
    """Which candidates are spikes, over possible readings in order; only candidates after a jump are visited."""
    n, out = len(x), np.zeros(len(x), bool)
    at = 0
    with np.errstate(invalid="ignore"):
        jumps = np.flatnonzero(candidate[1:] & (np.abs(np.diff(x)) > jump * usual[1:])) + 1
    for i in jumps.tolist():
        if i < at:
            continue
        sound, far = x[i - 1], jump * usual[i]
        while i < n and candidate[i] and abs(x[i] - sound) > far:
            side = 1.0 if x[i] > sound else -1.0
            found = 0
            for k in range(1, longest + 1):
                if i + k >= n or not candidate[i + k - 1] or (x[i + k - 1] - sound) * side <= far:
                    break
                if ((x[i : i + k] - x[i + k]) * side > far).all():
                    found = k
                    break
            if not found:
                break
            out[i : i + found] = True
            i += found
        at = i + 1
    return out


_GROUP = ("src", "day", "slice")
_EDGE = "src string, fld int, day date, slice int, sub int, t timestamp_ntz, s bigint, v double, usual double, flag int, edge boolean, open boolean, state int, run int, gap boolean"
_LAST = "src string, fld int, t timestamp_ntz, s bigint, v double, flag int"


def _readings(table, field: str, groups: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-null readings of a field: their rows, their values and the numbers of their groups."""
    import pyarrow.compute as pc

    col = table.column(field).combine_chunks()
    rows = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    of = np.repeat(np.arange(len(groups)), [b - a for a, b, _ in groups])
    return rows, pc.fill_null(col, 0.0).to_numpy(zero_copy_only=False)[rows], of[rows]


_COUNTS = "src string, fld int, day date, slice int, sub int, unit double, x double, z double, n bigint"


def _count_pass(levels: int, fields: int, others: Sequence[str], flush: int | None):
    """Counts of distinct changes (levels) and readings (sizes) per source and field, and, with a count of
    0, the first and last possible reading of every slice, by which changes between slices are found."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table, groups in stretches(batches, _GROUP, others, flush):
            firsts = np.array([g[0] for g in groups])
            unit_of = table.column("tick").to_numpy(zero_copy_only=False)[firsts]
            names = table.column("src").take(pa.array(firsts)).combine_chunks().dictionary_encode()
            source_of = names.indices.to_numpy()
            for f in range(fields):
                _, v, of = _readings(table, f"v{f}", groups)
                of, v = of[v > 0], v[v > 0]
                if not len(v):
                    continue
                ends = None
                if f < levels:
                    new = np.append(True, of[1:] != of[:-1])
                    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(v)) - 1
                    ends = of[first], v[first], v[last]
                    with np.errstate(invalid="ignore"):
                        x, of = np.abs(np.diff(v))[~new[1:]], of[1:][~new[1:]]
                    unit = unit_of[of]
                    keep = np.where(unit > 0, x >= unit * (1 - 1e-6), x > 0)
                    x, of, unit = x[keep], of[keep], unit[keep]
                    # float noise of differences, below a thousandth of a tick, is rounded away
                    x = np.where(unit > 0, np.round(x / np.where(unit > 0, unit, 1), 3), x)
                else:
                    x, unit = v, np.zeros(len(v))
                order = np.lexsort((x, source_of[of]))
                x, who, unit = x[order], source_of[of][order], unit[order]
                new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (who[1:] != who[:-1]))) if len(x) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(x)))
                m = len(new)
                none = {"day": pa.nulls(m, pa.date32()), "slice": pa.nulls(m, pa.int32()), "sub": pa.nulls(m, pa.int32())}
                columns = {"src": names.dictionary.take(pa.array(who[new])), "fld": pa.array(np.full(m, f, np.int32)), **none, "unit": pa.array(unit[new], mask=unit[new] <= 0), "x": pa.array(x[new]), "z": pa.nulls(m, pa.float64()), "n": pa.array(n)}
                if m:
                    yield from pa.table(columns).to_batches()
                if ends is not None:
                    g, a, z = ends
                    m, at = len(g), pa.array(firsts[g])
                    columns = {"src": table.column("src").take(at), "fld": pa.array(np.full(m, f, np.int32)), "day": table.column("day").take(at), "slice": table.column("slice").take(at)}
                    columns |= {"sub": pa.array([groups[i][2] for i in g.tolist()], pa.int32()), "unit": pa.array(unit_of[g], mask=~(unit_of[g] > 0)), "x": pa.array(a), "z": pa.array(z), "n": pa.array(np.zeros(m, np.int64))}
                    yield from pa.table(columns).to_batches()

    return run


def _equal_runs(v: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal readings that each reading is in, and the runs' lengths; NaN equals nothing."""
    run = np.cumsum(np.append(True, (v[1:] != v[:-1]) | (of[1:] != of[:-1]))) - 1
    return run, np.bincount(run)


def _flag_pass(levels: int, fields: int, others: Sequence[str], rules: dict, flush: int | None):
    """Flags of all that a slice settles by itself, and the raw readings (``edge``) that other slices need or
    that need them; of these ``open`` ones are not settled."""
    jump, longest, burst, stuck = (rules[k] for k in ("jump", "longest", "burst", "stuck"))
    w = 2 * longest + 1

    def work(v: np.ndarray, of: np.ndarray, usual: np.ndarray, level: bool):
        n = len(v)
        run, lengths = _equal_runs(v, of)
        length = lengths[run]
        begin, end = np.append(True, of[1:] != of[:-1]), np.append(of[1:] != of[:-1], True)
        possible, frozen = v > 0, length >= stuck
        flag = np.where(~possible, IMPOSSIBLE, np.where(frozen, FROZEN, 0)).astype(np.int32)
        # the runs at a slice's ends may go on beyond them; of long ones as many readings are needed as make one frozen
        outer = np.isin(run, run[begin | end])
        place = np.arange(n) - np.flatnonzero(np.append(True, run[1:] != run[:-1]))[run]
        edge = outer & ((place < stuck) | (length - place <= stuck))
        open_, state, gap = outer & possible & ~frozen, np.full(n, 2, np.int32), np.zeros(n, bool)
        d = np.flatnonzero(possible & ~frozen & ~outer)
        if not level:
            flag[d[(v[d] > burst * usual[d]) & (usual[d] > 0)]] = SPIKE
        elif len(d):
            x, u, mine = v[d], usual[d], of[d]
            candidate, known = hampel(x, u, longest)
            firsts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            ends = np.append(firsts[1:], len(d))
            first, end = np.repeat(firsts, ends - firsts), np.repeat(ends, ends - firsts)
            at = np.arange(len(d))
            known &= (at - first >= w) & (at < end - w)
            candidate &= known & (u > 0)
            sound = np.flatnonzero(known & ~candidate)
            i, j = np.searchsorted(sound, firsts), np.searchsorted(sound, ends)
            there = j > i
            pad = np.append(sound, 0)
            p, q = np.where(there, pad[np.minimum(i, len(sound))], ends), np.where(there, pad[np.maximum(j - 1, 0)], firsts)
            p_of, q_of = np.repeat(p, ends - firsts), np.repeat(q, ends - firsts)
            inside = (at > p_of) & (at < q_of)
            flag[d[confirmed(x, candidate & inside, u, jump, longest)]] = SPIKE
            head, tail = np.maximum(p_of + 1, first + 2 * w), np.minimum(q_of, end - 2 * w)
            kept = (at < head) | (at >= tail)
            open_[d] = ((at < p_of) | (at > q_of)) & (u > 0)
            edge[d] = kept
            state[d] = np.where(known, candidate, -1)
            gap[d] = kept & (at > first) & ~np.append(True, kept[:-1])
        keep = np.flatnonzero((flag > 0) | edge)
        return keep, {"flag": flag, "edge": edge, "open": open_, "state": state, "run": run.astype(np.int32), "gap": gap}

    def run_(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table, groups in stretches(batches, _GROUP, others, flush):
            subs = np.array([g[2] for g in groups], np.int32)
            for f in range(fields):
                rows, v, of = _readings(table, f"v{f}", groups)
                if not len(rows):
                    continue
                usual = table.column(f"u{f}").to_numpy(zero_copy_only=False)[rows]
                keep, marks = work(v, of, usual, f < levels)
                at = pa.array(rows[keep])
                out = {"src": table.column("src").take(at), "fld": pa.array(np.full(len(keep), f, np.int32)), "day": table.column("day").take(at), "slice": table.column("slice").take(at)}
                out |= {"sub": pa.array(subs[of[keep]]), "t": table.column("t").take(at), "s": table.column("s").take(at), "v": pa.array(v[keep]), "usual": pa.array(usual[keep])}
                yield from pa.table(out | {k: pa.array(x[keep]) for k, x in marks.items()}).to_batches()

    return run_


def _seam_pass(levels: int, rules: dict):
    """Judges the open readings where the slices of a date meet, and passes on what is flagged already."""
    jump, longest, burst, stuck = (rules[k] for k in ("jump", "longest", "burst", "stuck"))

    def judge(table) -> np.ndarray:
        """Flags over the edges of one source, field and date, in order."""
        v, u, run, state = (table.column(c).to_numpy() for c in ("v", "usual", "run", "state"))
        open_, gap = (table.column(c).to_numpy(zero_copy_only=False) for c in ("open", "gap"))
        flag = table.column("flag").to_numpy().copy()
        of = np.cumsum(changes(table, ["slice", "sub"]))
        other = of[1:] != of[:-1]
        # runs of equal readings go on only from a slice's last reading to the next one's first
        raw = state == 2
        new = np.append(True, ~(raw[1:] & raw[:-1] & (v[1:] == v[:-1]) & (other | (run[1:] == run[:-1]))))
        number = np.cumsum(new) - 1
        frozen = raw & (np.bincount(number)[number] >= stuck)
        possible = (v > 0) & ~frozen
        flag = np.where(open_ & frozen, FROZEN, flag)
        if table.column("fld")[0].as_py() >= levels:
            return np.where(open_ & possible & (u > 0) & (v > burst * u), SPIKE, flag)
        if not u[0] > 0:
            return flag
        d = np.flatnonzero(possible)
        cuts = np.flatnonzero(gap[d])
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(d)).tolist()):
            at = d[a:b]
            x, usual = v[at], u[at]
            candidate, known = hampel(x, usual, longest)
            rest = np.flatnonzero(~known & ((state[at] == -1) | (state[at] == 2)))
            candidate[rest] = hampel_at_ends(x, rest, u[0], longest)
            candidate = np.where((state[at] == 0) | (state[at] == 1), state[at] == 1, candidate)
            spike = confirmed(x, candidate, usual, jump, longest)
            flag[at[spike & open_[at]]] = SPIKE
        return flag

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["src", "fld", "t", "s", "v"]
        one = ("src", "fld", "day")

        def work(table):
            bounds = [*np.flatnonzero(changes(table, one)).tolist(), table.num_rows]
            flag = np.concatenate([judge(table.slice(a, b - a).combine_chunks()) for a, b in zip(bounds[:-1], bounds[1:])])
            at = np.flatnonzero(flag > 0)
            out = table.select(names).take(pa.array(at)).append_column("flag", pa.array(flag[at].astype(np.int32)))
            yield from out.to_batches()

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            # what a slice's inside has settled is passed on; only edges wait for their date
            settled = table.filter(pc.invert(table.column("edge")))
            if settled.num_rows:
                yield from settled.select([*names, "flag"]).to_batches()
            table = table.filter(table.column("edge"))
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            if not table.num_rows:
                continue
            last = int(np.flatnonzero(changes(table, one))[-1])
            if last:
                yield from work(table.slice(0, last).combine_chunks())
            rest = table.slice(last).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return run


def usual_values(rows: DataFrame, levels: int, fields: int, others: Sequence[str], flush: int | None) -> DataFrame:
    """``src, fld, usual``: the exact median of what is usual. For a level field, of the absolute changes
    of a tick or more between neighbours within a date; for a size field, of the readings."""
    by = ["src", "fld", "day", "slice", "sub", "unit", "x", "z"]
    # counts per distinct value, and a row per slice
    counted = rows.mapInArrow(_count_pass(levels, fields, others, flush), _COUNTS).groupBy(*by).agg(F.sum("n").alias("n"))
    # the ends of slices (count 0) become the changes between slices, in one pass over the counts; a count of a
    # value stays as it is, in a partition of its own
    end = F.col("n") == 0
    order = Window.partitionBy("src", "fld", "day", F.when(~end, F.col("x"))).orderBy("slice", "sub")
    step = F.abs(F.col("x") - F.lag("z").over(order))
    x = F.when(~end, F.col("x")).when(F.col("unit").isNull(), F.col("step")).otherwise(F.round(F.col("step") / F.col("unit"), 3))
    both = counted.withColumn("step", step).where(~end | ((F.col("step") > 0) & (F.col("unit").isNull() | (F.col("step") >= F.col("unit") * (1 - 1e-6)))))
    both = both.select("src", "fld", "unit", x.alias("x"), F.greatest("n", F.lit(1)).cast("bigint").alias("n"))
    # ranges of values, a thousandth of a doubling wide: the median's is found from the counts of the ranges
    counts = both.groupBy("src", "fld", "unit", "x").agg(F.sum("n").alias("n")).withColumn("range", F.floor(F.log2("x") * 1024))
    of = Window.partitionBy("src", "fld")
    ranges = counts.groupBy("src", "fld", "range").agg(F.sum("n").alias("m"))
    ranges = ranges.withColumns({"before": F.coalesce(F.sum("m").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("m").over(of)})
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    holds = lambda rank: (F.col("before") < rank) & (rank <= F.col("before") + F.col("m"))
    ranges = ranges.where(holds(low) | holds(high)).select("src", "fld", "range", "before", low.alias("low"), high.alias("high"))
    inside = Window.partitionBy("src", "fld", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(ranges, ["src", "fld", "range"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    at = lambda rank: F.min(F.when(F.col("upto") >= F.col(rank), F.col("x")))
    return ranked.groupBy("src", "fld").agg(((at("low") + at("high")) / 2 * F.coalesce(F.first("unit"), F.lit(1.0))).alias("usual"))


def flag_readings(
    df: DataFrame, *, table: str, source: str, time: str, seq: str, levels: Sequence[str] = (), sizes: Sequence[str] = (),
    ticks: DataFrame, stuck: int = 25, jump: float = 12, longest: int = 3, burst: float = 25, slice_seconds: int = 7200,
    flush: int | None = None, few_sources: int = FEW_SOURCES,
) -> DataFrame:
    """``tbl, seq, field, source, time, value, reason`` of every flagged reading. ``ticks`` has ``src`` and
    ``tick``, one row per source. A slice of more than ``flush`` rows is cut further. What belongs to sources is
    sent to the tasks, after the exchange, if there are at most ``few_sources``; beyond, it is joined before."""
    fields = [*levels, *sizes]
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    others = [c for n, c in place.items() if n not in (source, time, seq)]  # tell copies, with source and time
    raw = df.toDF(*place.values()).where(F.col(place[source]).isNotNull() & F.col(place[time]).isNotNull())
    raw = raw.select(
        F.col(place[source]).alias("src"), F.to_date(place[time]).alias("day"), clock_slice(F.col(place[time]), slice_seconds).alias("slice"), F.col(place[time]).alias("t"), F.col(place[seq]).alias("s"),
        *[F.col(place[f]).cast("double").alias(f"v{i}") for i, f in enumerate(fields)], *others,
    )
    few = has_at_most(ticks, few_sources) and has_at_most(raw.select("src").distinct(), few_sources)
    shared = raw.repartition(*_GROUP)  # read by both passes where what they need is joined after it

    def in_slices(side: DataFrame, columns: dict[str, Column]) -> DataFrame:
        if few:
            rows = shared.join(F.broadcast(side), F.col("src") == F.col("of_src"), "left")
        else:  # joined before the exchange, since a join by shuffle could split a slice among tasks
            rows = raw.join(side, F.col("src") == F.col("of_src"), "left").repartition(*_GROUP)
        return rows.withColumns(columns).drop("of_src").sortWithinPartitions(*_GROUP, "t", "s")

    of_source = ticks.select(F.col("src").alias("of_src"), F.col("tick").cast("double").alias("tick"))
    usual = usual_values(in_slices(of_source, {"tick": F.coalesce("tick", F.lit(0.0))}), len(levels), len(fields), others, flush)
    per_source = usual.groupBy(F.col("src").alias("of_src")).agg(*[F.max(F.when(F.col("fld") == i, F.col("usual"))).alias(f"u{i}") for i in range(len(fields))])
    known = in_slices(per_source if few else durable(per_source), {f"u{i}": F.coalesce(f"u{i}", F.lit(0.0)) for i in range(len(fields))})
    rules = {"jump": jump, "longest": longest, "burst": burst, "stuck": stuck}
    first = known.mapInArrow(_flag_pass(len(levels), len(fields), others, rules, flush), _EDGE)
    meet = first.withColumn("part", F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("slice")))
    meet = meet.repartition("src", "fld", "day", "part").sortWithinPartitions("src", "fld", "day", "part", "slice", "sub", "t", "s")
    last = meet.mapInArrow(_seam_pass(len(levels), rules), _LAST)
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("fld") + 1)
    reason = F.element_at(F.array(*map(F.lit, ("impossible", "frozen", "spike"))), F.col("flag"))
    return last.select(F.lit(table).alias("tbl"), F.col("s").alias("seq"), name.alias("field"), F.col("src").alias("source"), F.col("t").alias("time"), F.col("v").alias("value"), reason.alias("reason"))
