"""What the passes over sorted Arrow batches share: groups, copies, slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

FLUSH = 200_000


def changes(table, names: Sequence[str]) -> np.ndarray:
    """True at every row that differs from the row before in ``names``; the first row is True. Null equals
    null only, NaN equals NaN."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        col = table.column(name)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if len(col) > 1:
            a, b = col.slice(1), col.slice(0, len(col) - 1)
            unequal = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), False, pc.fill_null(pc.not_equal(a, b), True))
            if pa.types.is_floating(col.type):
                unequal = pc.and_(unequal, pc.invert(pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))))
            out[1:] |= unequal.to_numpy(zero_copy_only=False)
    return out


def without_copies(table, group: Sequence[str], others: Sequence[str]):
    """Of rows equal in ``group``, ``t`` and ``others``, the first; copies have equal times and so are near
    each other in a table sorted by group, ``t`` and ``s``."""
    import pyarrow as pa

    t = table.column("t").cast("int64").to_numpy()
    tied = np.zeros(len(t), bool)
    tied[1:] = (t[1:] == t[:-1]) & ~changes(table, group)[1:]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if not len(at):
        return table
    rows = zip(*[table.column(c).take(pa.array(at)).to_pylist() for c in (*group, "t", *others)])
    seen, drop = set(), []
    for i, row in zip(at.tolist(), rows):
        row = tuple("nan" if v != v else tuple(v) if isinstance(v, list) else v for v in row)
        if row in seen:
            drop.append(i)
        seen.add(row)
    return table.take(pa.array(np.delete(np.arange(len(t)), drop))) if drop else table


def stretches(batches: Iterator, group: Sequence[str], others: Sequence[str], flush: int | None = None) -> Iterator:
    """Sorted batches as ``(table, [(first, end, number)])``, one entry per group without its copies. A group
    of more than ``flush`` rows comes in several, cut between two times and numbered from 0."""
    import pyarrow as pa

    flush = flush or FLUSH
    rest, number = None, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        table = without_copies(table.combine_chunks(), group, others).combine_chunks()
        starts = np.flatnonzero(changes(table, group)).tolist()
        found = []
        for a, b in zip(starts[:-1], starts[1:]):
            found.append((a, b, number))
            number = 0
        last = starts[-1]
        if table.num_rows - last > flush:
            t = table.column("t").cast("int64").to_numpy()
            cut = last + int(np.searchsorted(t[last:], t[-1]))  # copies of the last time may still follow
            if cut > last:
                found.append((last, cut, number))
                number, last = number + 1, cut
        if found:
            yield table.slice(0, last).combine_chunks(), found
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), [(0, rest.num_rows, number)]
