"""Trailing windows of every row over time panes, with no limit on the rows of a window.

Rows are dealt to tasks by (key, pane). A pane is several horizons long, and the rows of the last
horizon before it come along, so a key of any size is spread over its panes and a task holds the
rows of one pane and one horizon as plain columns. Everything else is linear in these rows, or
nearly so: sums are differences of extended-precision prefix sums, distinct values are counted by
the interval in which each row is its value's last, the most frequent value by a tally of counts,
squared deviations from a window's own mean by blocks with mergeable centred moments, and absolute
ones by the values below the mean. None of it grows with the rows of a window beyond their logarithm.
A pane of many rows comes in parts, and is never held as a whole (``plans/trail.py``).
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.ordered import first_rows
from netloom.plans.trail import NOTHING, Middle
from netloom.session import materialize

#: A pane is so many horizons long.
HORIZONS = 4
#: Small groups are handled together up to this many rows.
TOGETHER = 65_536


def dealt(df: DataFrame, keys: list[str], ms: str, order: list[str], horizon_ms: int) -> DataFrame:
    """Rows sorted by (keys, _pane, order); rows of the pane before, needed only to look back, are ``_halo``."""
    length = HORIZONS * int(horizon_ms)
    pane = F.floor(F.col(ms) / F.lit(length)).cast("bigint")
    last = F.floor((F.col(ms) + F.lit(int(horizon_ms))) / F.lit(length)).cast("bigint")
    rows = df.withColumn("_home", pane).withColumn("_pane", F.explode(F.sequence(pane, last)))
    rows = rows.withColumn("_halo", F.col("_pane") != F.col("_home")).drop("_home")
    return rows.repartition(*keys, "_pane").sortWithinPartitions(*keys, "_pane", *order)


def _changes(table: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Places after which a row belongs to another group."""
    out = np.zeros(max(0, len(table) - 1), bool)
    for name in names:
        column = table.column(name)
        codes = (column if pa.types.is_dictionary(column.type) else column.dictionary_encode()).indices.fill_null(-1).to_numpy()
        out |= codes[1:] != codes[:-1]
    return np.flatnonzero(out)


def compact(batch: pa.RecordBatch, numbers: list[str]) -> pa.RecordBatch:
    """The same rows in less space: texts as dictionaries, ``numbers`` (nulls count as 0) in the smallest type that holds them."""
    columns = []
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_string(column.type):
            column = column.dictionary_encode()
        elif name in numbers:
            x = column.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = x.min(), x.max()
            types = [t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max]
            with np.errstate(over="ignore", invalid="ignore"):
                for t in [*types[:1], np.float32]:
                    small = x.astype(t)
                    if (small == x).all():
                        x = small
                        break
            column = pa.array(x)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def joined(batches: list[pa.RecordBatch]) -> pa.Table:
    """Compact batches as one table; a column takes the smallest type that holds all of them."""
    columns = []
    for i in range(batches[0].num_columns):
        parts = [b.column(i) for b in batches]
        types = {c.type for c in parts}
        if len(types) > 1 and not pa.types.is_dictionary(parts[0].type):
            wide = pa.from_numpy_dtype(np.result_type(*[t.to_pandas_dtype() for t in types]))
            parts = [c.cast(wide) for c in parts]
        columns.append(pa.chunked_array(parts).unify_dictionaries().combine_chunks())
    return pa.Table.from_arrays(columns, names=batches[0].schema.names)


def groups(batches: Iterator[pa.RecordBatch], names: list[str], numbers: list[str] = (),
           together: int = TOGETHER, parts: bool = False) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (neighbouring rows that agree in ``names``) and the number of each row's group.

    Rows are held compactly (see ``compact``) and each batch is looked at once. With ``parts`` a group of
    at least ``together`` rows comes in several tables of its own; in those after the first its number is 0.
    """
    held: list[pa.RecordBatch] = []
    fresh: list[np.ndarray] = []
    last, parted = None, False

    def taken() -> tuple[pa.Table, np.ndarray]:
        found = joined(held), np.cumsum(np.concatenate(fresh), dtype=np.int32)
        held.clear(), fresh.clear()
        return found

    for batch in batches:
        if not len(batch):
            continue
        small = compact(batch, numbers)
        first, new = tuple(batch.column(n)[0].as_py() for n in names), np.zeros(len(batch), np.int8)
        new[_changes(small, names) + 1] = 1
        new[0] = first != last
        last = tuple(batch.column(n)[len(batch) - 1].as_py() for n in names)
        cuts = np.flatnonzero(new)
        if len(cuts) and parted:  # the last rows of a group that came in parts
            end, parted = int(cuts[0]), False
            if end:
                held.append(small.slice(0, end)), fresh.append(new[:end])
            if held:
                yield taken()
            small, new, cuts = small.slice(end), new[end:], cuts - end
        ready = sum(map(len, held)) + len(small) >= together
        if len(cuts) and ready and (held or (parts and cuts[-1])):
            end = int(cuts[-1])
            if end:
                held.append(small.slice(0, end)), fresh.append(new[:end])
            yield taken()
            small, new = small.slice(end), new[end:]
        held.append(small), fresh.append(new)
        if parts and sum(map(len, held)) >= together:
            # Whole groups before the open one are fewer than ``together`` rows, and a table of their own.
            begin = 0 if parted else int(np.flatnonzero(np.concatenate(fresh))[-1])
            rest: list[tuple] = []
            while begin and sum(map(len, held)) > begin:
                a, b = held.pop(), fresh.pop()
                keep = max(0, begin - sum(map(len, held)))
                rest.insert(0, (a.slice(keep), b[keep:]))
                if keep:
                    held.append(a.slice(0, keep)), fresh.append(b[:keep])
            if begin:
                yield taken()
                held.extend(a for a, _ in rest), fresh.extend(b for _, b in rest)
            if sum(map(len, held)) >= together:
                yield taken()
                parted = True
    if held:
        yield taken()


def starts(group: np.ndarray, ms: np.ndarray, horizon_ms: int, limit: int | None = None) -> np.ndarray:
    """Place of the first row of each row's window; the window ends with the row itself."""
    span = int(ms.max() - ms.min()) + int(horizon_ms) + 1
    line = group.astype(np.int64) * span + (ms - ms.min())
    low = np.searchsorted(line, line - int(horizon_ms), "left")
    return low if limit is None else np.maximum(low, np.arange(len(low)) - (limit - 1))


def totals(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums over [low, high]."""
    upto = np.concatenate((np.zeros(1, np.longdouble), np.cumsum(x, dtype=np.longdouble)))
    return (upto[high + 1] - upto[low]).astype(np.float64)


def kinds(codes: np.ndarray, low: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Distinct values in the window of every row. A row counts while it is the last of its value.

    ``more`` are rows of each code that every window has besides: those values count always, and once.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    later = np.full(n, n)
    same = codes[order[1:]] == codes[order[:-1]]
    later[order[:-1][same]] = order[1:][same]
    leaves = np.searchsorted(low, np.arange(n), "right")  # first row whose window starts behind this one
    until = np.minimum(later, leaves)
    if more is None:
        return np.arange(1, n + 1) - np.cumsum(np.bincount(until, minlength=n + 1))[:n]
    own = more[codes] == 0
    return np.cumsum(own) - np.cumsum(np.bincount(until[own], minlength=n + 1))[:n] + np.count_nonzero(more)


def largest(codes: np.ndarray, low: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Rows of the most frequent value in the window of every row; ``more``: rows of each code that every window has besides."""
    if more is not None:
        seen, codes = np.unique(codes, return_inverse=True)
        others = more.copy()
        others[seen] = 0
        counts = more[seen].tolist()
        tally: dict | list = defaultdict(int, Counter(counts))
        best, at = max(counts), 0
    else:
        width = int((np.arange(len(low)) - low).max()) + 2
        counts, tally, best, at = [0] * (int(codes.max()) + 1), [0] * (width + 1), 0, 0
    values, out = array("q", codes.astype(np.int64).tobytes()), np.empty(len(low), np.int32 if more is None else np.int64)
    for first in range(0, len(low), TOGETHER):
        block = slice(first, first + TOGETHER)
        found = []
        for value, start in zip(values[block], low[block].tolist()):
            while at < start:
                old = values[at]
                n = counts[old]
                counts[old] = n - 1
                tally[n] -= 1
                tally[n - 1] += 1
                if n == best and not tally[n]:
                    best = n - 1
                at += 1
            n = counts[value] + 1
            counts[value] = n
            tally[n - 1] -= 1
            tally[n] += 1
            if n > best:
                best = n
            found.append(best)
        out[block] = found
    return out if more is None else np.maximum(out, others.max())


def squares(x: np.ndarray, low: np.ndarray, high: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sum of (x - mean)^2 over [low, high]; an empty range gives 0.

    A range is made of blocks of 1, 2, 4 ... rows, at most two of a size, whose centred moments merge.
    """
    out, begin, end = np.zeros(len(low)), low.astype(np.int64), np.maximum(high + 1, low).astype(np.int64)
    middle, moment, size = x.astype(np.float64), np.zeros(len(x)), 1
    while len(middle):
        todo = begin < end
        if not todo.any():
            break
        for odd, at in (((begin & 1 == 1) & todo, begin), ((end & 1 == 1) & todo, end - 1)):
            own = np.flatnonzero(odd)
            block = at[own]
            out[own] += moment[block] + size * (middle[block] - mean[own]) ** 2
        begin, end = (begin + 1) >> 1, end >> 1
        pairs = len(middle) // 2 * 2  # a block that is not whole is never asked for
        left, right = middle[0:pairs:2], middle[1:pairs:2]
        moment = moment[0:pairs:2] + moment[1:pairs:2] + size / 2 * (left - right) ** 2
        middle, size = (left + right) / 2, size * 2
    return out


def distances(x: np.ndarray, low: np.ndarray, high: np.ndarray, mean: np.ndarray, more: Middle = NOTHING, name: str = "") -> np.ndarray:
    """Sum of |x - mean| over [low, high] and ``more``, by the number and sum of the values below the mean.

    Rows are dealt to two halves by each bit of their value's rank, from the highest on, and a range
    is followed into the half its mean lies in: a few look-ups per bit, whatever the range holds.
    """
    values, ranks = np.unique(x, return_inverse=True)
    ranks, own = ranks.astype(np.int32), x.astype(np.float64)
    at = np.searchsorted(values, mean).astype(np.int32)  # so many values are below the mean
    begin, end = low.astype(np.int32), np.maximum(high + 1, low).astype(np.int32)
    rows = (end - begin).astype(np.int64)
    below, under = np.zeros(len(low), np.int64), np.zeros(len(low))
    for bit in range(int(len(values)).bit_length() - 1, -1, -1):
        zero = (ranks >> bit) & 1 == 0
        upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(zero, dtype=np.int32)))
        ranks, own = (np.concatenate((c[zero], c[~zero])) for c in (ranks, own))
        sums = np.concatenate((np.zeros(1, np.longdouble), np.cumsum(own[:upto[-1]], dtype=np.longdouble)))
        b, e = upto[begin], upto[end]
        one = np.flatnonzero((at >> bit) & 1)
        below[one] += e[one] - b[one]
        under[one] += (sums[e[one]] - sums[b[one]]).astype(np.float64)
        after = upto[-1]
        b[one], e[one] = after + begin[one] - b[one], after + end[one] - e[one]
        begin, end = b, e
    whole = totals(x, low, np.maximum(high, low - 1))
    if more.n:
        besides, sums = more.sizes.below(mean)
        below, under, rows, whole = below + besides, under + sums, rows + more.n, whole + more.total(name)
    return np.maximum(mean * (2 * below - rows) + whole - 2 * under, 0.0)


def with_history(df: DataFrame, keys: list[str], ms: str, order: list[str], reach: int, pane_ms: int,
                 build: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Run ``build(df, keys)``, whose windows look at most ``reach`` rows back, for keys of any size.

    Rows are dealt by (key, pane); each pane also gets the last ``reach`` rows before it, found
    from the last rows of the panes, and returns its own rows only.
    """
    rows = materialize(df.withColumn("_pane", F.floor(F.col(ms) / F.lit(int(pane_ms))).cast("bigint")), "panes")
    cell = [*keys, "_pane"]
    newest = [F.desc(c) for c in order]
    tails = first_rows(rows, cell, newest, reach).withColumn("_age", F.row_number().over(Window.partitionBy(*cell).orderBy(*newest)))
    along = Window.partitionBy(*keys).orderBy("_pane")
    ahead = along.rowsBetween(1, reach)
    held = rows.groupBy(*cell).agg(F.least(F.count(F.lit(1)), F.lit(reach)).alias("_n"))
    held = held.select(*[F.col(c).alias(f"_of_{c}") for c in cell], F.collect_list(F.struct("_pane", "_n")).over(ahead).alias("_next"))
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    # The i-th pane after this one needs a row if the panes between hold too few.
    between = lambda i: F.aggregate(F.slice("_next", 1, i), F.lit(0).cast("bigint"), lambda acc, x: acc + x["_n"])
    wanted = F.filter(F.transform("_next", lambda x, i: F.when(F.col("_age") + between(i) <= reach, x["_pane"])), lambda p: p.isNotNull())
    early = tails.join(held, same).withColumn("_pane", F.explode(wanted)).select(*rows.columns, F.lit(True).alias("_early"))
    both = rows.withColumn("_early", F.lit(False)).unionByName(early)
    return build(both, cell).filter("NOT _early").drop("_pane", "_early")

