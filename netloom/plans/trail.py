"""Trailing windows of one group of any size, a part of its rows at a time.

The rows before the ones at hand wait in blocks. Of these only the oldest, whose rows are about to leave
the windows, is held as columns. The blocks between belong to every window as a whole, and what the windows
need of them is known without their rows: sums and centred moments of each block, the rows of each
value (28 bytes a value), and the distinct sizes with their rows (12 bytes each). The rows themselves wait in
temporary files. So memory grows with the distinct values of a window, not with its rows.
"""

from __future__ import annotations

import secrets
import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pandas.util import hash_array

#: Rows of a part and of a block that is put aside, and values that are looked at together.
BLOCK = 32_768
#: A temporary file takes blocks up to this size; it goes with the last of them.
FILE_BYTES = 64 << 20


class Spool:
    """Columns put aside on local disk, and taken back once."""

    def __init__(self) -> None:
        self.file = None

    def put(self, columns: dict[str, np.ndarray]) -> tuple:
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))
        packed, made = pa.ipc.IpcWriteOptions(compression="lz4" if pa.Codec.is_available("lz4") else None), pa.BufferOutputStream()
        with pa.ipc.new_stream(made, batch.schema, options=packed) as out:
            out.write_batch(batch)
        if self.file is None or self.file.seek(0, 2) > FILE_BYTES:
            self.file = tempfile.TemporaryFile()
        first = self.file.tell()
        return self.file, first, self.file.write(made.getvalue())

    @staticmethod
    def take(place: tuple) -> dict[str, np.ndarray]:
        file, first, length = place
        file.seek(first)
        batch = pa.ipc.open_stream(pa.py_buffer(file.read(length))).read_next_batch()
        return {c: x.to_numpy(zero_copy_only=False) for c, x in zip(batch.schema.names, batch.columns)}


class Sizes:
    """Distinct values of the rows in the middle, in order, and how many rows have each."""

    def __init__(self) -> None:
        self.values, self.rows = np.empty(0), np.empty(0, np.int32)

    def add(self, x: np.ndarray, sign: int) -> None:
        own, n = np.unique(x.astype(np.float64), return_counts=True)
        at = np.searchsorted(self.values, own)
        there = np.searchsorted(self.values, own, "right") > at
        self.rows[at[there]] += (sign * n[there]).astype(np.int32)
        if not there.all():
            self.values = np.insert(self.values, at[~there], own[~there])
            self.rows = np.insert(self.rows, at[~there], n[~there])
        elif sign < 0:
            left = self.rows > 0
            if 2 * np.count_nonzero(left) <= len(left):
                self.values, self.rows = self.values[left], self.rows[left]

    def below(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the values below each mean."""
        at = np.searchsorted(self.values, mean)
        order = np.argsort(at, kind="stable")
        ranks = at[order]
        rows, under = np.zeros(len(mean), np.int64), np.zeros(len(mean))
        n, total = 0, np.longdouble(0)
        for first in range(0, len(self.values), BLOCK):
            count = self.rows[first:first + BLOCK].astype(np.int64)
            upto = n + np.cumsum(count)
            sums = total + np.cumsum(self.values[first:first + BLOCK] * count, dtype=np.longdouble)
            low, high = np.searchsorted(ranks, (first, first + len(count)), "right")
            own, place = order[low:high], ranks[low:high] - first - 1
            rows[own], under[own] = upto[place], sums[place].astype(np.float64)
            n, total = upto[-1], sums[-1]
        return rows, under


class Codes:
    """Numbers of the values of a column; 0 is no value. Those of values that are gone are used again.

    Texts are known by two 64-bit hashes with keys of this object: 28 bytes a value, whatever its length.
    """

    def __init__(self) -> None:
        self.hashes, self.checks, self.codes = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.free = np.empty(0, np.int32)
        #: Rows in the middle with each number.
        self.rows = np.zeros(1, np.int64)
        self.most = BLOCK
        self.keys = [secrets.token_hex(8) for _ in range(2)]

    def _hashed(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if pa.types.is_integer(values.type):
            own = values.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
            return own, np.zeros(len(own), np.uint64)
        texts = values.cast(pa.string()).to_numpy(zero_copy_only=False)
        first, second = (hash_array(texts, hash_key=key, categorize=False) for key in self.keys)
        return first, second

    def number(self, column: pa.DictionaryArray) -> np.ndarray:
        places = column.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
        look = np.zeros(len(column.dictionary) + 1, np.int32)
        used = np.unique(places)
        used = used[used > 0]
        if not len(used):
            return look[places]
        hashes, checks = self._hashed(column.dictionary.take(pa.array(used - 1)))
        order = np.argsort(hashes)
        used, hashes, checks = used[order], hashes[order], checks[order]
        at = np.searchsorted(self.hashes, hashes)
        there = np.searchsorted(self.hashes, hashes, "right") > at
        if (hashes[1:] == hashes[:-1]).any() or (self.checks[at[there]] != checks[there]).any():
            raise ValueError("two values share a hash; another try takes other keys")
        fresh = ~there
        n, known = np.count_nonzero(fresh), len(self.hashes) + len(self.free)
        codes = np.concatenate((self.free[:n], np.arange(known + 1, known + 1 + n - len(self.free[:n]), dtype=np.int32)))
        self.free = self.free[n:]
        look[used[there]], look[used[fresh]] = self.codes[at[there]], codes
        self.hashes, self.checks, self.codes = (np.insert(x, at[fresh], y) for x, y in (
            (self.hashes, hashes[fresh]), (self.checks, checks[fresh]), (self.codes, codes)))
        if len(self.hashes) + len(self.free) >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros(len(self.hashes) // 2 + n, np.int64)))
        return look[places]

    def add(self, codes: np.ndarray, sign: int) -> None:
        own, n = np.unique(codes, return_counts=True)
        self.rows[own] += sign * n

    def forget(self, held: list[np.ndarray]) -> None:
        """Values without a row in the middle or in ``held`` go, once they may be most of all."""
        if len(self.hashes) < self.most:
            return
        live = self.rows > 0
        for codes in held:
            live[codes] = True
        left = live[self.codes]
        self.free = np.concatenate((self.free, self.codes[~left]))
        self.hashes, self.checks, self.codes = self.hashes[left], self.checks[left], self.codes[left]
        self.most = max(BLOCK, 2 * len(self.hashes))


@dataclass
class Middle:
    """What is known of rows that belong to every window."""

    n: int = 0
    sums: dict[str, float] = field(default_factory=dict)
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)
    sizes: Sizes | None = None
    codes: dict[str, Codes] = field(default_factory=dict)

    def total(self, name: str) -> float:
        return self.sums.get(name, 0.0)

    def squares(self, name: str, mean: np.ndarray) -> np.ndarray | float:
        """Sum of (x - mean)^2."""
        if not self.n:
            return 0.0
        own, moment = self.moments[name]
        return moment + self.n * (own - mean) ** 2

    def rows_of(self, name: str) -> np.ndarray | None:
        return self.codes[name].rows if self.n else None


NOTHING = Middle()


class Block:
    """Neighbouring rows as columns. ``columns`` is None while they are put aside."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.columns, self.place = columns, None
        self.n = len(columns["_ms"])
        self.last = int(columns["_ms"][-1])

    def cut(self, first: int, last: int) -> Block:
        return Block({c: x[first:last] for c, x in self.columns.items()})

    def measure(self, sums: list[str], moments: list[str]) -> None:
        self.sums = np.array([self.columns[c].sum(dtype=np.longdouble) for c in sums])
        found = []
        for c in moments:
            x = self.columns[c].astype(np.float64)
            found.append((x.mean(), ((x - x.mean()) ** 2).sum()))
        self.moments = np.array(found)


class Near:
    """Columns of blocks that follow each other as one, joined when they are asked for."""

    def __init__(self, *blocks: Block) -> None:
        self.blocks = blocks

    def __getitem__(self, name: str) -> np.ndarray:
        return np.concatenate([b.columns[name] for b in self.blocks])


class Trail:
    """The rows of a group that windows can still reach back to, as a queue of blocks.

    ``kinds`` are the columns whose values are counted, ``step`` is the one of them whose changes from row to
    row are, ``numbers`` those that are summed, ``size`` and ``spread`` those whose deviations are asked for.
    Columns made here: ``_ms``, ``_gap`` (seconds since the row before) and ``_moved`` (0 or 1).
    """

    def __init__(self, ms: str, horizon_ms: int, limit: int | None, kinds: list[str], step: str, numbers: list[str], size: str,
                 spread: str) -> None:
        self.ms, self.horizon, self.limit, self.step, self.size = ms, int(horizon_ms), limit, step, size
        self.numbers, self.sums, self.moments = numbers, [*numbers, "_moved"], [spread, "_gap"]
        self.codes = {c: Codes() for c in kinds}
        self.sizes, self.spool = Sizes(), Spool()
        self.blocks: deque[Block] = deque()
        self.before: tuple[int, int] | None = None  # time and step of the newest row

    def _block(self, table: pa.Table) -> Block:
        columns = {"_ms": table.column(self.ms).to_numpy()}
        for c in self.numbers:
            columns[c] = table.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        for c, codes in self.codes.items():
            codes.forget([self.blocks[0].columns[c]] if self.blocks else [])
            column = table.column(c).combine_chunks()
            columns[c] = codes.number(column if pa.types.is_dictionary(column.type) else column.dictionary_encode())
        ms, step = columns["_ms"], columns[self.step]
        at, of = self.before or (ms[0], step[0])
        columns["_gap"] = np.diff(ms, prepend=at) / 1000.0
        columns["_moved"] = (np.diff(step, prepend=of) != 0).astype(np.int8)
        self.before = int(ms[-1]), int(step[-1])
        return Block(columns)

    def _count(self, block: Block, sign: int) -> None:
        """Rows come to the middle, or leave it."""
        self.sizes.add(block.columns[self.size], sign)
        for c, codes in self.codes.items():
            codes.add(block.columns[c], sign)

    def _push(self, block: Block) -> None:
        if self.blocks:
            self._count(block, 1)
        newest = self.blocks[-1] if len(self.blocks) > 1 else None
        if newest is not None and newest.n < BLOCK // 2:
            both = Near(newest, block)
            block = Block({c: both[c] for c in block.columns})
            self.blocks.pop()
        elif newest is not None:
            newest.place, newest.columns = self.spool.put(newest.columns), None
        block.measure(self.sums, self.moments)
        self.blocks.append(block)

    def _drop(self, ms: int) -> None:
        """The oldest blocks go, until the last row of the oldest is in the window of the next row."""
        while self.blocks:
            rest = sum(b.n for b in self.blocks) - self.blocks[0].n
            if self.blocks[0].last >= ms - self.horizon and (self.limit is None or rest + 2 <= self.limit):
                return
            self.blocks.popleft()
            if self.blocks:
                front = self.blocks[0]
                if front.columns is None:
                    front.columns, front.place = self.spool.take(front.place), None
                self._count(front, -1)

    def _middle(self) -> Middle:
        blocks = [b for i, b in enumerate(self.blocks) if i]
        if not blocks:
            return NOTHING
        rows = np.array([b.n for b in blocks], np.float64)
        sums = np.sum([b.sums for b in blocks], axis=0)
        means, own = (np.array([b.moments[:, i] for b in blocks]) for i in (0, 1))
        mean = (rows[:, None] * means).sum(0) / rows.sum()
        moment = own.sum(0) + (rows[:, None] * (means - mean) ** 2).sum(0)
        return Middle(int(rows.sum()), dict(zip(self.sums, sums.astype(np.float64).tolist())),
                      {c: (mean[i], moment[i]) for i, c in enumerate(self.moments)}, self.sizes, self.codes)

    def add(self, table: pa.Table, wanted: Callable[[slice, np.ndarray], np.ndarray] | None) -> Iterator[tuple]:
        """The next rows of the group. ``wanted`` gets some of them (as a slice) and the rows of their windows, and
        says which windows are asked for; None asks for none.

        Yields the places of such rows in the table, the columns of the oldest block and the part at hand as one, the
        start of the window of each of their rows, the places of the asked ones, and the Middle between both.
        """
        block, at = self._block(table), 0
        while at < block.n:
            end = block.n
            if wanted is not None:
                ms = block.columns["_ms"]
                self._drop(int(ms[at]))
                middle = self._middle()
                if middle.n:  # as far as windows begin in the oldest block
                    end = int(np.searchsorted(ms, self.blocks[0].last + self.horizon, "right"))
                    end = end if self.limit is None else min(end, at + self.limit - middle.n - 1)
                part = block.cut(at, end) if end - at < block.n else block
                near, first = Near(part), 0
                if self.blocks:
                    front = self.blocks[0]
                    begin = int(np.searchsorted(front.columns["_ms"], ms[at] - self.horizon))
                    near, first = Near(front.cut(begin, front.n), part), front.n - begin
                low = np.zeros(first + part.n, np.int64)
                low[first:] = np.searchsorted(near["_ms"], ms[at:end] - self.horizon)
                place = np.arange(len(low))
                if self.limit is not None:
                    low[first:] = np.maximum(low[first:], place[first:] + middle.n - (self.limit - 1))
                asked = np.flatnonzero(wanted(slice(at, end), (place - low)[first:] + 1 + middle.n))
                if len(asked):
                    yield at + asked, near, low, first + asked, middle
            else:
                part = block
            self._push(part)
            at = end
