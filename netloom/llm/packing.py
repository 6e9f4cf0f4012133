"""Best-fit-decreasing packing of whole documents into token sequences.

Items of one length are interchangeable, so best fit decreasing needs only how many items there
are of each length: at most ``capacity`` counts, whatever the corpus. The plan is made from them
with a segment tree over remaining capacities that finds the tightest open bin in logarithmic
time; bins of equal history are handled as one range, so the plan holds a few rows per length.
Spark numbers the pieces of each length (position in their task plus a prefix sum over tasks) and
a join with the plan turns the number into a sequence and an offset. The result is exactly the
packing that best fit decreasing makes when it sees all items in one list.

Defined results: a null or empty text is the single end id. Only documents longer than the
capacity are cut, from the end: all pieces but the first are full. Repeated rows are packed each.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import materialize
from netloom.llm.tokens import encoder, vocabulary

CAPACITY = 2048
PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint, "
          "ids binary")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """The token pieces of every document; ``nth`` numbers the pieces of a length in their task."""
    path = path or vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(path).encode, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                start, length = 0, (n % capacity or capacity) if n > capacity else n
                piece = 0
                while start < n:
                    own = ids[4 * start:4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(own), part, seen[length], own if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
                    seen[length] += 1
                    piece, start, length = piece + 1, start + length, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


class OpenBins:
    """Ranges of equal bins by remaining capacity, under a segment tree of their presence."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            self.ranges.setdefault(remaining, []).append((first, count))
            self._set(remaining, 1)

    def take(self, remaining: int) -> tuple[int, int]:
        own = self.ranges[remaining]
        got = own.pop()
        if not own:
            self._set(remaining, 0)
        return got

    def _set(self, at: int, value: int) -> None:
        at += self.size
        self.tree[at] = value
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``need``."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:  # up to the first right sibling that holds an open bin
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first bin, items per bin, offset of the first item)."""
    bins, rows, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, todo = 0, counts[length]
        while todo:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                first, count = made, -(-todo // (capacity // length))
                made += count
            else:
                first, count = bins.take(room)
            each = room // length
            full = min(count, todo // each)
            if not full:  # what is left fills part of one bin
                each, full = todo, 1
            rows.append((length, done, done + full * each, first, each, capacity - room))
            bins.add(room - each * length, first, full)
            if room < capacity:
                bins.add(room, first + full, count - full)
            else:  # the last bin of a length is opened only when its turn comes
                made -= count - full
            done, todo = done + full * each, todo - full * each
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0,
         with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request)."""
    spark = docs.sparkSession
    stored = materialize(pieces(docs, capacity, path, end_id, with_ids), "pieces")
    per_task = stored.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = per_task.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = materialize(counts, "lengths")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = spark.createDataFrame(plan(totals, capacity), "plan_length bigint, lo bigint, hi bigint, first bigint, "
                                                          "each bigint, at bigint")
    # The counts grow with the number of tasks: no broadcast for them.
    placed = stored.join(counts.drop("n").hint("merge"), ["length", "part"]).withColumn("number", F.col("nth") + F.col("before"))
    inside = (F.col("length") == F.col("plan_length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))
    # The plan has a few rows per length, so at most a few times `capacity` rows.
    out = placed.join(F.broadcast(table), inside)
    j = F.col("number") - F.col("lo")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.expr("(number - lo) div each")).alias(
        "sequence_id"), (F.col("at") + j % F.col("each") * F.col("length")).alias("offset")]
    return out.select(*columns, *(["ids"] if with_ids else []))
