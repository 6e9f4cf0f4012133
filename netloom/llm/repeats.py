"""Removal of repeated 100-byte strings, by parsing the corpus into phrases.

A rolling hash over 40 bytes picks the trigger of every 100-byte window, the leftmost least hash
in it. Neighbouring windows with one trigger form a phrase (extended by 99 bytes, so that every window
lies in one phrase), and a text is the sequence of its phrases. Equal windows have equal
triggers, hence:

* parse: a phrase seen before repeats whole, with all its windows;
* dictionary: of distinct phrases only those whose trigger another phrase has can hold a window
  of another phrase. Their suffixes of 100 bytes are put in groups of equal content, and in each
  group all but the first in corpus order (doc_id, start) are repeats.

Phrases and suffixes travel as 64-bit hashes beside their 64-bit trigger, never as text; sorting
by these two hashes puts equal strings side by side, which is all that the rule needs of the suffix
order. Each Arrow batch first settles what it can alone and sends one row per key, so a passage
that every document holds reaches a task as one row per batch.

Defined results: null or empty text is no bytes; texts below ``length`` bytes lose nothing. Rows that
agree in id and text are one document and give one row; texts that share an id come in text
order; a null id comes before all others. An empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import materialize

LENGTH = 100
GRAM = 40
#: Bytes scanned at once; longer texts are scanned in overlapping pieces.
PIECE = 1 << 20
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _table() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Scan:
    """Triggers and hashes of all windows of some pieces of text, laid end to end."""

    def __init__(self, pieces: list[bytes], length: int):
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces])
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        self.length, n = length, max(0, len(flat) - length + 1)
        self.valid = np.zeros(n + 1, np.int8)
        long = self.sizes >= length
        self.valid[self.begin[:-1][long]] += 1
        np.subtract.at(self.valid, self.begin[1:][long] - length + 1, 1)
        self.valid = np.cumsum(self.valid[:n], dtype=np.int8).astype(bool)
        codes = _table()[flat]
        size = 1 << max(16, int(len(flat) + 1).bit_length())
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, size)[:len(flat)], dtype=np.uint64)))
        self.back = _powers(_INVERSE, size)
        grams = _mix(self.hash(np.arange(max(0, len(flat) - GRAM + 1)), GRAM))
        self.trigger, self.at = (x[:n] for x in self._least(grams, length - GRAM + 1))

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of the bytes from start, the same wherever they stand."""
        return (self.prefix[start + size] - self.prefix[start]) * self.back[start]

    @staticmethod
    def _least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Minimum over each run of ``width`` values and its leftmost place, by doubling."""
        at, done = np.arange(len(h), dtype=np.int32), 1
        while done < width:
            step = min(done, width - done)
            if len(h) <= step:
                return h[:0], at[:0]
            less = h[step:] < h[:-step]
            at = np.where(less, at[step:], at[:-step])
            h = np.minimum(h[:-step], h[step:])
            done += step
        return h, at

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window start of each phrase, and its piece."""
        starts = np.flatnonzero(self.valid)
        if not len(starts):
            return starts, starts, starts
        piece = np.searchsorted(self.begin, starts, side="right") - 1
        t = self.at[starts]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (piece[1:] != piece[:-1])))
        lo = np.flatnonzero(new)
        hi = np.concatenate((lo[1:], [len(starts)])) - 1
        return starts[lo], starts[hi], piece[lo]


def _groups(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Pieces of the texts, at most about PIECE bytes at once, with their text and offset in it."""
    pieces, whose, offsets, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text if len(text) <= PIECE else text[at:at + PIECE + length - 1]
            pieces.append(part)
            whose.append(i)
            offsets.append(at)
            size += len(part)
            if size >= PIECE:
                yield pieces, whose, offsets
                pieces, whose, offsets, size = [], [], [], 0
    if pieces:
        yield pieces, whose, offsets


def _first_of(keys: np.ndarray) -> np.ndarray:
    """True at the first place of each key."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def _runs(starts: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring starts of one text."""
    if not len(starts):
        return starts, starts
    new = np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(whose) != 0)))
    lo = np.flatnonzero(new)
    return lo, np.concatenate((lo[1:], [len(starts)])) - 1


#: Columns of phrases and suffixes on their way: two hashes, the place, the range of window starts, flags.
_COLUMNS = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32, np.uint8)
KNOWN, DONE = 1, 2  # a candidate whatever others say; a range of repeats
PACKETS = "bucket int, n int, data binary"
RANGES = "doc_id bigint, tie int, lo int, hi int, done boolean"


def _packets(parts: list[tuple], buckets: int) -> pa.RecordBatch:
    """Rows dealt out by their first hash, the rows of a bucket packed column by column."""
    columns = [np.concatenate([p[i] for p in parts]).astype(t) for i, t in enumerate(_COLUMNS)]
    bucket = (columns[0] >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    names, first, counts = np.unique(bucket[order], return_index=True, return_counts=True)
    pack, columns = zstandard.ZstdCompressor(level=1).compress, [c[order] for c in columns]
    data = [pack(b"".join(c[at:at + n].tobytes() for c in columns)) for at, n in zip(first.tolist(), counts.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(data, pa.binary())],
                                      names=["bucket", "n", "data"])


def _settled(packets: DataFrame, buckets: int, decide) -> DataFrame:
    """Bring rows of one hash together, in corpus order, and keep the ranges that ``decide`` picks.

    A bucket is a set of hashes, none with more than a row per batch, so buckets are even and their size is that
    of the table by the number of shuffle partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, parts = zstandard.ZstdDecompressor().decompress, []
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, at, own = unpack(data), 0, []
                for t in _COLUMNS:
                    own.append(np.frombuffer(raw, t, n, at))
                    at += n * np.dtype(t).itemsize
                parts.append(own)
        if not parts:
            return
        route, second, doc, tie, lo, hi, flags = (np.concatenate([p[i] for p in parts]) for i in range(len(_COLUMNS)))
        order = np.lexsort((lo, tie, doc, flags & DONE, second, route))
        columns = [c[order] for c in (route, second, doc, tie, lo, hi, flags)]
        pick, done = decide(*columns)
        doc, tie, lo, hi = (c[pick] for c in columns[2:6])
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(lo), pa.array(hi), pa.array(done[pick])],
                                         names=["doc_id", "tie", "lo", "hi", "done"])

    return packets.repartition(buckets, "bucket").select("n", "data").mapInArrow(run, RANGES)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """True where a new group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _decide_phrases(route, second, doc, tie, lo, hi, flags):
    """Later copies of a phrase are repeats; a phrase is a candidate if its trigger has another one."""
    done = ((flags & DONE) > 0) | ~_starts(route, second)
    first = np.flatnonzero(_starts(route))
    ends = np.concatenate((first[1:], [len(route)])) - 1
    known = np.maximum.reduceat(flags & KNOWN, first) > 0
    wanted = np.repeat(known | (second[first] != second[ends]), ends - first + 1)
    return done | wanted, done


def _decide_suffixes(route, second, doc, tie, lo, hi, flags):
    """All but the first of equal suffixes are repeats."""
    done = ((flags & DONE) > 0) | ~_starts(route, second)
    return done, done


def _ordered(batch: pa.RecordBatch, unpack=None) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ties = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.lexsort((ties, ids))
    texts = batch.column(2).to_pylist()
    texts = [texts[i] for i in order.tolist()]
    return ids[order], ties[order], [unpack(t) for t in texts] if unpack else texts, order


def _parse(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Phrases that may hold repeats, and those that are known to be whole repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts, _ = _ordered(batch)
            for pieces, whose, offsets in _groups(texts, length):
                scan = Scan(pieces, length)
                lo, hi, piece = scan.phrases()
                if not len(lo):
                    continue
                trigger = scan.trigger[lo]
                key = _mix(scan.hash(lo, hi - lo + length)) + trigger
                first = _first_of(key)
                own, shift = np.array(whose)[piece], np.array(offsets)[piece] - scan.begin[:-1][piece]
                t = trigger[first]
                _, index, inverse, counts = np.unique(t, return_index=True, return_inverse=True, return_counts=True)
                known, witness = counts[inverse] > 1, np.zeros(len(t), bool)
                witness[index] = True
                place = lo + shift
                route = np.empty(len(lo), np.uint64)
                # One row per trigger and batch must meet those of other batches; other phrases meet their copies.
                route[first] = np.where(witness, t, _mix(key[first]))
                route[~first] = _mix(key[~first] + place[~first].astype(np.uint64))
                flags = np.where(first, 0, DONE).astype(np.uint8)
                flags[first] |= known.astype(np.uint8) * np.uint8(KNOWN)
                yield _packets([(route, key, ids[own], ties[own], place, hi + shift, flags)], buckets)

    return docs.select("doc_id", "tie", "text").mapInArrow(run, PACKETS)


def _suffixes(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Hashes of the windows in the phrases at hand; windows repeated in one batch are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts, order = _ordered(batch, zstandard.ZstdDecompressor().decompress)
            lows, highs = (batch.column(k) for k in (3, 4))
            ranges = [(lows[i].values.to_numpy(), highs[i].values.to_numpy()) for i in order.tolist()]
            for pieces, whose, offsets in _groups(texts, length):
                scan = Scan(pieces, length)
                inside = np.zeros(len(scan.valid) + 1, np.int32)
                for i, at, begin, size in zip(whose, offsets, scan.begin, scan.sizes):
                    lo, hi = ranges[i]
                    lo, hi = np.maximum(lo, at), np.minimum(hi, at + size - length)
                    ok = lo <= hi
                    np.add.at(inside, lo[ok] - at + begin, 1)
                    np.subtract.at(inside, hi[ok] + 1 - at + begin, 1)
                starts = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & scan.valid)
                if not len(starts):
                    continue
                piece = np.searchsorted(scan.begin, starts, side="right") - 1
                own, place = np.array(whose)[piece], starts + np.array(offsets)[piece] - scan.begin[piece]
                content, trigger = _mix(scan.hash(starts, length)), scan.trigger[starts]
                first = _first_of(content + trigger)
                a = np.flatnonzero(first)
                out = [(content[a], trigger[a], ids[own[a]], ties[own[a]], place[a], place[a], np.zeros(len(a)))]
                b = np.flatnonzero(~first)
                lo, hi = _runs(place[b], own[b])
                if len(lo):
                    c = b[lo]
                    spread = _mix(content[c] + place[c].astype(np.uint64))
                    out.append((spread, trigger[c], ids[own[c]], ties[own[c]], place[c], place[b[hi]], np.full(len(c), DONE)))
                yield _packets(out, buckets)

    return docs.select("doc_id", "tie", "text", "lows", "highs").mapInArrow(run, PACKETS)


def _base(docs: DataFrame) -> DataFrame:
    """doc_id without nulls, tie (0 unless ids repeat), text as bytes."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(str(_NO_ID)).cast("bigint")).alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.withColumn("tie", F.lit(0))
    rows = rows.distinct()
    return rows.withColumn("tie", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1)


def _packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [pack(t) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "tie", "text"])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id bigint, tie int, text binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, tie, lo, hi: ranges of window starts that also stand earlier in the corpus."""
    key = ["doc_id", "tie"]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = materialize(_settled(_parse(docs, length, buckets), buckets, _decide_phrases), "phrases")
    wanted = parsed.filter("NOT done").groupBy(*key).agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs"))
    windows = _suffixes(_packed(docs).join(wanted, key), length, buckets)
    found = materialize(_settled(windows, buckets, _decide_suffixes), "suffixes").drop("done")
    return parsed.filter("done").select(*key, "lo", "hi").unionByName(found)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every document."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    base = _base(docs)
    key = ["doc_id", "tie"]
    ranges = repeated_ranges(base, length).groupBy(*key).agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            removed, spans, kept = [], [], []
            texts = [unpack(t) for t in batch.column(1).to_pylist()]
            for i, text in enumerate(texts):
                if batch.column(2)[i].as_py() is None:
                    removed.append(0), spans.append(0), kept.append(text)
                    continue
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, batch.column(2)[i].values.to_numpy(), 1)
                np.subtract.at(cover, batch.column(3)[i].values.to_numpy() + length, 1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum()) + int((~gone[:-1] & gone[1:]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = _packed(base).join(ranges, key, "left").select("doc_id", "text", "lows", "highs").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(str(_NO_ID)).cast("bigint"), F.col("doc_id")))
