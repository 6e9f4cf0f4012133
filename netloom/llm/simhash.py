"""Near-duplicate documents by 64-bit SimHash fingerprints and anchor points.

A fingerprint bit is set when it is set in over half of the XXH64 hashes of all 4-word shingles,
repeats included. Fingerprints link at a few differing bits. The pairs are found on a covering
code: every word lies within the covering radius R of an anchor (a code word). A fingerprint is
at home at its own anchor and visits every anchor within R plus the threshold, so of a linked
pair the one always meets the other at its home; only homes and visitors of one anchor are
compared, always on all 64 bits.

A covering code of all 64 bits with few enough anchors would send each fingerprint to over a
thousand of them. The bits are therefore cut into pieces with a threshold each. The thresholds
plus one add up to more than the allowed distance, so a linked pair is within the threshold on
at least one piece, and each piece has its own code: a perfect Hamming code (R = 1) on its first
bits, every word on the others. With the default pieces (22, 21 and 21 bits, thresholds 1, 1 and
0) a fingerprint visits 30 anchors of 2^18, 2^17 and 2^17. For more than some 10^9 distinct
fingerprints take ``pieces=((32, 2), (32, 1)), order=5``: 188 visits, 2^27 anchors in each piece.

Copies share a fingerprint, and only distinct fingerprints are compared. An anchor with more
homes or visitors than a block holds is dealt out as homes x visitors blocks: no task holds more
than one block, and a block returns at most a forest over its members, never all its pairs. The
comparisons inside one anchor still grow with the square of its distinct fingerprints.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links
like any other. Fewer than four words are one shingle. Long texts are read in slices of 4 MB.
Rows that repeat an id are documents of their own; each gets its row. A component is named by its
smallest id, null only if no member has one. An empty table gives no rows. Extra columns are
not read. Ids are whole numbers.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialize
from netloom.llm.components import components

WORDS = 4
SEED = 42
DISTANCE = 4
#: Bits and threshold of each piece, from the lowest bit up.
PIECES = ((22, 1), (21, 1), (21, 0))
#: The Hamming code of order m has 2^m - 1 bits.
ORDER = 4
SLICE = 4 << 20
HOMES, VISITORS = 4096, 65536
#: Groups up to this many comparisons are looked at together, larger ones home by home.
SMALL, CHUNK = 4096, 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if cut is None:
            break
        yield data[at:cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def fingerprint(data: bytes, k: int = WORDS, size: int = SLICE) -> int:
    """The 64 bits of a text in UTF-8, as an unsigned number."""
    ones, n, kept = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in _slices(data, size):
        # bytes.lower changes A-Z only; bytes.split cuts at space and \x09-\x0D: the contract's words.
        words = kept + part.lower().split()
        if len(words) < k:
            kept = words
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:len(words) - k + 1].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())), np.uint64, len(starts))
        for at in range(0, len(hashes), 4096):
            bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        n += len(hashes)
        kept = words[len(words) - k + 1:]
    if not n:
        return digest(b" ".join(kept), SEED) if kept else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.fromiter((fingerprint(t or b"", k) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def check_pieces(pieces, order: int, distance: int) -> None:
    if sum(bits for bits, _ in pieces) != 64 or any(bits < 2**order - 1 for bits, _ in pieces):
        raise ValueError("the pieces must fill 64 bits and each hold the code")
    if sum(t + 1 for _, t in pieces) <= distance:
        raise ValueError("thresholds too small: a linked pair could miss every piece")


def _syndrome(words: np.ndarray, order: int) -> np.ndarray:
    """Zero for code words; otherwise the number (from 1) of the bit that leads to one."""
    out = np.zeros(len(words), np.uint64)
    for bit in range(2**order - 1):
        out ^= ((words >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


@functools.cache
def _flips(bits: int, radius: int, order: int) -> list[np.ndarray]:
    """For each syndrome, the flips of at most ``radius`` bits that lead to an anchor."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(bits)}
    every = np.array(sorted(masks), np.uint64)
    every = every[np.bitwise_count(every) <= radius]
    leads = _syndrome(every, order)
    return [every[leads == s] for s in range(2**order)]


def anchors(words: np.ndarray, bits: int, threshold: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each word, and the visits within radius 1 + threshold as (index, anchor)."""
    syndrome = _syndrome(words, order)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    rows, visits = [], []
    for s, masks in enumerate(_flips(bits, 1 + threshold, order)):
        own = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(own, len(masks)))
        visits.append((words[own][:, None] ^ masks[None, :]).reshape(-1))
    return words ^ flip, np.concatenate(rows), np.concatenate(visits)


def placements(prints: DataFrame, pieces=PIECES, order: int = ORDER) -> DataFrame:
    """piece, anchor, side (0 at home, 1 visiting), print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            for piece, (bits, threshold) in enumerate(pieces):
                words = (own >> np.uint64(at)) & np.uint64((1 << bits) - 1)
                home, row, visit = anchors(words, bits, threshold, order)
                anchor = np.concatenate((home, visit)).astype(np.int64)
                side = np.repeat(np.array([0, 1], np.int8), (len(home), len(visit)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(anchor), piece, np.int8)), pa.array(anchor), pa.array(side),
                    pa.array(np.concatenate((own, own[row])).view(np.int64))], names=["piece", "anchor", "side", "print"])
                at += bits

    return prints.select("print").mapInArrow(run, "piece tinyint, anchor bigint, side tinyint, print bigint")


def _forest(homes: np.ndarray, visitors: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what any link between homes and visitors connects."""
    every, at = np.unique(np.concatenate((homes, visitors)), return_inverse=True)
    home_at, label = at[:len(homes)], np.arange(len(every))
    visitors, seat = np.unique(visitors), np.unique(at[len(homes):])
    links = []
    for own, place in zip(homes, home_at):
        near = seat[np.bitwise_count(visitors ^ own) <= distance]
        groups, first = np.unique(label[near], return_index=True)
        apart = groups != label[place]
        if apart.any():
            links += [(int(own), int(every[near[f]])) for f in first[apart]]
            label[np.isin(label, groups)] = label[place]
    return links


def _links(key: np.ndarray, side: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups; rows are sorted by group, homes first."""
    start = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
    end = np.concatenate((start[1:], [len(key)]))
    homes = np.add.reduceat(side == 0, start)
    work = homes * (end - start - homes)
    first, second = [], []
    small = np.flatnonzero((work > 0) & (work <= SMALL))
    cuts = np.searchsorted(np.cumsum(work[small]), np.arange(CHUNK, work[small].sum() + CHUNK, CHUNK))
    for some in np.split(small, cuts):
        if not len(some):
            continue
        n = work[some]
        which, step = np.repeat(np.arange(len(some)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        guests = (end - start - homes)[some][which]
        a = prints[start[some][which] + step // guests]
        b = prints[(start + homes)[some][which] + step % guests]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        first.append(a[near])
        second.append(b[near])
    for g in np.flatnonzero(work > SMALL):
        middle = start[g] + homes[g]
        found = _forest(prints[start[g]:middle], prints[middle:end[g]], distance)
        first.append(np.array([a for a, _ in found], np.uint64))
        second.append(np.array([b for _, b in found], np.uint64))
    if not first:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(first), np.concatenate(second)


def links(prints: DataFrame, distance: int = DISTANCE, pieces=PIECES, order: int = ORDER,
          homes: int = HOMES, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance`` bits, given distinct ones (print)."""
    check_pieces(pieces, order, distance)
    rows = placements(prints, pieces, order)
    place = ["piece", "anchor"]
    # The tally keeps one row per anchor; only those over a block go on.
    tally = rows.groupBy(*place).agg(F.count_if(F.col("side") == 0).alias("h"), F.count_if(F.col("side") == 1).alias("v"))
    large = materialize(tally.filter((F.col("h") > 0) & ((F.col("h") > homes) | (F.col("v") > visitors))).select(
        *place, F.ceil(F.col("h") / homes).cast("int").alias("down"), F.ceil(F.col("v") / visitors).cast("int").alias("across")), "anchors")
    if large.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        rows = rows.join(large, place, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("down", "across")})
        own = lambda n: F.array(F.pmod(F.xxhash64("print"), F.col(n)).cast("int"))
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        at_home = F.col("side") == 0
        rows = rows.withColumn("i", F.explode(F.when(at_home, own("down")).otherwise(every("down"))))
        rows = rows.withColumn("j", F.explode(F.when(at_home, every("across")).otherwise(own("across"))))
    group = [*place, "i", "j"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "side").select(*group, "side", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def columns():
            return [np.concatenate(c) for c in zip(*held)]

        def made(piece, anchor, i, j, side, prints):
            # Blocks are numbered in the order of their rows.
            new = np.concatenate(([False], (np.diff(piece) != 0) | (np.diff(anchor) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
            a, b = _links(np.cumsum(new), side, prints.view(np.uint64), distance)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c]).view(np.int64)) for c in (0, 1)], names=["a", "b"])

        count = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += len(batch)
            if count < VISITORS:
                continue
            rows = columns()
            same = np.logical_and.reduce([c == c[-1] for c in rows[:4]])
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                yield made(*(c[:last] for c in rows))
            held = [[c[last:] for c in rows]]
            # A block in progress is not looked at again before as many rows have come.
            count = 0
        if held and len(held[0][0]) + sum(len(h[0]) for h in held[1:]):
            yield made(*columns())

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, pieces=PIECES, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialize(fingerprints(docs), "prints")
    distinct = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(distinct, distance, pieces, order))
    found = distinct.join(labels, distinct["print"] == labels["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("component"))
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(found.join(least, "component").select("print", "component_id"), "named")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
