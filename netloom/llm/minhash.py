"""Near-duplicate documents by SetSketch registers.

A document is the set of its 5-word shingles. A register holds the least of exponentially
distributed hash values of the set on a logarithmic scale, so sketches of parts merge by maximum
and equal registers tell similarity. Four registers form a band; documents that agree in a band
are candidates. Similarity is first estimated from the registers by maximum likelihood, jointly
with the known set sizes; only pairs for which the threshold is out of the question are left
out. Every link is confirmed on the full sets.

No bucket is expanded into pairs. Documents with one shingle set are one class, represented by
the document with the smallest id. In each bucket all members are compared with one hub, the member that shares most
buckets with others; verified links are contracted to components. Only what can still join
components is left then: members outside their bucket's main component, compared with the
bucket's other components in blocks of bounded size; a block gives links, not pairs. With 32 bands of four registers a pair at
similarity 0.75 shares no band with a chance of 5 in a million; less for closer pairs.

Defined results: a document of fewer than five words has one shingle, the whole sequence. Without
words, or with a null text, it has none and links with nothing. Id and text together name a document:
rows that agree in both answer alike, rows that share an id are otherwise apart. Of a component the
smallest id stays, of equal ids the smallest digest. A null id stays only if no member has an id.
An empty table gives no rows. Extra columns are not read; ``keep`` passes them through.
"""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialize, text_digest
from netloom.llm.components import components

WORDS = 5
PER_BAND = 4
#: SetSketch parameters as published for 16-bit registers.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: A pair is left out when its likelihood at the threshold is this many nats below the best.
NATS = 12.0
BLOCK = 1024
_CACHE_WORDS = 400_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    # bytes.lower changes A-Z only; bytes.split cuts at space and \x09-\x0D: the contract's words.
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hash_words().__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - k + 1)
    h = np.full(n, min(k, len(ids)), np.uint64)
    for j in range(min(k, len(ids))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


@functools.cache
def _hash_words() -> _Words:
    return _Words()


@functools.cache
def _seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 2**32, (registers, 1), dtype=np.uint32), rng.integers(0, 2**32, (registers, 1), dtype=np.uint32) | np.uint32(1))


def sketch(hashes: np.ndarray, registers: int) -> np.ndarray:
    """uint16 registers of a set of hashes."""
    flip, factor = _seeds(registers)
    low, best = hashes.astype(np.uint32), np.zeros(registers, np.uint32)
    for at in range(0, len(low), BLOCK):  # the matrix stays in the processor's cache
        block = low[None, at:at + BLOCK] ^ flip
        block *= factor
        np.maximum(best, block.max(1), out=best)
    least = -np.log((best.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def _log_likelihood(j, up, down, same, share):
    """Of similarity j, given how many registers of the first set are larger, smaller, equal."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    first, second = p(share - (1 - share) * j), p((1 - share) - share * j)
    tiny = 1e-12
    return (up * np.log(np.maximum(first, tiny)) + down * np.log(np.maximum(second, tiny))
            + same * np.log(np.maximum(1 - first - second, tiny)))


_GRID = np.linspace(0.02, 1.0, 50)


def plausible(up, down, same, n_a, n_b, threshold: float) -> np.ndarray:
    """False where similarity ``threshold`` or more is out of the question."""
    up, down, same, n_a, n_b = (np.asarray(x, np.float64)[:, None] for x in (up, down, same, n_a, n_b))
    share = n_a / (n_a + n_b)
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.concatenate((np.broadcast_to(_GRID, (len(up), len(_GRID))), np.full((len(up), 1), threshold)), 1)
    value = _log_likelihood(np.minimum(grid, top), up, down, same, share)
    reach = np.where(grid >= threshold, value, -np.inf).max(1)
    return (top[:, 0] >= threshold) & (reach >= value.max(1) - NATS)


SKETCHES = "doc_id bigint, digest binary, n bigint, set_id binary, registers binary"


def sketches(docs: DataFrame, registers: int) -> DataFrame:
    """Digest of the text, set size, a 128-bit name of the set, and registers; no name for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, regs = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                names.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                regs.append(sketch(own, registers).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                                              pa.array(regs, pa.binary())], names=["doc_id", "digest", "n", "set_id", "registers"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").alias("text"))
    return rows.mapInArrow(run, SKETCHES)


def _bands(rows: DataFrame, bands: int) -> DataFrame:
    """doc_id, band, value: four 16-bit registers are one 64-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(ids), -1)[:, :bands]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids, bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))),
                pa.array(values.reshape(-1))], names=["doc_id", "band", "value"])

    return rows.select("doc_id", "registers").mapInArrow(run, "doc_id bigint, band int, value bigint")


def _verified(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; estimated first."""
    left = table.select(*[F.col(c).alias(f"{c}_a") for c in table.columns])
    right = table.select(*[F.col(c).alias(f"{c}_b") for c in table.columns])
    rows = pairs.join(left, F.col("a") == F.col("doc_id_a")).join(right, F.col("b") == F.col("doc_id_b"))
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def full(i, text):
            if i not in known:
                if len(known) >= 64:
                    known.popitem(last=False)
                known[i] = shingles(text)
            return known[i]

        for batch in batches:
            if not len(batch):
                continue
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            r_a, r_b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(len(a), -1) for k in (3, 6))
            up, down = (r_a > r_b).sum(1), (r_a < r_b).sum(1)
            likely = plausible(up, down, r_a.shape[1] - up - down, n_a, n_b, threshold)
            links = []
            for i in np.flatnonzero(likely).tolist():
                x, y = full(a[i], batch.column(4)[i].as_py()), full(b[i], batch.column(7)[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                                             names=["a", "b"])

    return rows.select("a", "b", "n_a", "registers_a", "text_a", "n_b", "registers_b", "text_b").mapInArrow(run, "a bigint, b bigint")


def _rest(members: DataFrame, labels: DataFrame, table: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) inside a bucket and between components, looked for and verified in blocks."""
    key = ["band", "value"]
    own = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(
        table.select("doc_id", "n"), "doc_id")
    own = materialize(own.select(*key, "doc_id", "hub", F.coalesce("component", "doc_id").alias("component"), "n"), "members")
    per = own.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    mixed = per.groupBy(*key).agg(F.max_by("component", "docs").alias("main"), F.max("docs").alias("largest"), F.sum("docs").alias("size"),
                                  F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # Blocks are bounded in documents and in shingles.
    parts = lambda docs: F.greatest(F.ceil(docs / block), F.ceil(F.col("n") / (block * block))).cast("int")
    mixed = materialize(mixed.select(*key, "main", parts(F.col("size")).alias("across"),
                                     parts(F.col("size") - F.col("largest")).alias("down")), "mixed")
    rows = own.drop("n").join(mixed, key).withColumn("apart", F.col("component") != F.col("main"))
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*key, "i", "j", "side", "doc_id", "component", "hub", "apart"]
    outside = rows.filter("apart").withColumn("i", spot("down")).withColumn("j", every("across")).withColumn("side", F.lit(0))
    inside = rows.withColumn("j", spot("across")).withColumn("i", every("down")).withColumn("side", F.lit(1))
    spread = outside.select(*columns).unionByName(inside.select(*columns)).join(table, "doc_id")
    place = [*key, "i", "j"]
    spread = spread.repartition(*place).sortWithinPartitions(*place, "side", "doc_id").select(
        *place, "side", "doc_id", "component", "hub", "apart", "n", "registers", "text")
    percent = round(threshold * 100)

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        out = [r for r in rows if r[4] == 0]
        every = [r for r in rows if r[4] == 1]
        if not out or not every:
            return []
        ids, parts, hubs, apart, sizes = (np.array([r[c] for r in every]) for c in (5, 6, 7, 8, 9))
        regs = np.frombuffer(b"".join(r[10] for r in every), np.uint16).reshape(len(every), -1)
        bands = np.frombuffer(b"".join(r[10] for r in every), np.int64).reshape(len(every), -1)
        sets: dict[int, np.ndarray] = {}

        def full(row):
            if row[5] not in sets:
                sets[row[5]] = shingles(row[11])
            return sets[row[5]]

        found = []
        for r in out:
            mine = np.frombuffer(r[10], np.uint16)
            same = bands[:, :r[0] + 1] == np.frombuffer(r[10], np.int64)[:r[0] + 1]
            # A pair is looked at in the first band it shares, and not again if the hub was one of the two.
            ok = (parts != r[6]) & ~same[:, :-1].any(1) & (ids != r[7]) & (r[5] != r[7]) & (~apart | (ids > r[5]))
            ok = np.flatnonzero(ok)
            if len(ok):
                up, down = (mine > regs[ok]).sum(1), (mine < regs[ok]).sum(1)
                ok = ok[plausible(up, down, len(mine) - up - down, np.full(len(ok), r[9]), sizes[ok], threshold)]
                joined = set()
                for at in ok.tolist():
                    other = every[at]
                    if other[6] not in joined:  # one link to a component is enough
                        x, y = full(r), full(other)
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            joined.add(other[6])
                            found.append((min(r[5], other[5]), max(r[5], other[5])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                              names=["a", "b"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:4] != group[0][:4]:
                    found += pairs(group)
                    group = []
                group.append(row)
            if found:
                yield made(found)
        if group:
            yield made(pairs(group))

    return spread.mapInArrow(run, "a bigint, b bigint")


def _answers(docs: DataFrame, threshold: float = 0.75, bands: int = 32, registers: int = 128, block: int = BLOCK) -> DataFrame:
    """The rows of ``near_duplicates`` with the digest of the text."""
    if registers < bands * PER_BAND or registers % PER_BAND:
        raise ValueError("registers must fill the bands")
    every = materialize(sketches(docs, registers), "sketches")
    # Classes are numbered: ids can be null or repeat, so they name nothing before the end.
    found = every.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")).alias("best"),
        F.first("n").alias("n"), F.first("registers").alias("registers"))
    sets = materialize(found.withColumn("node", F.monotonically_increasing_id()), "sets")
    banded = materialize(_bands(sets.select(F.col("node").alias("doc_id"), "registers"), bands), "bands")
    key = ["band", "value"]
    shared = banded.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    members = materialize(banded.join(shared.filter("size > 1"), key), "buckets")
    fame = members.groupBy("doc_id").agg(F.sum("size").alias("fame"))
    hubs = members.join(fame, "doc_id").groupBy(*key).agg(F.max_by("doc_id", "fame").alias("hub"))
    members = materialize(members.join(hubs, key).select(*key, "doc_id", "hub"), "hubs")
    asked = sets.join(members.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi").select(
        "node", "n", "registers", F.col("best.id").alias("id"), F.col("best.digest").alias("own"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").alias("text"))
    texts = texts.join(asked.select("id", "own"), same, "left_semi")
    # Rows that agree in id and text are one document.
    table = texts.join(asked, same).select(F.col("node").alias("doc_id"), "n", "registers", "text").dropDuplicates(["doc_id"])
    table = materialize(table, "candidates")
    pairs = members.filter("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    links = materialize(_verified(pairs, table, threshold), "links")
    more = materialize(_rest(members, components(links), table, threshold, block), "rest")
    links = links.unionByName(more)
    labels = components(links)
    named = sets.select("set_id", "best", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    winners = named.groupBy("component").agg(F.min("best").alias("best"))
    named = named.select("set_id", "component").join(winners, "component").select("set_id", "best")
    out = every.select("doc_id", "digest", "n", "set_id").join(named, "set_id", "left")
    alone = F.col("set_id").isNull()
    wins = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.digest"))
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"),
                      (alone | wins).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, bands: int = 32, registers: int = 128, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _answers(docs, threshold, bands, registers, block).drop("digest")


def keep(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One document of each component, and all others that link with nothing, with all columns."""
    gone = materialize(_answers(docs, threshold).filter("NOT kept").select(
        F.col("doc_id").alias("id"), F.col("digest").alias("own")).distinct(), "near")
    same = docs["doc_id"].eqNullSafe(gone["id"]) & (text_digest(docs["text"]) == gone["own"])
    return docs.join(gone, same, "left_anti")
