"""Ranked lexical search of a stated set of items over all documents.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case. An item's
score for a document sums weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats
included, with m = 25 + (75 n N) div L for a document of n terms. Weights come from exact counts over
all documents.

The items' own terms are a compact vocabulary. Each document is read once and kept as its length and
the counts of these terms. Blocks of documents then become dense tiles (documents x terms) of
weighted impacts, multiplied by a tile (terms x items) of the items' counts in float64. Tiles are cut
so that no sum reaches 2^53: every product and partial sum is a whole number that a double holds, and
tiles are added up in 64-bit integers. A task keeps the best ``top`` documents of each item over
its blocks, equal scores by the smaller id; the tasks' lists are ranked once more.

Items are taken in blocks of at most ``item_bytes`` of text, so that the vocabulary and the counts
sent to every task are bounded however many items there are; each block reads the documents again.
An item larger than a block is a block.

Defined results: null and empty texts have no terms; such documents are never found and such items
find nothing. Without any term in the documents there are no rows. Rows that repeat an id are items, or
documents, of their own; a null document id ranks after all others. Long texts are read in slices
of 4 MB. Only scores above 0 count. Extra columns are not read. Document ids are whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import materialize

TOP = 10
ITEM_BYTES = 4 << 20
#: Largest value of (10^9 tf) div (1000 tf + 8 m).
IMPACT = 1_000_000
EXACT = 2**53
TERMS_TILE, DOCS_TILE = 2048, 512
SLICE = 4 << 20
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TERMS).split()


def _slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    at = 0
    while len(data) - at > size:
        cut = _BREAK.search(data, at + size)
        if cut is None:
            break
        yield data[at:cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms), at and tf (little-endian 32 and 64 bits) of the vocabulary's terms in each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {word: i for i, word in enumerate(shared.value)}
        for batch in batches:
            sizes, ats, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = 0, Counter()
                for part in _slices(text or b""):
                    words = terms(part)
                    n += len(words)
                    found.update(map(place.get, words))
                found.pop(None, None)
                sizes.append(n)
                ats.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), np.int64, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ats, pa.binary()), pa.array(tfs, pa.binary())],
                                             names=["doc_id", "n", "at", "tf"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, at binary, tf binary")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary. Each task sends one sum per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["at", "df"])

    found = rows.select("at").mapInArrow(run, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


def tiles(counts: np.ndarray, weights: np.ndarray, width: int = TERMS_TILE, exact: int = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) tiles of the items' counts (items x terms) whose weighted sums stay below ``exact``.

    A count too large for one tile is spread over several.
    """
    out, open_terms, open_counts = [], [], []
    load = np.zeros(len(counts), object)

    def close():
        nonlocal load
        if open_terms:
            out.append((np.array(open_terms), np.stack(open_counts, 1).astype(np.float64)))
            open_terms.clear()
            open_counts.clear()
            load = np.zeros(len(counts), object)

    for at, weight in enumerate(weights.tolist()):
        left = counts[:, at].copy()
        most = max(1, (exact - 1) // max(1, weight * IMPACT))
        while left.any():
            part = np.minimum(left, most)
            added = part.astype(object) * (weight * IMPACT)
            if len(open_terms) == width or max(load + added) >= exact:
                close()
            open_terms.append(at)
            open_counts.append(part)
            load = load + added
            left -= part
    close()
    return out


def _best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, top: int) -> np.ndarray:
    """Places of the best scores above 0, equal scores by id, null ids last."""
    held = np.flatnonzero(scores > 0)
    if len(held) > top:
        # All that tie with the last place stay until the ids decide.
        held = held[scores[held] >= np.partition(scores[held], len(held) - top)[len(held) - top]]
    return held[np.lexsort((ids[held], none[held], -scores[held]))[:top]]


def _scored(rows: DataFrame, parts, weights: np.ndarray, n_docs: int, n_terms: int, items: int, top: int) -> DataFrame:
    """item (its number), doc_id, score: the best of each task."""
    shared = rows.sparkSession.sparkContext.broadcast((parts, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile_list, weight = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items
        for whole in batches:
            for low in range(0, len(whole), DOCS_TILE):
                batch = whole.slice(low, DOCS_TILE)
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy()
                lengths = batch.column(1).to_pylist()
                held = [len(a) // 4 for a in batch.column(2).to_pylist()]
                at = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32)
                tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
                # n * N can pass 64 bits: Python's integers take it.
                m = np.array([25 + (75 * n * n_docs) // n_terms for n in lengths], np.int64)
                doc = np.repeat(np.arange(len(batch)), held)
                dense = np.zeros((len(batch), len(weight)))
                dense[doc, at] = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                scores = np.zeros((items, len(batch)), np.int64)
                for columns, counts in tile_list:
                    scores += (counts @ dense[:, columns].T).astype(np.int64)
                for item in np.flatnonzero(scores.any(1)):
                    s, i, z = best[item]
                    own = scores[item]
                    if len(s) == top and own.max() < s[-1]:
                        continue
                    s, i, z = np.concatenate((s, own)), np.concatenate((i, ids)), np.concatenate((z, none))
                    keep = _best(s, i, z, top)
                    best[item] = (s[keep], i[keep], z[keep])
        sizes = [len(s) for s, _, _ in best]
        s, i, z = (np.concatenate(c) for c in zip(*best))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(items, dtype=np.int32), sizes)), pa.array(i, mask=z), pa.array(s)],
                                         names=["item", "doc_id", "score"])

    return rows.filter("octet_length(at) > 0").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _blocks(items: DataFrame, item_bytes: int) -> list[DataFrame]:
    """The items with text, in blocks of about ``item_bytes``."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // item_bytes)
    if n <= 1:
        return [items]
    rows = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    return [rows.filter(F.col("block") == b).drop("block") for b in range(n)]


def _search(docs: DataFrame, items: DataFrame, top: int) -> DataFrame | None:
    """item_id, item (a number), doc_id, score for one block of items."""
    spark = docs.sparkSession
    found = items.collect()  # bounded by the block
    asked = [Counter(terms(r["text"].encode())) for r in found]
    vocabulary = sorted(set().union(*asked))
    if not vocabulary:
        return None
    rows = materialize(counted(docs, vocabulary), "counts")
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = document_counts(rows, len(vocabulary))
    held = np.flatnonzero(df)
    if not len(held):
        return None
    n_docs = total["docs"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    counts = np.array([[c[w] for w in vocabulary] for c in asked], np.int64)
    counts[:, df == 0] = 0
    best = _scored(rows, tiles(counts, weights), weights, n_docs, total["terms"], len(found), top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(found)], items.select(
        F.lit(0).alias("item"), "item_id").schema)
    return best.join(names, "item")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents of each item."""
    items = items.select("item_id", "text").filter("text IS NOT NULL")
    out = None
    for block in _blocks(items, item_bytes):
        one = _search(docs, block, top)
        if one is None:
            continue
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        one = one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return out
