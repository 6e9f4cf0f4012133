"""How far the sources of a language differ in their use of words.

Terms are counted by ``CountVectorizer`` with ``minDF`` and the largest integer ``vocabSize``; a term
carries its language, so one fit holds a vocabulary per language, however many languages there are.
The sparse vectors of the documents are summed per (lang, source), in integers. Every kept term
gets the smoothed share p = 1 + floor(scale * (count + 1) / (N + V)) of its group, N the group's kept
words and V the language's kept terms. Shares diverge by floor((p - q) * (p - q) / q).

A pair of sources is evaluated on the terms that occur in one of their tiles; on all others both
have the share of a count of zero, which is one product. Sources and terms are cut into tiles, and
a task holds the shares of one tile of terms for two tiles of sources.

The vocabulary of ``CountVectorizer`` passes through the driver and to every task, and grows with the
corpus. It is used while that is proven to be small: its terms occur three times or more, so
they cannot be larger than the texts, which must not exceed ``vocabulary_text`` bytes. Beyond, sparse
counts are combined in the tasks and summed by shuffled aggregates. The results are the same.

Defined results: null text, language and source count as ''. A group without terms is a group. A
language without a kept term has pairs of value 0 and no terms. Rows that repeat an id are
documents of their own. Texts are read whole, whatever their length. Equal values are ranked by the
item's bytes. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import materialize

MIN_DF = 3
SCALE = 1_000_000_000
RANKS = 200
MAX_VOCABULARY = 2**31 - 1
VOCABULARY_TEXT = 64 << 20
#: Counts a task combines before it hands them on.
HELD = 200_000
SOURCES_TILE, TERMS_TILE = 64, 4096
#: Stands between language and term; no term holds it.
GAP = " "
#: Letters and all bytes beyond ASCII stay, A-Z in lower case; anything else ends a term.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokens(docs: DataFrame) -> DataFrame:
    """lang, source, terms: each term with its language before it, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [text.translate(_LETTERS).split() for text in batch.column(2).to_pylist()]
            sizes = [len(w) for w in own]
            flat = pa.array([w for words in own for w in words], pa.binary()).cast(pa.string())
            heads = pc.binary_join_element_wise(batch.column(0), pa.scalar(""), GAP)
            heads = heads.take(pa.array(np.repeat(np.arange(len(own)), sizes)))
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, pc.binary_join_element_wise(heads, flat, ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], names=["lang", "source", "terms"])

    return _texts(docs).mapInArrow(run, "lang string, source string, terms array<string>")


def _texts(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))


def _vectorized(docs: DataFrame, min_df: int) -> DataFrame:
    """lang, source, term, n of all kept terms, from the sparse vectors of a fitted CountVectorizer."""
    rows = materialize(tokens(docs), "terms")
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=MAX_VOCABULARY).fit(rows)
    vector = F.unwrap_udt("vector")
    entries = model.transform(rows).select("lang", "source", F.explode(
        F.arrays_zip(vector["indices"].alias("at"), vector["values"].alias("n"))).alias("e"))
    # A vector holds whole numbers far below 2^53; the sums are taken in 64 bits.
    sums = entries.groupBy("lang", "source", F.col("e.at").alias("at")).agg(F.sum(F.col("e.n").cast("bigint")).alias("n"))
    words = rows.sparkSession.createDataFrame(list(enumerate(model.vocabulary)), "at int, word string")
    return sums.join(words, "at").select("lang", "source", F.expr(f"substring_index(word, '{GAP}', -1)").alias("term"), "n")


def _combined(docs: DataFrame, min_df: int) -> DataFrame:
    """The same for a vocabulary of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def made():
            sizes = [len(n) for n, _ in counts.values()]
            of = pa.array(np.repeat(np.arange(len(counts)), sizes))
            words = pa.array([w for n, _ in counts.values() for w in n], pa.binary()).cast(pa.string())
            n = pa.array([c for own, _ in counts.values() for c in own.values()], pa.int64())
            # A term enters both counts with the same document: their order agrees.
            df = pa.array([c for _, own in counts.values() for c in own.values()], pa.int64())
            names = [pa.array([key[i] for key in counts], pa.string()).take(of) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*names, words, n, df], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = Counter(text.translate(_LETTERS).split())
                if not own:
                    continue
                n, df = counts.setdefault((lang, source), (Counter(), Counter()))
                n.update(own)
                df.update(own.keys())
            if sum(len(n) for n, _ in counts.values()) >= HELD:
                yield made()
                counts = {}
        if counts:
            yield made()

    rows = _texts(docs).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
    sums = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    everywhere = F.sum("df").over(Window.partitionBy("lang", "term"))
    return sums.withColumn("df", everywhere).filter(F.col("df") >= min_df).drop("df")


def _share(count: str, whole: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (whole + kept)), exact beyond 64 bits."""
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"1 + ({wide(f'{count} + 1')} * cast({SCALE} as decimal(10, 0))) div {wide(f'{whole} + {kept}')}")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _tile_values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed divergence of each row of p from each row of q."""
    out = np.empty((len(p), len(q)), np.int64)
    for row, own in enumerate(p):
        gap = own - q
        out[row] = (gap * gap // q).sum(1)
    return out


def _tile(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Numbers of the groups on either side, their divergences, and the number of terms seen."""
    side, g, share = (group.column(c).to_numpy() for c in ("side", "g", "share"))
    terms = group.column("term").combine_chunks().dictionary_encode()
    used, seat = len(terms.dictionary), terms.indices.fill_null(-1).to_numpy()
    shares, names = [], []
    for s in (0, 1):
        mark, here = (side == s) & (seat < 0), (side == s) & (seat >= 0)
        ids, first = np.unique(g[mark], return_index=True)
        matrix = np.repeat(share[mark][first][:, None], used, axis=1)
        matrix[np.searchsorted(ids, g[here]), seat[here]] = share[here]
        names.append(ids)
        shares.append(matrix)
    return *names, _tile_values(*shares), used


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def made():
        table = pa.Table.from_batches(held)
        a, b, values, terms = _tile(table)
        n = len(a) * len(b)
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(values.reshape(-1)),
            pa.array(np.full(n, terms, np.int64))], names=["a", "b", "value", "terms"])

    for batch in batches:
        place = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and held[0].column(0)[0].as_py() != int(place[low]):
                yield made()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield made()


def pairs(groups: DataFrame, entries: DataFrame, sources_tile: int = SOURCES_TILE, terms_tile: int = TERMS_TILE) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    ``groups``: lang, source, g (a number), kept, zero (the share of no occurrence). ``entries``: lang, g, term, p.
    """
    size = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / sources_tile).cast("int").alias("tiles"),
        F.greatest(F.ceil(F.max("kept") / terms_tile), F.lit(1)).cast("int").alias("cuts"))
    # Marks carry the groups, those without a term too, into every tile.
    marks = groups.join(size, "lang").select("lang", "g", "tiles", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("k"),
                                             F.lit(None).cast("string").alias("term"), F.col("zero").alias("share"))
    counts = entries.join(size, "lang").select("lang", "g", "tiles", F.pmod(F.xxhash64("term"), "cuts").cast("int").alias("k"), "term",
                                              F.col("p").alias("share"))
    rows = marks.unionByName(counts).withColumn("own", F.pmod(F.xxhash64("g"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    one = rows.select("lang", "k", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "g", "term", "share")
    two = rows.select("lang", "k", other.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "g", "term", "share")
    place = ["lang", "i", "j", "k"]
    dealt = one.unionByName(two).repartition(*place).sortWithinPartitions(*place)
    # Only neighbouring tiles of one task must have different names.
    dealt = dealt.select(F.xxhash64(*place).alias("place"), "side", "g", "term", "share")
    values = dealt.mapInArrow(_tile_rows, "a bigint, b bigint, value bigint, terms bigint")
    summed = values.filter("a <> b").groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    left = groups.select(F.col("g").alias("a"), "lang", "source", "kept", F.col("zero").alias("p"))
    right = groups.select(F.col("g").alias("b"), F.col("source").alias("item"), F.col("zero").alias("q"))
    rest = F.expr("(kept - terms)") * _apart("p", "q")
    return summed.join(left, "a").join(right, "b").select("lang", "source", "item", (F.col("value") + F.coalesce(rest, F.lit(0))).alias("value"))


def audit(docs: DataFrame, min_df: int = MIN_DF, ranks: int = RANKS, vocabulary_text: int = VOCABULARY_TEXT,
          sources_tile: int = SOURCES_TILE, terms_tile: int = TERMS_TILE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    text = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    sums = (_vectorized if text <= vocabulary_text else _combined)(docs, min_df)
    word = Window.partitionBy("lang", "term")
    first = F.row_number().over(word.orderBy("source")) == 1
    sums = materialize(sums.withColumns({"all_n": F.sum("n").over(word), "first": first}), "sums")
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    by_lang = sums.groupBy("lang").agg(F.sum("n").alias("all_words"), F.count_if("first").alias("kept"))
    groups = _texts(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", F.monotonically_increasing_id().alias("g"),
                           *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("words", "all_words", "kept")])
    zero = F.when(F.col("kept") > 0, _share("0", "words", "kept")).otherwise(F.lit(1))
    groups = materialize(groups.withColumn("zero", zero), "groups")
    entries = sums.join(groups, ["lang", "source"]).select(
        "lang", "source", "g", "term", _share("n", "words", "kept").alias("p"), _share("all_n", "all_words", "kept").alias("q"))
    entries = materialize(entries, "entries")

    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs(groups, entries, sources_tile, terms_tile).withColumn("rank", F.row_number().over(own))
    term = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*columns).unionByName(term.withColumn("part", F.lit("term")).select(*columns))
