"""Benchmark decontamination by shared word n-grams.

The windows of the benchmark form a broadcast hash set (only if their measured size is below
a bound; a shuffled join otherwise, with the same result). Documents are scanned once: every
window of a document is looked up by a 64-bit hash, and a hit counts only if the words agree.

Defined results: a null or wordless text has no words, no hits and is clean. An item with
fewer than ``n`` words is one window of its own length; an item without words has none.
Repeated items, and items that share a window, all count. Each input row gives one output
row, also where a ``doc_id`` repeats. Empty tables give empty or clean results. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import let, lower_ascii, materialize, text_digest

#: Fixed by the contract: digits, letters, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(hashes: Column, k: int) -> Column:
    """struct(start, k, h) of every window of k words."""
    last = F.size(hashes) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("start"), F.lit(k).alias("k"), F.xxhash64(F.slice(hashes, i + 1, k)).alias("h")))).otherwise(
        F.array().cast("array<struct<start:int,k:int,h:bigint>>"))


def _gram(words: Column, start: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, k), " ")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """gram, k, h, item_id: the distinct windows of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0)
    every = let(F.col("w"), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(
        F.size(h) >= n, _windows(h, n)).otherwise(F.array(F.struct(
            F.lit(0).alias("start"), F.size(h).alias("k"), F.xxhash64(h).alias("h"))))))
    rows = items.select("item_id", "w", F.inline(every))
    return rows.select(_gram(F.col("w"), F.col("start"), F.col("k")).alias("gram"), "k", "h", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    and the positions of the hit words (``hit_words``) and the matched items (``items``).
    """
    pairs = materialize(benchmark_windows(benchmark, n), "grams")
    grams = pairs.groupBy("gram", "k", "h").agg(F.count(F.lit(1)).alias("items"))
    size, = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + 64), F.lit(0))).first()
    lengths = [r.k for r in grams.select("k").distinct().orderBy("k").collect()]  # n of them at most
    small = size <= broadcast_bytes

    def scan(w: Column) -> Column:
        found = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.flatten(F.array(
            F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("h"))),
            *[_windows(h, k) for k in lengths])))
        return F.struct(w.alias("words"), found.alias("windows"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"),
                       let(words(F.col("text")), scan).alias("s"))
    rows = rows.select("row", "doc_id", "s", F.inline("s.windows")).withColumn("n_words", F.size("s.words"))
    # The row with start -1 stands for the document itself, so one join and one grouping do it all.
    none = grams.sparkSession.range(1).select(F.lit(None).cast("string").alias("gram"), F.lit(0).alias("k"),
                                              F.lit(0).cast("bigint").alias("h"))
    table = grams.select("gram", "k", "h").unionByName(none).select(
        "gram", F.col("k").alias("gk"), F.col("h").alias("gh"))
    gram = _gram(F.col("s.words"), F.col("start"), F.col("k"))
    if small:
        agrees = F.col("gram").isNull() | (gram == F.col("gram"))
        hits = rows.join(F.broadcast(table), (F.col("h") == F.col("gh")) & (F.col("k") == F.col("gk")) & agrees)
    else:
        flat = rows.withColumn("words_at", F.when(F.col("start") >= 0, gram)).drop("s")
        hits = flat.join(table, (F.col("h") == F.col("gh")) & (F.col("k") == F.col("gk"))
                         & F.col("words_at").eqNullSafe(F.col("gram")))
    hit = F.col("start") >= 0
    per_doc = materialize(hits.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_set(F.when(hit, F.struct("start", "k")))).alias("hits"),
        F.collect_set(F.when(hit, F.col("gram"))).alias("grams")), "hits")
    items = per_doc.filter(F.size("grams") > 0).select("row", F.explode("grams").alias("gram")).join(
        pairs.select("gram", "item_id"), "gram").groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    out = per_doc.drop("grams").join(items, "row", "left").withColumn("hit_words", F.sort_array(F.array_distinct(
        F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["k"] - 1))))))
    n_hit = F.size("hit_words").cast("bigint")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
                      F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
                      "hit_words", ids.alias("items"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns; id and text name a document."""
    named = docs.select(F.struct(F.col("doc_id").alias("id"), text_digest(F.col("text")).alias("digest")).alias("doc_id"), "text")
    bad = contamination(named, benchmark, n).filter("contaminated").select("doc_id.id", "doc_id.digest").distinct()
    bad = materialize(bad, "bad")
    same = docs["doc_id"].eqNullSafe(bad["id"]) & (text_digest(docs["text"]) == bad["digest"])
    return docs.join(bad, same, "left_anti")


def without(values: Column, dropped: Column) -> Column:
    """The array without the elements at the sorted positions ``dropped``, in linear time."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(values)))
    return let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda j: F.slice(
        values, e[j - 1] + 2, e[j] - e[j - 1] - 1))))


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, text: the texts without the hit words and the separators before them.

    Documents are matched by ``doc_id``, which must be unique here. Null texts stay null.
    """
    report = contamination(docs, benchmark, n).select("doc_id", "hit_words")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(report, "doc_id", "left")
    separators = WORD.replace("[^", "[")[:-1] + "*"
    pieces = F.regexp_extract_all("text", F.lit(separators + WORD), F.lit(0))
    tail = F.regexp_extract("text", separators + "$", 0)
    kept = let(pieces, lambda p: F.array_join(without(p, F.col("hit_words")), ""))
    return rows.select("doc_id", F.when(F.size("hit_words") > 0, F.concat(kept, tail)).otherwise(F.col("text")).alias("text"))
