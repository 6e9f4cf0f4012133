"""Exact deduplication of whole texts.

Copies are combined in three steps, each of which compares the full text and not only its
digest: inside a task, per (digest, salt), and once more over the salts. A group of copies,
however large, reaches the last step as at most ``salts`` rows.

Defined results: a null text counts as empty (``text_sha256`` of the empty string). Of equal
texts the largest ``doc_id`` stays; a null id never wins over another. Rows that agree in
both id and text are one document: they all carry the same answer, and ``keep`` lets one through. An empty table gives no
rows. Extra columns are not read; ``keep`` passes them through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import materialize


def _texts(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))


def copy_groups(docs: DataFrame, text: Column | None = None, salts: int = 16,
                digest: Column | None = None) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size, and how many texts share the
    digest (``same_digest``). The text itself is kept only where that is more than one.

    ``digest`` may name another digest of the column ``text`` (tests use a weak one).
    """
    rows = _texts(docs, F.col("text") if text is None else text)
    if digest is not None:
        rows = rows.withColumn("digest", digest)
    # A task's salt is constant, so its own copies become one row before the first shuffle.
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    local = salted.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # At most `salts` rows of a text are left: dealing them out by digest cannot be skewed,
    # and both the last grouping and the count of texts per digest use that one exchange.
    whole = local.repartition("digest").groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    whole = whole.withColumn("same_digest", F.count(F.lit(1)).over(Window.partitionBy("digest")))
    return whole.select("digest", "keep_id", "group_size", "same_digest",
                        F.when(F.col("same_digest") > 1, F.col("text")).alias("text"))


def exact_dedup(docs: DataFrame, text: Column | None = None, salts: int = 16,
                digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = materialize(copy_groups(docs, text, salts, digest), "copies")
    rows = _texts(docs, F.col("text") if text is None else text).withColumn("sha", F.col("digest"))
    if digest is not None:
        rows = rows.withColumn("digest", digest)
    one = groups.filter("same_digest = 1").drop("text", "same_digest")
    out = rows.drop("text").join(one, "digest")
    many = groups.filter("same_digest > 1").drop("same_digest")
    if not many.isEmpty():  # different texts with one digest: the text decides
        out = out.unionByName(rows.join(many, ["digest", "text"]).drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def keep(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The documents that stay, with all their columns; of rows that agree in id and text, one."""
    groups = materialize(copy_groups(docs, salts=salts), "copies")
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    same = docs["doc_id"].eqNullSafe(groups["keep_id"]) & (digest == groups["digest"])
    stay = docs.join(groups.select("keep_id", "digest"), same, "left_semi")
    # Ids seldom repeat with their text: only ids and digests are shuffled to find out.
    named = stay.select(F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("own"))
    again = materialize(named.groupBy("id", "own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    if again.isEmpty():
        return stay
    repeated = stay["doc_id"].eqNullSafe(again["id"]) & (F.unhex(F.sha2(F.coalesce(stay["text"], F.lit("")), 256)) == again["own"])
    # Combined in the tasks first, so a row repeated any number of times is one row a task.
    one = stay.join(again, repeated).groupBy("id", "own").agg(F.first(F.struct(*[stay[c] for c in docs.columns])).alias("row"))
    return stay.join(again, repeated, "left_anti").unionByName(one.select("row.*"))
