"""Line deduplication over levelled sorted runs of line digests.

Each batch of documents is combined to one row per digest (documents holding the line, largest
document holding it) and merge-joined with the runs. Digests that no run holds enter as the batch's
own sorted run; known digests go to a log of updates, so a digest is in one run only. When a level
has ``fanout`` runs they are merged into one run of the next level, so a batch meets a logarithmic
number of runs. ``unseen`` is the anti-join alone (keep-first, for incremental feeds);
``drop_repeated`` applies the corpus rule: lines found in at least ``min_docs`` documents stay only
in the largest document holding them. A stored corpus is read in ``batches`` equal parts whatever
its size: each part reads the runs of all earlier ones, so more parts would cost their square.

Defined results: a null or empty text is one empty line. Lines are compared by a key (white
space stripped, A-Z lower-cased); keys below ``min_chars`` code points are never dropped. All
lines of a repeated key go, also several in one document. Rows that agree in id and text are
one document; rows with one id and different texts are counted apart. A null id counts as
a document and is never the largest unless all are null. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import let, lower_ascii, materialize, row_key
from netloom.llm.decontaminate import without
from netloom.session import shared_dir

#: Fixed by the contract: space and \\x09-\\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    # A lambda body must not hold a regular expression per line: split once per document.
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Sorted runs in the shared folder: (digest, n_docs, keep_doc); a digest is in one run."""

    SCHEMA = "digest binary, n_docs bigint, keep_doc bigint"

    def __init__(self, spark: SparkSession, fanout: int = 4, folder: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/netloom-lines-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.updates: list[str] = []

    def _read(self, paths: list[str], known: bool) -> DataFrame:
        out = self.spark.range(0).selectExpr("cast(null AS binary) AS digest", "id AS n_docs", "id AS keep_doc")
        for path in paths:
            rows = self.spark.read.schema(f"{self.SCHEMA}, known boolean").parquet(path)
            out = out.unionByName(rows.filter(F.col("known") == known).drop("known"))
        return out

    def _runs(self) -> list[str]:
        return [p for level in reversed(self.levels) for p in level]

    def _store(self, run: DataFrame, level: int) -> str:
        path = f"{self.folder}/level={level}/{uuid.uuid4().hex}"
        run.sortWithinPartitions("known", "digest").write.partitionBy("known").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._read(self.levels[level], known=False).repartitionByRange("digest")
            self.levels[level] = []
            self._store(merged.withColumn("known", F.lit(False)), level + 1)
        return path

    def add(self, lines: DataFrame) -> None:
        """Add a batch of distinct (digest, row key, doc_id): new digests as a run, known ones as updates."""
        own = lines.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"),
                                          F.max("doc_id").cast("bigint").alias("keep_doc"))
        known = F.lit(False)
        if self._runs():
            held = self._read(self._runs(), known=False).select(F.col("digest").alias("held"))
            own = own.join(held.hint("merge"), F.col("digest") == F.col("held"), "left")
            known = F.col("held").isNotNull()
        self.updates.append(self._store(own.withColumn("known", known).drop("held"), 0))

    def totals(self) -> DataFrame:
        every = self._read(self._runs(), known=False).unionByName(self._read(self.updates, known=True))
        return every.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.max("keep_doc").alias("keep_doc"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines whose digest no run holds, level by level from the largest run down."""
        for path in self._runs():
            run = self._read([path], known=False).select("digest")
            lines = lines.join(run.hint("merge"), "digest", "left_anti")
        return lines


def line_rows(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """row, doc_id, line_no, digest of every line whose key is long enough."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").alias("doc_id"),
                       F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
    rows = rows.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return rows.filter(F.char_length("key") >= min_chars).select(
        "row", "doc_id", "line_no", F.unhex(F.md5("key")).alias("digest"))


def repeated(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 4) -> DataFrame:
    """row, line_nos: the sorted positions of the lines each document loses."""
    spark = docs.sparkSession
    lines = line_rows(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))
    path = f"{shared_dir(spark).rstrip('/')}/netloom-line-rows-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(lines.schema).option("basePath", path).parquet(path)
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(stored.filter(F.col("batch") == batch).select("digest", "row", "doc_id").distinct())
    # Stored first: with a plain exchange on either side Spark can split the partition of a very common line.
    often = materialize(runs.totals().filter(F.col("n_docs") >= min_docs).select("digest", "keep_doc"), "often")
    gone = stored.join(often, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    return gone.groupBy("row").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))


def drop_repeated(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without its repeated lines."""
    gone = materialize(repeated(docs, min_docs, min_chars, batches), "repeated")
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).join(gone, "row", "left")
    n_dropped = F.coalesce(F.size("line_nos"), F.lit(0))
    text = F.when(F.col("line_nos").isNull(), F.col("text")).otherwise(
        let(_lines(F.col("text")), lambda v: F.array_join(without(v, F.col("line_nos")), "\n")))
    n_lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", n_lines.cast("bigint").alias("n_lines"),
                       F.when(F.col("line_nos").isNull(), 0).otherwise(n_dropped).cast("bigint").alias("n_dropped"),
                       text.alias("text"))
