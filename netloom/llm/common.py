"""Expressions and small helpers the text operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import materialize, tune

__all__ = ["let", "lower_ascii", "materialize", "prepare", "read", "row_key", "text_digest", "unique"]

#: Rows of one Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of these operators."""
    tune(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")  # Spark's own, as the figures were measured
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the byte-wise built-in."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a document in joins: rows with one id and one text are one document."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("hash"))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; a null text counts as empty. With the id, it names a document also where ids repeat."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unique(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before each until none is a column already."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
