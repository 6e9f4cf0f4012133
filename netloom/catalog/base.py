"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.session import shared_dir, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def nudge(sql: str) -> str:
    """round(x, 6) -> round((x) + 1e-10, 6): a value whose seventh digit is an exact half then
    rounds the same way whatever the order of summation. The Spark side adds the same amount."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        body = sql[j + 6:k - 1]
        if body.endswith(", 6"):
            out.append(sql[i:j] + "round((" + nudge(body[:-3]) + ") + 1e-10, 6)")
        else:
            out.append(sql[i:j] + "round(" + nudge(body) + ")")
        i = k


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with its SQL counterpart if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudge(sql)
        return fn

    return register


_staged: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table many queries start from: built by Spark once per session, stored, read back."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _staged:
        import uuid

        path = f"{shared_dir(spark)}/netloom-{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])
