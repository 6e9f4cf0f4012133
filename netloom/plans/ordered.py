"""Ordered per-key computation that survives hot keys.

A plain window hands every row of a key to one task. That is the best plan while
each key is small (one shuffle, reused by the group-bys above it) and a failing
one when a key holds a large share of the table. Each function here asks for the
size of the largest key first. Up to ``segment_rows`` the plain window is used;
beyond it the sorted table is cut into ranges on (keys, order), the ranges are
stored, and the pieces are joined up again by positions, prefix sums or carried
values that are one row per (key, range). Results are the same either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from netloom.functions.scalars import rank_by_hash
from netloom.session import materialize

SEGMENT_SETTING = "spark.netloom.segmentRows"
SEGMENT_ROWS = 500_000


def segment_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SEGMENT_SETTING, str(SEGMENT_ROWS)))


_sizes: dict[tuple, tuple[int, int]] = {}


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all): one aggregate over the key columns.

    Remembered per plan: a stale answer could cost time, never change a result.
    """
    session = df.sparkSession
    seen = (session.sparkContext.applicationId, df.select(*keys).semanticHash() if keys else df.semanticHash(),
            tuple(keys))
    if seen not in _sizes:
        _sizes[seen] = _measure(df, keys)
    return _sizes[seen]


def _measure(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    sizes = df.groupBy(*keys).count() if keys else df.select(F.count(F.lit(1)).alias("count"))
    top, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return int(top or 0), int(total or 0)


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    return key_sizes(df, keys)[0] > segment_rows(df.sparkSession)


def window(keys: list[str], order: list) -> WindowSpec:
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return spec.orderBy(*order)


def _columns(keys: list[str], order: list) -> list:
    return [F.col(k) for k in keys] + [o if isinstance(o, Column) else F.col(o) for o in order]


def ranges(df: DataFrame, keys: list[str], order: list, total: int | None = None) -> DataFrame:
    """Store df cut into sorted ranges; ``_seg`` numbers them in (keys, order). Without ``total`` Spark sizes them."""
    by = _columns(keys, order)
    if total is None:
        cut = df.repartitionByRange(*by)
    else:
        cut = df.repartitionByRange(max(2, math.ceil(total / segment_rows(df.sparkSession))), *by)
    return materialize(cut.withColumn("_seg", F.spark_partition_id()), "ranges")


def _attach(cut: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row per (key, range) to its range. Nulls in keys match nulls."""
    names = [*keys, "_seg"]
    renamed = small.select(*[F.col(n).alias(f"_j_{n}") for n in names],
                           *[c for c in small.columns if c not in names])
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_j_{n}"))
    return cut.join(renamed, cond, "left").drop(*[f"_j_{n}" for n in names])


HOW = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: list[str], order: list, values: dict[str, Column],
            inclusive: bool = True, how: str = "sum", probe: bool = True) -> DataFrame:
    """Add running sums (or minima, maxima) per key in the given total order.

    Without ``probe`` the table is always cut into ranges, whatever its size.
    """
    agg = HOW[how]
    frame_end = 0 if inclusive else -1
    top, total = key_sizes(df, keys) if probe else (None, None)

    def settle(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) if how == "sum" else c

    def within(names: list[str]) -> dict[str, Column]:
        w = window(names, order).rowsBetween(Window.unboundedPreceding, frame_end)
        return {n: agg(c).over(w) for n, c in values.items()}

    if probe and top <= segment_rows(df.sparkSession):
        return df.withColumns({n: settle(c) for n, c in within(keys).items()})
    cut = ranges(df, keys, order, total)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_seg").agg(*[agg(c).alias(f"_t_{n}") for n, c in values.items()])
    prefix = totals.select(*keys, "_seg", *[agg(f"_t_{n}").over(before).alias(f"_p_{n}") for n in values])
    local = cut.withColumns({f"_l_{n}": c for n, c in within([*keys, "_seg"]).items()})
    out = _attach(local, prefix, keys)
    if how == "sum":
        joined = {n: settle(F.col(f"_l_{n}")) + settle(F.col(f"_p_{n}")) for n in values}
    else:
        pick = F.least if how == "min" else F.greatest  # both skip nulls
        joined = {n: pick(F.col(f"_l_{n}"), F.col(f"_p_{n}")) for n in values}
    return out.withColumns(joined).drop("_seg", *[f"_{x}_{n}" for n in values for x in "lp"])


def positions(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    """row_number per key, one-based."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


HASH_BITS, SLICE_BITS = 60, 12


def hash_positions(df: DataFrame, keys: list[str], seed: int | Column, cols: list[str], name: str = "_rn") -> DataFrame:
    """row_number per key in the order of ``rank_by_hash`` and then ``cols``: one plan for every size.

    A hash is spread evenly, so its leading bits cut a key of any size into 4096 slices of about the
    same size. Rows are numbered inside their slice and moved up by the slices before it.
    """
    sliced = df.withColumn("_hash", rank_by_hash(seed, *cols)).withColumn(
        "_seg", F.shiftright("_hash", HASH_BITS - SLICE_BITS))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    prefix = counts.select(*keys, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_p"))
    placed = sliced.withColumn("_at", F.row_number().over(window([*keys, "_seg"], ["_hash", *cols])))
    out = _attach(placed, prefix, keys)
    return out.withColumn(name, F.col("_at") + F.col("_p")).drop("_hash", "_seg", "_at", "_p")


def carry_last(df: DataFrame, keys: list[str], order: list, values: dict[str, Column],
               inclusive: bool = False) -> DataFrame:
    """Add the latest non-null value seen before (or at) each row of its key."""
    frame_end = 0 if inclusive else -1
    top, total = key_sizes(df, keys)

    def within(names: list[str]) -> dict[str, Column]:
        w = window(names, order).rowsBetween(Window.unboundedPreceding, frame_end)
        return {n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()}

    if top <= segment_rows(df.sparkSession):
        return df.withColumns(within(keys))
    cut = ranges(df, keys, order, total)
    names = [*keys, "_seg"]
    local = cut.withColumns({"_at": F.row_number().over(window(names, order)),
                             **{f"_l_{n}": c for n, c in within(names).items()}})
    ends = local.groupBy(*names).agg(*[
        F.max_by(c, F.when(c.isNotNull(), F.col("_at"))).alias(f"_t_{n}") for n, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_seg", *[
        F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in values])
    out = _attach(local, carried, keys)
    return out.withColumns({n: F.coalesce(f"_l_{n}", f"_p_{n}") for n in values}).drop(
        "_seg", "_at", *[f"_l_{n}" for n in values], *[f"_p_{n}" for n in values])


def bounded(df: DataFrame, keys: list[str], order: list, reach: int,
            build: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Run ``build(df, keys)``, whose windows look at most ``reach`` rows back.

    Hot keys are cut into blocks by position; each block also receives the last
    ``reach`` rows before it, which are dropped again afterwards.
    """
    top, total = key_sizes(df, keys)
    size = segment_rows(df.sparkSession)
    if top <= size:
        return build(df, keys)
    placed = positions(df, keys, order, "_pos").withColumn("_pos", F.col("_pos") - 1)
    home = F.floor(F.col("_pos") / size).cast("long")
    last = F.floor((F.col("_pos") + reach) / size).cast("long")
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, last)))
    return build(spread, [*keys, "_block"]).filter("_home = _block").drop("_pos", "_home", "_block")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per key, without holding a key's values in one task."""
    clean = df.filter(F.col(value).isNotNull())
    if not is_hot(clean, keys):
        return clean.groupBy(*keys).agg(*[F.percentile(value, q).alias(n) for n, q in qs.items()])
    counts = clean.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, keys, ["_v"], {"_hi": F.col("_n")})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        placed = placed.join(sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total"),
                             _key_match(keys), "inner").drop(*[f"_k_{k}" for k in keys])
    else:
        placed = placed.crossJoin(sizes)
    aggs = []
    for n, q in qs.items():
        at = (F.col("_total") - 1) * F.lit(q)
        lo, hi = F.floor(at), F.ceil(at)

        def value_at(i: Column) -> Column:
            return F.max(F.when((F.col("_hi") > i) & (F.col("_hi") - F.col("_n") <= i), F.col("_v")))

        part = F.max(at - lo)
        aggs.append((value_at(lo) + (value_at(hi) - value_at(lo)) * part).alias(n))
    return placed.groupBy(*keys).agg(*aggs)


def _key_match(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Join per-key aggregates back to the rows (partial aggregation, splittable join)."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggs.items()])))
    small = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    small = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *aggs.keys())
    return df.join(small, _key_match(keys), "left").drop(*[f"_k_{k}" for k in keys])


def first_rows(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """Top n rows per key. Spark's group limit keeps at most n rows per key and task."""
    w = window(keys, order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def trailing(df: DataFrame, keys: list[str], ts: str, id_col: str, width: int, *,
             sums: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None,
             maxes: dict[str, Column] | None = None) -> DataFrame:
    """Aggregates over the rows of the key in [ts - width, ts], up to and including the row.

    Linear in the rows whatever the frame holds: sums are differences of running sums, the
    first row of the frame is found by sorting a probe at ts - width among the rows, and a
    maximum is the running one of the row's block of ``width`` and the suffix of the block before.
    """
    sums, firsts, maxes = sums or {}, firsts or {}, maxes or {}
    order, blocks = [ts, id_col], [*keys, "_block"]
    out = df.withColumns({f"_c_{n}": c for n, c in {**sums, **maxes, **firsts}.items()})
    out = running(out, keys, order, {f"_s_{n}": F.col(f"_c_{n}") for n in sums})
    if maxes:
        out = out.withColumn("_block", F.expr(f"{ts} div {int(width)}L"))
        out = running(out, blocks, order, {f"_u_{n}": F.col(f"_c_{n}") for n in maxes}, how="max")
        out = running(out, blocks, [F.desc(ts), F.desc(id_col)],
                      {f"_d_{n}": F.col(f"_c_{n}") for n in maxes}, how="max")
    else:
        out = out.withColumn("_block", F.lit(0).cast("long"))
    mark = F.struct(F.col("_block").alias("block"), F.col(ts).alias("ts"),
                    *[(F.col(f"_s_{n}") - F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(f"s_{n}") for n in sums],
                    *[F.col(f"_c_{n}").alias(f"f_{n}") for n in firsts],
                    *[F.col(f"_d_{n}").alias(f"m_{n}") for n in maxes])
    rows = out.withColumns({"_at": F.col(ts), "_row": F.lit(1), "_mark": mark})
    probes = out.withColumns({"_at": F.col(ts) - F.lit(int(width)), "_row": F.lit(0),
                              "_mark": F.lit(None).cast(rows.schema["_mark"].dataType)})
    found = carry_last(rows.unionByName(probes), keys,
                       [F.desc("_at"), F.desc("_row"), F.desc(id_col)], {"_start": F.col("_mark")})
    found = found.filter("_row = 0")
    result = {n: F.col(f"_s_{n}") - F.col("_start")[f"s_{n}"] for n in sums}
    result |= {n: F.col("_start")[f"f_{n}"] for n in firsts}
    result |= {n: F.greatest(F.col(f"_u_{n}"), F.when(F.col("_start")["block"] < F.col("_block"),
                                                      F.col("_start")[f"m_{n}"])) for n in maxes}
    return found.withColumns(result).select(*df.columns, *result)
