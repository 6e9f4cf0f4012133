"""Running composition of functions per key, in the JVM.

A recurrence x' = f(x) whose steps come from a family that is closed under composition (clamps
``min(ceiling, max(floor, x + shift))``, affine maps ``factor * x + offset``) needs no loop: the
state after a row is the composition of all steps up to it. The sorted table is stored in ranges;
inside a range rows combine in blocks of 1024 by pointer doubling (ten lags), blocks combine the
same way, and what is left of a key, one row per 2^20 rows and range, is combined last, by as many doublings as
that table needs. A key may
hold any share of the rows: no task sees more of it than one range, and no row holds an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from netloom.plans.ordered import _columns
from netloom.session import materialize

Maps = dict[str, Column]
PASSES = 10  # a block: 2 ** PASSES rows


def clamp(shift: Column, floor: Column, ceiling: Column, name: str = "") -> Maps:
    return {f"{name}shift": shift, f"{name}floor": floor, f"{name}ceiling": ceiling}


def then_clamp(first: Maps, second: Maps, name: str = "") -> Maps:
    """``second`` after ``first``; both are x -> min(ceiling, max(floor, x + shift))."""
    shift, floor, ceiling = (second[f"{name}{part}"] for part in ("shift", "floor", "ceiling"))

    def applied(x: Column) -> Column:
        return F.least(ceiling, F.greatest(floor, x + shift))

    return clamp(first[f"{name}shift"] + shift, applied(first[f"{name}floor"]), applied(first[f"{name}ceiling"]), name)


def affine(factor: Column, offset: Column, name: str = "") -> Maps:
    return {f"{name}factor": factor, f"{name}offset": offset}


def then_affine(first: Maps, second: Maps, name: str = "") -> Maps:
    """``second`` after ``first``; both are x -> factor * x + offset."""
    f, o = f"{name}factor", f"{name}offset"
    return affine(first[f] * second[f], second[f] * first[o] + second[o], name)


def _doublings(n: int) -> int:
    """Passes that reach over n rows."""
    return max(0, n - 1).bit_length()


def _doubled(rows: DataFrame, names: list[str], compose: Callable[[Maps, Maps], Maps], spec: WindowSpec,
             place: Column, passes: int) -> DataFrame:
    """Compose each row with the rows before it, back to the row where ``place`` is 0."""
    for reach in (1 << p for p in range(passes)):
        rows = rows.withColumns({f"_p_{n}": F.lag(n, reach).over(spec) for n in names})
        whole = compose({n: F.col(f"_p_{n}") for n in names}, {n: F.col(n) for n in names})
        rows = rows.withColumns({n: F.when(place >= reach, whole[n]).otherwise(F.col(n)) for n in names})
        rows = rows.drop(*[f"_p_{n}" for n in names])
    return rows


def _after(rows: DataFrame, earlier: DataFrame, on: str, names: list[str],
           compose: Callable[[Maps, Maps], Maps]) -> DataFrame:
    """Put the one row of ``earlier`` with the same ``on``, where there is one, before each row."""
    earlier = earlier.select(F.col(on).alias("_on"), *[F.col(n).alias(f"_e_{n}") for n in names])
    out = rows.join(earlier, F.col(on) == F.col("_on"), "left")
    whole = compose({n: F.col(f"_e_{n}") for n in names}, {n: F.col(n) for n in names})
    return out.withColumns({n: F.when(F.col("_on").isNotNull(), whole[n]).otherwise(F.col(n)) for n in names}).drop(
        "_on", *[f"_e_{n}" for n in names])


def scan(df: DataFrame, keys: list[str], order: list, maps: Maps, compose: Callable[[Maps, Maps], Maps],
         first: Maps | None = None, ranges: int | None = None) -> DataFrame:
    """Add the columns of ``maps``, composed over all rows of the key up to and including the row.

    ``compose(earlier, later)`` must be associative. ``first`` replaces the maps on the first row of
    a key. Null keys are one key; rows that tie in ``order`` follow each other in any order.
    ``ranges`` is the number of cuts; by default Spark sizes them.
    """
    names, block = list(maps), 1 << PASSES
    steps = {f"_m_{n}": c for n, c in maps.items()} | {f"_f_{n}": c for n, c in (first or {}).items()}
    by = _columns(keys, order)
    cut = df.withColumns(steps)
    cut = cut.repartitionByRange(ranges, *by) if ranges else cut.repartitionByRange(*by)
    # Ids follow the order inside a range, so (range, id) replaces the order from here on.
    cut = materialize(cut.sortWithinPartitions(*by).withColumn("_rid", F.monotonically_increasing_id()), "scan")
    n_rows = cut.count()  # of a stored table: reads no column
    rows = cut.select(*keys, "_rid", F.shiftright("_rid", 33).alias("_seg"), *steps)
    if first:
        starts = rows.groupBy(*keys).agg(F.min("_rid").alias("_start")).select("_start")
        rows = rows.join(starts, F.col("_rid") == F.col("_start"), "left")
        rows = rows.withColumns({f"_m_{n}": F.when(F.col("_start").isNotNull(), F.col(f"_f_{n}")).otherwise(
            F.col(f"_m_{n}")) for n in names})
    rows = rows.select(*keys, "_seg", "_rid", *[F.col(f"_m_{n}").alias(n) for n in names])

    spec = Window.partitionBy(*keys, "_seg").orderBy("_rid")
    rows = rows.withColumns({"_at": F.row_number().over(spec) - 1, "_last": F.lead("_rid").over(spec).isNull()})
    place = F.col("_at") % block
    rows = _doubled(rows, names, compose, spec, place, min(PASSES, _doublings(n_rows))).withColumn(
        "_block", F.col("_rid") - place)
    rows = materialize(rows, "scan-rows")  # read twice below

    # One row per block, then one per 1024 blocks. Both carry the id of their first row.
    spec = Window.partitionBy(*keys, "_seg").orderBy("_block")
    blocks = rows.filter(F.col("_last") | (place == block - 1)).withColumn("_nr", F.floor(F.col("_at") / block))
    place = F.col("_nr") % block
    passes = min(PASSES, _doublings(-(-n_rows // block)))
    blocks = _doubled(blocks, names, compose, spec, place, passes).withColumn("_top", F.col("_block") - place * block)
    blocks = materialize(blocks, "scan-blocks")
    tops = materialize(blocks.filter(F.col("_last") | (place == block - 1)).select(*keys, "_top", *names), "scan-tops")
    spec = Window.partitionBy(*keys).orderBy("_top")
    tops = tops.withColumn("_nr", F.row_number().over(spec) - 1)
    tops = _doubled(tops, names, compose, spec, F.col("_nr"), _doublings(tops.count()))
    before = materialize(tops.withColumns({n: F.lag(n).over(spec) for n in names}).filter("_nr > 0"), "scan-before")

    # What lies before a block: earlier blocks of its 1024, and everything before those.
    spec = Window.partitionBy(*keys, "_seg").orderBy("_block")
    inside = blocks.withColumns({n: F.lag(n).over(spec) for n in names}).filter(place > 0)
    opening = blocks.filter(place == 0).select("_block", "_top").join(before, "_top")
    earlier = _after(inside, before, "_top", names, compose).select("_block", *names).unionByName(
        opening.select("_block", *names))
    done = _after(rows.select("_rid", "_block", *names), earlier, "_block", names, compose)
    return cut.drop(*steps).join(done.drop("_block"), "_rid").drop("_rid")
