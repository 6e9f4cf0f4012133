"""Flow sequences and the targets used to measure what released data gives away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import C, clip, clip01, col, flag, rank_by_hash
from netloom.operators.privacy import rank_levels
from netloom.operators.splits import split_columns
from netloom.plans.ordered import bounded, hash_positions, positions, running, window, with_group

ORDER = ["timestamp_end", "flow_id"]
GROUP = ["app_id", "dataset_source", "environment_id", "session_id"]


def port_bucket(c: C) -> Column:
    p = F.coalesce(col(c).try_cast("double"), F.lit(0.0))
    return F.when(p <= 1023, 0.0).when(p <= 49151, 0.5).otherwise(1.0)


def protocol_code(c: C) -> Column:
    p = F.upper(F.coalesce(col(c), F.lit("")))
    return F.when(p.contains("TCP"), 1.0).when(p.contains("UDP"), 0.5).otherwise(0.0)


STEP_COLUMNS = ["log_total_bytes", "signed_byte_delta", "log_duration_ms", "log_interarrival_ms", "novelty_score",
                "dst_port_bucket", "protocol_code"]


def sequence_steps(flows: DataFrame) -> DataFrame:
    """Per-flow step values with the position inside the group (from zero)."""
    def n(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    size = n("bytes_out") + n("bytes_in")
    base = split_columns(flows).withColumns({
        "total_bytes": size,
        "log_total_bytes": F.log1p(clip(size, 0)),
        "signed_byte_delta": F.log1p(clip(n("bytes_out"), 0)) - F.log1p(clip(n("bytes_in"), 0)),
        "duration_ms": clip(n("duration_ms"), 0),
        "log_duration_ms": F.log1p(clip(n("duration_ms"), 0)),
        "novelty_score": clip01(n("dst_novelty")),
        "dst_port_bucket": port_bucket("dst_port"),
        "protocol_code": protocol_code("protocol"),
        "outbound_ratio": n("bytes_out") / (size + 1.0),
        "high_port_flag": flag(n("dst_port") >= 1024),
    })

    def gaps(part: DataFrame, keys: list[str]) -> DataFrame:
        before = F.lag("timestamp_end").over(window(keys, ORDER))
        return part.withColumn("interarrival_ms", clip(F.coalesce(F.col("timestamp_end") - before, F.lit(0)), 0))

    out = positions(bounded(base, GROUP, ORDER, 1, gaps), GROUP, ORDER, "_pos")
    return out.withColumns({"_pos": F.col("_pos") - 1, "log_interarrival_ms": F.log1p("interarrival_ms")})


def flow_sequences(flows: DataFrame, length: int, stride: int = 0, min_len: int = 4, cap: int = 0) -> DataFrame:
    """Overlapping chunks of a group's flows, flattened to length x 7 step columns and 8 summaries.

    Each flow goes to the chunks that cover it; a chunk never holds more than ``length`` flows,
    so group size does not matter.
    """
    stride = max(1, stride if stride > 0 else length)
    steps = sequence_steps(flows)
    first = F.greatest(F.lit(0), F.ceil((F.col("_pos") - length + 1) / stride)).cast("long")
    last = F.floor(F.col("_pos") / stride).cast("long")
    spread = steps.filter(first <= last).withColumn("_chunk", F.explode(F.sequence(first, last)))
    item = F.struct("_pos", *STEP_COLUMNS)
    chunks = spread.groupBy(*GROUP, "_chunk").agg(
        F.array_sort(F.collect_list(item)).alias("_steps"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("app_family", "_pos").alias("app_family"), F.min_by("time_fold", "_pos").alias("time_fold"),
        F.log1p(F.sum("total_bytes")).alias("seq_log_total_bytes"),
        F.log1p(F.avg("duration_ms")).alias("seq_log_mean_duration_ms"),
        F.log1p(F.avg("interarrival_ms")).alias("seq_log_mean_interarrival_ms"),
        F.avg("novelty_score").alias("seq_novelty_mean"),
        F.avg("outbound_ratio").alias("seq_outbound_ratio_mean"),
        F.avg("high_port_flag").alias("seq_high_port_ratio"),
        F.size(F.collect_set("protocol_code")).alias("_protocols"))
    chunks = chunks.filter(F.col("_n") >= min_len)
    if cap > 0:
        chunks = positions(chunks, GROUP, ["_chunk"], "_rn").filter(F.col("_rn") <= cap).drop("_rn")
    start = F.col("_chunk") * stride
    out = chunks.withColumns({
        "sequence_id": F.concat_ws("|", *GROUP, start.cast("string")),
        "capture_group": F.concat_ws("|", "dataset_source", "environment_id", "session_id"),
        "seq_flow_fraction": F.col("_n") / float(length),
        "seq_protocol_diversity": F.col("_protocols") / F.col("_n"),
        **{f"s{i:02d}_{c}": F.coalesce(F.get("_steps", F.lit(i))[c], F.lit(0.0))
           for i in range(length) for c in STEP_COLUMNS},
    })
    return out.drop("_steps", "_n", "_chunk", "_protocols")


def target_frame(df: DataFrame, target: str, min_rows: int, max_rows: int = 0, order: list | None = None) -> DataFrame:
    """Rows of classes with enough rows, and at most the first ``max_rows`` of each."""
    out = with_group(df, [target], _n=F.count(F.lit(1))).filter(F.col("_n") >= min_rows).drop("_n")
    if max_rows > 0:
        out = positions(out, [target], order or ["id"], "_rn").filter(F.col("_rn") <= max_rows).drop("_rn")
    return out


def context_bucket(df: DataFrame) -> DataFrame:
    return split_columns(df).withColumn("context_bucket", F.concat_ws("|", "environment_id", "time_fold"))


def behaviour_bucket(df: DataFrame, buckets: int = 3) -> DataFrame:
    """Destination behaviour class from rank buckets of four window features."""
    parts = {"nov": "novelty_score", "div": "destination_diversity", "port": "high_port_ratio",
             "beacon": "periodic_beacon_score"}
    out = rank_levels(df, {f"_{p}": F.col(c) for p, c in parts.items()}, max(2, buckets), ids=True)
    text = F.concat_ws("|", *[F.concat(F.lit(p), F.col(f"_{p}").cast("int").cast("string")) for p in parts])
    return out.withColumn("behaviour_bucket", text).drop(*[f"_{p}" for p in parts])


def cap_classes(df: DataFrame, column: str, k: int, other: str = "__other__") -> DataFrame:
    """Keep the k - 1 largest classes; the rest share one name (only if there are more than k)."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(other)).alias("_c")).count()
    counts = with_group(counts, [], _kinds=F.count(F.lit(1)))
    kept = counts.orderBy(F.desc("count"), F.asc("_c")).limit(k).withColumn(
        "_rn", F.row_number().over(window([], [F.desc("count"), F.asc("_c")])))
    kept = kept.filter((F.col("_kinds") <= k) | (F.col("_rn") <= max(1, k - 1))).select("_c")
    named = df.withColumn(column, F.coalesce(F.col(column), F.lit(other)))
    out = named.join(F.broadcast(kept), F.col(column) == F.col("_c"), "left")
    return out.withColumn(column, F.when(F.col("_c").isNotNull(), F.col(column)).otherwise(other)).drop("_c")


def class_holdout(df: DataFrame, target: str, groups: list[str], frac: float = 0.3, seed: int = 42,
                  id_col: str = "id") -> DataFrame:
    """Per class, whole groups in hash order go to the test side until it has ``frac`` of the rows.

    A class with one group is split by rows instead; every class keeps a training row.
    """
    base = split_columns(df)
    key = F.concat_ws("|", *[F.coalesce(F.nullif(F.col(g).cast("string"), F.lit("")), F.lit(f"unknown_{g}")) for g in groups])
    base = base.withColumn("_g", key)
    sizes = base.groupBy(target, "_g").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = with_group(sizes, [target], _class=F.sum("_rows"), _groups=F.count(F.lit(1)))
    placed = running(sizes, [target], [rank_by_hash(seed, target, "_g"), F.col("_g")], {"_upto": F.col("_rows")})
    want = F.greatest(F.lit(1), F.round(F.col("_class") * frac))
    test = (F.col("_upto") - F.col("_rows") < want) & (F.col("_upto") < F.col("_class"))
    side = placed.select(F.col(target).alias("_t"), F.col("_g").alias("_h"), "_class", "_groups",
                         test.alias("_test"))
    anyone = placed.groupBy(F.col(target).alias("_t2")).agg(F.max(test.cast("int")).alias("_any"))
    out = base.join(side, (F.col(target) == F.col("_t")) & (F.col("_g") == F.col("_h")), "left").join(
        anyone, F.col(target) == F.col("_t2"), "left")
    out = hash_positions(out, [target], seed, [id_col])
    by_row = F.col("_rn") <= F.least(want, F.col("_class") - 1)
    chosen = F.when(F.col("_any") == 1, F.col("_test")).otherwise(by_row)
    out = out.filter(F.col("_class") >= 2).withColumn("split", F.when(chosen, "test").otherwise("train"))
    return out.drop("_g", "_t", "_h", "_class", "_groups", "_test", "_t2", "_any", "_rn")


def multiclass_metrics(pred: DataFrame, truth: str = "truth", guess: str = "guess", classes: int | None = None,
                       by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy, chance and leakage from (truth, guess) counts."""
    by = by or []
    cells = pred.groupBy(*by, truth, guess).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(truth) == F.col(guess), F.col("_n")).otherwise(0)
    rows = cells.groupBy(*by, F.col(truth).alias("_c")).agg(F.sum("_n").alias("_support"), F.sum(hit).alias("_tp"))
    cols = cells.groupBy(*by, F.col(guess).alias("_c")).agg(F.sum("_n").alias("_predicted"))
    both = rows.join(cols, [*by, "_c"], "full").fillna(0, ["_support", "_tp", "_predicted"])
    f1 = F.try_divide(2.0 * F.col("_tp"), (F.col("_support") + F.col("_predicted")).cast("double"))
    recall = F.when(F.col("_support") > 0, F.col("_tp") / F.col("_support"))
    out = both.groupBy(*by).agg(
        F.sum("_support").alias("rows"), F.count_if(F.col("_support") > 0).alias("classes"),
        (F.sum("_tp") / F.sum("_support")).alias("accuracy"), F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"),
        F.avg(recall).alias("balanced_accuracy"))
    k = F.lit(classes) if classes else F.col("classes")
    chance = 1.0 / F.greatest(F.lit(1), k)
    return out.withColumns({
        "chance": chance,
        "normalized_leakage": F.when(k > 1, F.greatest(F.lit(0.0), (F.col("accuracy") - chance) / (1.0 - chance)))})
