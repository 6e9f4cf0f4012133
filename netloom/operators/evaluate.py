"""Detection metrics, threshold choice, reports and audits over (label, score) columns.

Curves are built from one row per distinct score, so sorting and prefix sums work on the
distinct scores. Sweeps count rows per threshold step first; nothing joins rows to thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.functions.scalars import clip, clip01, flag, ratio
from netloom.plans.ordered import bounded, exact_quantiles, first_rows, positions, running, window, with_group

PR = ["precision", "recall", "f1", "false_positive_rate"]


def confusion_columns(label: str, predicted: Column) -> dict[str, Column]:
    y = F.col(label) == 1
    return {
        "tp": F.count_if(predicted & y), "fp": F.count_if(predicted & ~y),
        "fn": F.count_if(~predicted & y), "tn": F.count_if(~predicted & ~y),
    }


def rate_columns() -> dict[str, Column]:
    """Precision, recall, F1 and FPR from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a, b), F.lit(0.0))

    return {
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "f1": safe(2.0 * tp, 2.0 * tp + fp + fn),
        "false_positive_rate": fp / F.greatest(F.lit(1.0), fp + tn),
    }


def binary_metrics(df: DataFrame, threshold: float | str, by: list[str] | None = None,
                   label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts and rates at a threshold (a number or a column)."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    counts = df.groupBy(*(by or [])).agg(
        *[c.alias(n) for n, c in confusion_columns(label, F.col(score) >= t).items()])
    return counts.withColumns(rate_columns()).withColumn("positive_predictions", F.col("tp") + F.col("fp"))


def score_counts(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))


def curve(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """Cumulative rows and true positives at each distinct score, with the group's totals."""
    by = by or []
    counts = score_counts(df, by, label, score)
    summed = running(counts, by, [F.col("_s").desc()], {"_cn": F.col("_n"), "_ctp": F.col("_p")})
    return with_group(summed, by, _tot=F.sum("_n"), _tot_pos=F.sum("_p"))


def roc_auc(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area by average ranks; null unless both classes occur."""
    c = curve(df, by, label, score)
    rank = F.col("_tot") - F.col("_cn") + (F.col("_n") + 1) / 2.0
    out = c.groupBy(*(by or [])).agg(
        F.sum(F.col("_p") * rank).alias("_r"), F.first("_tot").alias("_tot"), F.first("_tot_pos").alias("_tot_pos"))
    pos, neg = F.col("_tot_pos").cast("double"), (F.col("_tot") - F.col("_tot_pos")).cast("double")
    return out.select(*(by or []), ratio(F.col("_r") - pos * (pos + 1) / 2.0, pos * neg).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str] | None = None, label: str = "label",
                      score: str = "score") -> DataFrame:
    c = curve(df, by, label, score)
    step = ratio(F.col("_p"), F.col("_tot_pos")) * (F.col("_ctp") / F.col("_cn"))
    return c.groupBy(*(by or [])).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def brier(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    d = clip01(score) - F.col(label)
    return df.groupBy(*(by or [])).agg(F.avg(d * d).alias("brier_score"))


def _bin(score: str, bins: int) -> Column:
    return F.least(F.floor(clip01(score) * bins), F.lit(bins - 1)).cast("int")


def ece(df: DataFrame, bins: int = 10, by: list[str] | None = None, label: str = "label",
        score: str = "score") -> DataFrame:
    by = by or []
    per_bin = df.groupBy(*by, _bin(score, bins).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_acc"), F.avg(clip01(score)).alias("_conf"))
    return per_bin.groupBy(*by).agg(
        (F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))) / F.sum("_n")).alias("ece"))


def calibration_bins(df: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """All bins, empty ones included."""
    per_bin = df.groupBy(_bin(score, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(clip01(score)).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(F.broadcast(per_bin), "bin", "left").fillna(0, ["rows", "mean_score", "positive_rate"])
    return out.withColumns({"lower": F.col("bin") / bins, "upper": (F.col("bin") + 1) / bins})


def threshold_sweep(df: DataFrame, steps: int = 201, by: list[str] | None = None, label: str = "label",
                    score: str = "score") -> DataFrame:
    """Rates at ``steps`` equally spaced thresholds in [0, 1] for every group."""
    by = by or []
    width = 1.0 / (steps - 1)

    def at(i: Column) -> Column:
        return F.when(i >= steps - 1, F.lit(1.0)).otherwise(i * F.lit(width))

    s = F.col(score)
    guess = F.floor(s * (steps - 1)).cast("int")
    exact = guess + F.when(at(guess + 1) <= s, 1).otherwise(0) - F.when(at(guess) > s, 1).otherwise(0)
    step = F.when(s >= 1.0, steps - 1).when(s < 0, -1).otherwise(exact)
    counts = df.groupBy(*by, step.alias("_i")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    # At most steps + 1 rows per group from here on.
    whole = Window.partitionBy(*by)
    groups = counts.groupBy(*by).agg(F.sum("_n").alias("_tot"), F.sum("_p").alias("_tot_pos"))
    grid = groups.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    joined = grid.join(counts, [*by, "_i"], "left").fillna(0, ["_n", "_p"])
    above = whole.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({"tp": F.sum("_p").over(above), "_hit": F.sum("_n").over(above)})
    out = out.withColumn("fp", F.col("_hit") - F.col("tp"))
    out = out.withColumns({"fn": F.col("_tot_pos") - F.col("tp"),
                           "tn": F.col("_tot") - F.col("_tot_pos") - F.col("fp"),
                           "threshold": at(F.col("_i"))})
    return out.withColumns(rate_columns()).select(
        *by, F.col("_i").alias("step"), "threshold", F.col("_hit").alias("positive_predictions"),
        "tp", "fp", "fn", "tn", *PR)


# Threshold policies. Tiers are tried in order; the first that any threshold
# meets is used. Limits are (precision at least, recall at least, FPR at most).
@dataclass(frozen=True)
class Policy:
    tiers: tuple
    order: tuple


def _service(p: float, r: float, f: float, order: tuple = ("-f1", "-recall", "-precision")) -> Policy:
    return Policy(((p, r, f), (None, r, f), (None, None, f), (None, None, None)), order)


def _budget(p: float, r: float, f: float, order: tuple) -> Policy:
    return Policy(((p, r, f), (p, None, f), (None, None, f), (None, None, None)), order)


POLICIES = {
    "max_f1": Policy(((None, None, None),), ("-f1", "-precision", "-recall")),
    "policy": _budget(0.55, 0.50, 0.10, ("-recall", "-f1", "-precision")),
    "hard_mining": _budget(0.55, 0.40, 0.035, ("-f1", "-recall", "-precision")),
    "family_service": _budget(0.80, 0.45, 0.08, ("-f1", "-recall", "-precision")),
    "family_malware": _budget(0.60, 0.55, 0.15, ("-f1", "-recall", "-precision")),
    "family_other": _budget(0.35, 0.25, 0.02, ("-f1", "-recall", "-precision")),
    "calibration": _service(0.85, 0.90, 0.18),
    "service": _service(0.85, 0.90, 0.18, ("-f1", "-recall", "-precision", "false_positive_rate")),
    "constrained_recall": Policy(((None, None, 0.10), (None, None, None)), ("-recall", "-f1", "-precision")),
    "precision_at_recall": Policy(((None, 0.90, None),), ("-precision", "-f1")),
}
TIER_REASONS = ["met_precision_recall_fpr_targets", "met_recall_fpr_targets", "met_fpr_target_only",
                "fallback_max_f1"]


def _meets(limits: tuple) -> Column:
    p, r, f = limits
    ok = F.lit(True)
    if p is not None:
        ok = ok & (F.col("precision") >= p)
    if r is not None:
        ok = ok & (F.col("recall") >= r)
    if f is not None:
        ok = ok & (F.col("false_positive_rate") <= f)
    return ok


def _ordering(names: tuple) -> list[Column]:
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def select_threshold(sweep: DataFrame, policy: str | Policy = "max_f1", by: list[str] | None = None) -> DataFrame:
    """The sweep row a policy picks, per group; equal rows go to the lowest threshold."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    tier = F.when(F.lit(False), 0)
    for i, limits in enumerate(p.tiers):
        tier = tier.when(_meets(limits), i)
    ranked = sweep.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    return first_rows(ranked, by or [], [F.asc("tier"), *_ordering(p.order), F.asc("threshold")])


def select_target_threshold(sweep: DataFrame, precision: float, recall: float, fpr: float,
                            by: list[str] | None = None) -> DataFrame:
    """Best F1 among rows meeting all targets; otherwise the smallest weighted gap to them."""
    met = _meets((precision, recall, fpr))
    gap = (F.greatest(F.lit(0.0), F.lit(precision) - F.col("precision"))
           + F.greatest(F.lit(0.0), F.lit(recall) - F.col("recall"))
           + 0.25 * F.greatest(F.lit(0.0), F.col("false_positive_rate") - F.lit(fpr)))
    ranked = sweep.withColumns({"met": met.cast("int"), "gap": F.when(met, 0.0).otherwise(gap)})
    return first_rows(ranked, by or [], [
        F.desc("met"), F.asc("gap"), F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("threshold")])


def select_family_threshold(sweep: DataFrame, family: str = "app_family") -> DataFrame:
    """Per family, with limits that depend on the family."""
    out = None
    kind = F.when(F.col(family).isin("service", "malware"), F.col(family)).otherwise("other")
    for name in ("service", "malware", "other"):
        piece = select_threshold(sweep.filter(kind == name), f"family_{name}", [family])
        out = piece if out is None else out.unionByName(piece)
    return out


def frontier(sweep: DataFrame, level: float = 0.70) -> DataFrame:
    """One row: does any threshold reach the level on both, and the best rows on each side."""
    def best(order: list[Column], ok: Column, prefix: str) -> Column:
        # Smallest of (negated metrics, threshold): an aggregate, not a sort.
        key = F.struct(*[(-o).alias(f"k{i}") for i, o in enumerate(order)], F.col("threshold"), *PR)
        return F.min(F.when(ok, key)).alias(prefix)

    p_ok, r_ok = F.col("precision") >= level, F.col("recall") >= level
    out = sweep.agg(
        F.max((p_ok & r_ok).cast("int")).alias("achieves_both"),
        best([F.col("f1")], p_ok & r_ok, "both"),
        best([F.col("f1")], F.lit(True), "max_f1"),
        best([F.col("recall"), F.col("f1")], p_ok, "recall_at_precision"),
        best([F.col("precision"), F.col("f1")], r_ok, "precision_at_recall"))
    return out.select("achieves_both", *[
        F.col(f"{n}.{m}").alias(f"{n}_{m}")
        for n in ("both", "max_f1", "recall_at_precision", "precision_at_recall")
        for m in ("threshold", "precision", "recall", "f1")])


def precision_at_k(df: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), id_col: str = "id",
                   label: str = "label", score: str = "score") -> DataFrame:
    """Precision and true positives among the k highest scores; only max(ks) rows are kept."""
    top = df.select(id_col, label, score).orderBy(F.desc(score), F.asc(id_col)).limit(max(ks))
    rn = F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col)))
    ranked = top.withColumn("_rn", rn)
    aggs = []
    for k in ks:
        inside = F.col("_rn") <= k
        hits = F.coalesce(F.sum(F.when(inside & (F.col(label) == 1), 1).otherwise(0)), F.lit(0))
        aggs += [hits.cast("long").alias(f"true_positives_at_{k}"),
                 F.coalesce(ratio(hits, F.count_if(inside)), F.lit(0.0)).alias(f"precision_at_{k}")]
    return ranked.agg(*aggs)


def recall_at_fpr(df: DataFrame, targets: tuple[float, ...] = (0.01, 0.05, 0.10), id_col: str = "id",
                  label: str = "label", score: str = "score") -> DataFrame:
    rows = df.select(id_col, label, score)
    pos, neg = (F.col(label) == 1).cast("long"), (F.col(label) == 0).cast("long")
    c = running(rows, [], [F.desc(score), F.asc(id_col)], {"_tp": pos, "_fp": neg})
    c = with_group(c, [], _tot_pos=F.greatest(F.lit(1), F.count_if(F.col(label) == 1)),
                   _NEG=F.greatest(F.lit(1), F.count_if(F.col(label) == 0)))
    recall, fpr = F.col("_tp") / F.col("_tot_pos"), F.col("_fp") / F.col("_NEG")
    return c.agg(*[F.coalesce(F.max(F.when(fpr <= t, recall)), F.lit(0.0)).alias(
        f"recall_at_fpr_{t:g}".replace(".", "_")) for t in targets])


def group_metrics(df: DataFrame, group: str, threshold: float, min_rows: int = 24, max_groups: int | None = None,
                  label: str = "label", score: str = "score") -> DataFrame:
    """Metrics of the groups (the largest ``max_groups`` if given) that have enough rows and both classes."""
    name = F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("unknown"))
    m = binary_metrics(df.withColumn("group", name), threshold, ["group"], label, score)
    m = m.withColumns({"rows": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
                       "positives": F.col("tp") + F.col("fn")})
    if max_groups is not None:
        m = m.orderBy(F.desc("rows"), F.asc("group")).limit(max_groups)
    return m.filter((F.col("rows") >= min_rows) & (F.col("positives") > 0)
                          & (F.col("positives") < F.col("rows")))


def roc_curve(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    c = curve(df, by, label, score)
    return c.select(*(by or []), F.col("_s").alias("threshold"),
                    ratio(F.col("_cn") - F.col("_ctp"), F.col("_tot") - F.col("_tot_pos")).alias("fpr"),
                    ratio(F.col("_ctp"), F.col("_tot_pos")).alias("tpr"))


def pr_curve(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    c = curve(df, by, label, score)
    return c.select(*(by or []), F.col("_s").alias("threshold"),
                    (F.col("_ctp") / F.col("_cn")).alias("precision"),
                    ratio(F.col("_ctp"), F.col("_tot_pos")).alias("recall"))


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    pred = (F.col(score) >= threshold).cast("int").alias("prediction")
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("rows"))


def calibrate_thresholds(df: DataFrame, score: str = "score", app: str = "app_id", min_rows: int = 10,
                         medium: float = 0.90, high: float = 0.98) -> DataFrame:
    """Score quantiles over all rows (app_id null) and per app with enough rows."""
    qs = {"medium": medium, "high": high}
    overall = exact_quantiles(df, [], score, qs).withColumn(app, F.lit(None).cast("string"))
    sizes = df.groupBy(app).count().filter(F.col("count") >= min_rows).drop("count")
    per_app = exact_quantiles(df, [app], score, qs).join(sizes, app, "left_semi")
    out = overall.unionByName(per_app)
    return out.select(app, clip01("medium").alias("medium"),
                      clip01(F.greatest("medium", "high")).alias("high"))


def policy_document(thresholds: DataFrame, version: int, export_enabled: bool, retention_days: int,
                    app: str = "app_id") -> DataFrame:
    """One JSON document: defaults from the app-less row, overrides from the others."""
    pair = F.struct("medium", "high")
    entries = F.sort_array(F.collect_list(F.when(F.col(app).isNotNull(), F.struct(F.col(app), pair.alias("t")))))
    doc = thresholds.agg(
        F.max(F.when(F.col(app).isNull(), pair)).alias("default_thresholds"),
        F.map_from_entries(entries).alias("app_threshold_overrides"))
    body = F.struct(F.lit(version).alias("policy_version"), "default_thresholds", "app_threshold_overrides",
                    F.lit(export_enabled).alias("export_enabled"), F.lit(retention_days).alias("retention_days"))
    return doc.select(F.to_json(body).alias("document"))


def error_groups(df: DataFrame, mask: Column, column: str, n: int = 10) -> DataFrame:
    """Groups with most errors, with their rate and share."""
    g = df.groupBy(F.col(column).cast("string").alias("group")).agg(
        F.count_if(mask).alias("errors"), F.count(F.lit(1)).alias("rows"))
    g = with_group(g, [], _all=F.sum("errors")).filter(F.col("errors") > 0)
    return g.orderBy(F.desc("errors"), F.asc("group")).limit(n).select(
        "group", "errors", "rows", (F.col("errors") / F.col("rows")).alias("error_rate"),
        (F.col("errors") / F.col("_all")).alias("share_of_error_type"))


def feature_shifts(df: DataFrame, mask: Column, reference: Column, n: int = 10,
                   columns: list[str] | None = None) -> DataFrame:
    """Mean difference of error rows and reference rows per feature, in reference deviations."""
    columns = columns or [c for c in K.FEATURES if c in df.columns]
    aggs = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs.append(F.struct(
            F.lit(c).alias("feature"), F.avg(F.when(mask, v)).alias("error_mean"),
            F.avg(F.when(reference, v)).alias("reference_mean"),
            F.stddev_pop(F.when(reference, v)).alias("_std")).alias(f"_{c}"))
    one = df.agg(*aggs)
    rows = one.select(F.inline(F.array(*[F.col(f"_{c}") for c in columns])))
    rows = rows.filter(F.col("error_mean").isNotNull() & F.col("reference_mean").isNotNull())
    delta = F.col("error_mean") - F.col("reference_mean")
    rows = rows.withColumns({"delta": delta, "standardized_delta": delta / (F.col("_std") + 1e-9)}).drop("_std")
    return rows.orderBy(F.desc(F.abs("standardized_delta")), F.asc("feature")).limit(n)


def error_report(df: DataFrame, threshold: float, group: str = "app_family", n: int = 10) -> DataFrame:
    """Long table: confusion totals, group metrics, error contributors and feature shifts."""
    pred = F.col("score") >= threshold
    fp, fn = pred & (F.col("label") == 0), ~pred & (F.col("label") == 1)
    ok_neg, ok_pos = ~pred & (F.col("label") == 0), pred & (F.col("label") == 1)

    def long(section: str, rows: DataFrame, key: Column, values: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
        return rows.select(F.lit(section).alias("section"), key.alias("key"), F.inline(cells))

    totals = binary_metrics(df, threshold)
    out = long("totals", totals, F.lit("all"), ["tp", "fp", "fn", "tn", *PR])
    out = out.unionByName(long("groups", group_metrics(df, group, threshold), F.col("group"), ["rows", *PR]))
    for name, mask, ref in (("false_positives", fp, ok_neg), ("false_negatives", fn, ok_pos)):
        out = out.unionByName(long(name, error_groups(df, mask, group, n), F.col("group"), ["errors", "error_rate"]))
        out = out.unionByName(long(f"{name}_shift", feature_shifts(df, mask, ref, n), F.col("feature"),
                                   ["standardized_delta"]))
    return out


def gap_groups(df: DataFrame, keys: list[str], ts: str, id_col: str, gap_ms: int, name: str) -> DataFrame:
    """Number runs of rows whose neighbours are at most ``gap_ms`` apart."""
    def mark(part: DataFrame, names: list[str]) -> DataFrame:
        before = F.lag(ts).over(window(names, [ts, id_col]))
        return part.withColumn("_new", F.when(before.isNull() | (F.col(ts) - before > gap_ms), 1).otherwise(0))

    marked = bounded(df, keys, [ts, id_col], 1, mark)
    return running(marked, keys, [ts, id_col], {name: F.col("_new")}).drop("_new")


def episodes(df: DataFrame, gap_ms: int = 300_000, threshold: float = 0.5, id_col: str = "window_bucket",
             ts: str = "window_end_ms", score: str = "score") -> DataFrame:
    """Runs of windows per (app, session) split where the gap is larger than ``gap_ms``."""
    keys = ["app_id", "session_id"]
    grouped = gap_groups(df, keys, ts, id_col, gap_ms, "episode")
    place = F.struct(ts, id_col)
    return grouped.groupBy(*keys, "episode").agg(
        F.min_by("app_family", place).alias("app_family"),
        F.min_by("dataset_source", place).alias("dataset_source"),
        F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"),
        F.count(F.lit(1)).alias("windows"), F.max("label").alias("label"),
        F.max(score).alias("score"), F.max((F.col(score) >= threshold).cast("int")).alias("prediction"))


def episode_report(df: DataFrame, gap_ms: int = 300_000, threshold: float = 0.5, **kw) -> DataFrame:
    """Episode-level metrics over all rows and per family and source, from one episode table."""
    e = episodes(df, gap_ms, threshold, **kw)
    cubes = e.select("label", "score", F.inline(F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("app_family").alias("dimension"), F.col("app_family").alias("value")),
        F.struct(F.lit("dataset_source").alias("dimension"), F.col("dataset_source").alias("value")))))
    out = binary_metrics(cubes, threshold, ["dimension", "value"])
    return out.withColumn("episodes", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


# Windows columns watched for drift.
DRIFT_FEATURES = ["score", "novelty_score", "burstiness", "connection_frequency_delta",
                  "periodic_beacon_score", "data_quality_score"]


def drift_series(df: DataFrame, n: int = 40, min_history: int = 12, high: float = 0.65,
                 features: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Deviation from the previous n rows of the app, averaged over features."""
    features = features or [c for c in DRIFT_FEATURES if c in df.columns]
    order = order or ["window_end_ms"]

    def build(part: DataFrame, keys: list[str]) -> DataFrame:
        prior = window(keys, order).rowsBetween(-n, -1)
        z = {}
        for c in features:
            enough = F.count(c).over(prior) >= min_history
            std = F.nullif(F.stddev_samp(c).over(prior), F.lit(0.0))
            raw = F.when(enough, F.abs((F.col(c) - F.avg(c).over(prior)) / std))
            z[f"{c}_z"] = F.coalesce(clip(raw, 0, 10), F.lit(0.0))
        return part.withColumns(z)

    out = bounded(df, ["app_id"], order, n, build)
    mean = sum((F.col(f"{c}_z") for c in features[1:]), F.col(f"{features[0]}_z")) / len(features)
    out = out.withColumn("drift_score", clip01(mean / 5.0))
    return out.withColumn("high_drift", (F.col("drift_score") >= high).cast("int"))


def drift_report(series: DataFrame) -> DataFrame:
    """Per app, and over all apps where app_id is null, in one pass."""
    return series.groupingSets([["app_id"], []], "app_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("app_id").alias("apps"),
        F.max("drift_score").alias("max_drift"), F.avg("drift_score").alias("mean_drift"),
        F.sum("high_drift").alias("high_drift_rows"))


# Columns that make up a window fingerprint.
AUDIT_FEATURES = ["flow_count", "byte_rate", "packet_rate", "mean_packet_size", "destination_diversity",
                  "destination_concentration", "destination_transition_rate", "novelty_score",
                  "dns_flow_ratio", "web_flow_ratio", "private_destination_ratio"]


def fingerprint(df: DataFrame, digits: int, features: list[str] | None = None) -> Column:
    cells = [F.coalesce(F.col(c), F.lit("unknown")) for c in ("dataset_source", "app_family")]
    for c in features or [c for c in AUDIT_FEATURES if c in df.columns]:
        cells.append(F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), digits).cast("string"))
    return F.concat_ws("|", *cells)


def conflict_groups(df: DataFrame, digits: int = 2, features: list[str] | None = None) -> DataFrame:
    """Fingerprints that occur with both labels."""
    rows = df.withColumn("fingerprint", fingerprint(df, digits, features))
    g = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
    return g.filter((F.col("positives") > 0) & (F.col("positives") < F.col("rows"))).withColumns({
        "negatives": F.col("rows") - F.col("positives"), "positive_rate": F.col("positives") / F.col("rows")})


def label_audit(df: DataFrame, digits: int = 2, features: list[str] | None = None) -> DataFrame:
    """Conflicting fingerprints with the first names that share them (5 sources and families,
    8 apps and sessions). Names are made distinct and cut before they are collected."""
    rows = df.withColumn("fingerprint", fingerprint(df, digits, features))
    out = conflict_groups(df, digits, features)
    for column, name, limit in (("dataset_source", "datasets", 5), ("app_family", "families", 5),
                                ("app_id", "apps", 8), ("session_id", "sessions", 8)):
        names = rows.select("fingerprint", column).distinct()
        kept = first_rows(names, ["fingerprint"], [column], limit)
        lists = kept.groupBy("fingerprint").agg(F.sort_array(F.collect_list(column)).alias(name))
        out = out.join(lists, "fingerprint", "left")
    return out


def label_audit_by_family(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("families").alias("app_family"), "rows").groupBy("app_family").agg(
        F.count(F.lit(1)).alias("conflict_groups"), F.sum("rows").alias("conflict_rows"))


def label_conflicts(df: DataFrame, digits: int = 2) -> DataFrame:
    """Mark rows whose fingerprint has both labels; such rows weigh 0.35."""
    rows = df.withColumn("_fp", fingerprint(df, digits))
    rows = with_group(rows, ["_fp"], _lo=F.min("label"), _hi=F.max("label"))
    conflict = (F.col("_lo") <= 0) & (F.col("_hi") > 0)
    return rows.withColumns({"label_conflict": conflict.cast("int"),
                             "conflict_weight": F.when(conflict, 0.35).otherwise(1.0)}).drop("_fp", "_lo", "_hi")


def balance_counts(df: DataFrame, columns: list[str], split: str | None = None) -> DataFrame:
    """Rows and labels per value of each column (and split) in one pass."""
    extra = [split] if split else []
    sets = [[*extra, c] for c in columns]
    g = df.groupingSets(sets, *extra, *columns).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"),
        F.grouping_id(*extra, *columns).alias("_set"))
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return g.select(*extra, which.alias("dimension"), F.coalesce(*columns).alias("group"), "rows", "positives",
                    (F.col("rows") - F.col("positives")).alias("negatives"),
                    (F.col("positives") / F.col("rows")).alias("positive_rate"))


def melt_scores(df: DataFrame, scores: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (row, model): several score columns under one name."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
                      for m, c in scores.items()])
    return df.select(*keep, F.inline(cells))


def compare_scores(df: DataFrame, scores: dict[str, str], thresholds: dict[str, float]) -> DataFrame:
    """F1-F3 per model, with the difference to the first model."""
    long = melt_scores(df, scores, ["label"])
    t = F.create_map(*[x for m, v in thresholds.items() for x in (F.lit(m), F.lit(float(v)))])
    long = long.withColumn("_t", F.element_at(t, F.col("model")))
    m = binary_metrics(long, "_t", ["model"]).join(roc_auc(long, ["model"]), "model").join(
        average_precision(long, ["model"]), "model")
    first = next(iter(scores))
    base = m.filter(F.col("model") == first).select(F.col("f1").alias("_base"))
    return m.crossJoin(F.broadcast(base)).withColumn("f1_delta", F.col("f1") - F.col("_base")).drop("_base")


def aggregate_runs(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std")]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *aggs)


def relative_drop(df: DataFrame, reference: str, by: str = "view", metrics: tuple = ("pr_auc", "roc_auc"),
                  delta: tuple = ("f1",)) -> DataFrame:
    """Loss of each row against the reference row."""
    base = df.filter(F.col(by) == reference).select(*[F.col(c).alias(f"_b_{c}") for c in (*metrics, *delta)])
    out = df.crossJoin(F.broadcast(base.limit(1)))
    cols = {f"{m}_relative_drop": F.greatest(
        F.lit(0.0), 1.0 - F.col(m) / F.greatest(F.lit(1e-9), F.col(f"_b_{m}"))) for m in metrics}
    cols |= {f"{m}_delta": F.col(m) - F.col(f"_b_{m}") for m in delta}
    return out.withColumns(cols).drop(*[f"_b_{c}" for c in (*metrics, *delta)])


# Metric gates per model category.
GATES = {
    "on_device_one_class": {"roc_auc": 0.90, "pr_auc": 0.88, "f1": 0.86, "precision": 0.84, "recall": 0.88},
    "on_device_supervised": {"roc_auc": 0.95, "pr_auc": 0.90, "f1": 0.90, "precision": 0.88, "recall": 0.92},
    "remote_primary": {"roc_auc": 0.95, "pr_auc": 0.92, "f1": 0.90, "precision": 0.88, "recall": 0.92},
    "remote_family_benchmark": {"roc_auc": 0.95, "pr_auc": 0.92, "f1": 0.90, "precision": 0.88, "recall": 0.92},
    "privacy_preserving_student": {"roc_auc": 0.95, "pr_auc": 0.92, "f1": 0.90, "precision": 0.88, "recall": 0.92},
    "federated": {"roc_auc": 0.95, "pr_auc": 0.92, "f1": 0.90, "precision": 0.88, "recall": 0.92},
}


def limits_table(spark, limits: dict[str, dict[str, float]] | None = None) -> DataFrame:
    rows = [(c, m, float(v)) for c, ms in (limits or GATES).items() for m, v in ms.items()]
    return spark.createDataFrame(rows, "category string, metric string, minimum double")


def gates(df: DataFrame, limits: DataFrame, by: list[str], category: str = "category",
          upper: bool = False) -> DataFrame:
    """All-true verdict over the metrics a row has; null when none applies."""
    names = [r["metric"] for r in limits.select("metric").distinct().orderBy("metric").collect()]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in names if m in df.columns])
    long = df.select(*by, category, F.inline(cells)).join(F.broadcast(limits), [category, "metric"], "left")
    ok = F.col("value") <= F.col("minimum") if upper else F.col("value") >= F.col("minimum")
    return long.groupBy(*by, category).agg(
        F.count_if(ok.isNotNull()).alias("checks"), F.count_if(ok).alias("met"),
        F.bool_and(ok).cast("int").alias("passed"))


def risk_level(c: str) -> Column:
    v = F.col(c)
    return F.when(v.isNull(), None).when(v >= 0.75, "severe").when(v >= 0.45, "elevated").when(
        v >= 0.20, "reduced").otherwise("low")


def rank_models(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Best model by F1 and PR-AUC, and the first passing one by name order of category."""
    j = df.join(verdicts.select("model", "passed"), "model", "left")

    def best(metric: str) -> Column:
        return F.min(F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), F.col("model")))).getField("model")

    return j.agg(best("f1").alias("best_f1_model"), best("pr_auc").alias("best_pr_auc_model"),
                 F.min(F.when(F.col("passed") == 1, F.col("model"))).alias("first_passing_model"))


def pareto(utility: DataFrame, leakage: DataFrame) -> DataFrame:
    return utility.join(leakage, "view", "left")


def run_diff(current: DataFrame, previous: DataFrame, metrics: tuple = ("f1", "pr_auc", "roc_auc")) -> DataFrame:
    old = previous.select("model", *[F.col(m).alias(f"_o_{m}") for m in metrics])
    return current.join(old, "model").select(
        "model", *[(F.col(m) - F.col(f"_o_{m}")).alias(f"{m}_delta") for m in metrics])


def client_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("client")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"), F.avg(F.col("label").cast("double")).alias("positive_rate"))


def model_view_table(scores: DataFrame, threshold: str = "threshold") -> DataFrame:
    """Per model and view: metrics at the model's threshold and at its best-F1 threshold."""
    by = ["model", "view"]
    own = binary_metrics(scores, threshold, by).join(roc_auc(scores, by), by).join(average_precision(scores, by), by)
    sweep = threshold_sweep(scores, by=by)
    best = select_threshold(sweep, "max_f1", by).select(
        *by, F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    both = sweep.groupBy(*by).agg(
        F.max(((F.col("precision") >= 0.70) & (F.col("recall") >= 0.70)).cast("int")).alias("achieves_70_70"))
    return own.join(best, by).join(both, by)
