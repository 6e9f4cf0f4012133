"""Model training with pyspark.ml; results are plain documents the scorers read.

Rows stay in Spark. What reaches the driver is the model itself: coefficients, tree nodes of
bounded depth, centroids, or a matrix the size of the feature list squared.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import evaluate as ev
from netloom.operators import scoring as sc
from netloom.operators.privacy import (
    FEATURE_GROUPS, VIEW_COLUMNS, privacy_views, rank_levels, representation)
from netloom.operators.sequences import behaviour_bucket, class_holdout, context_bucket, multiclass_metrics, target_frame
from netloom.operators.splits import group_split
from netloom.operators.windows import feature_matrix
from netloom.plans.ordered import exact_quantiles, hash_positions
from netloom.session import materialize, shared_dir


def _prepared(df: DataFrame, features: list[str], weight: str | None) -> DataFrame:
    kept = df.withColumn("label", F.col("label").cast("double"))
    if weight:
        kept = kept.withColumn(weight, F.col(weight).cast("double"))
    return feature_matrix(kept, features)


def train_linear(df: DataFrame, features: list[str], weight: str | None = None, max_iter: int = 50,
                 reg: float = 0.0) -> dict:
    """Standardized logistic regression as a linear document."""
    m = _prepared(df, features, weight)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(m)
    lr = LogisticRegression(featuresCol="scaled", maxIter=max_iter, regParam=reg, standardization=False)
    model = (lr.setWeightCol(weight) if weight else lr).fit(scaler.transform(m))
    # A constant feature is scaled to zero in training; its document scale of 1 keeps it harmless.
    scales = [float(s) or 1.0 for s in scaler.std]
    return {"model_type": "logistic_regression", "feature_order": list(features),
            "means": [float(x) for x in scaler.mean], "scales": scales,
            "weights": [float(x) for x in model.coefficients], "bias": float(model.intercept)}


def tree_documents(model, spark, leaf: str) -> list[dict]:
    """Trees as node arrays, read from the saved node table. ``leaf``: class share or prediction."""
    path = f"{shared_dir(spark)}/netloom-model-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct(*nodes.columns).alias("nodeData"))
    n = F.col("nodeData")
    share = F.try_divide(F.get(n["impurityStats"], F.lit(1)), F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x))
    value = share if leaf == "share" else n["prediction"]
    rows = nodes.select(
        "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        F.coalesce(value, F.lit(0.0)).alias("value")).orderBy("treeID", "id").collect()
    trees: dict[int, dict] = {}
    for r in rows:
        t = trees.setdefault(r["treeID"], {k: [] for k in ("feature", "threshold", "left", "right", "value")})
        inner = r["left"] >= 0
        t["feature"].append(int(r["feature"]) if inner else -1)
        t["threshold"].append(float(r["threshold"]) if inner else 0.0)
        t["left"].append(int(r["left"]))
        t["right"].append(int(r["right"]))
        t["value"].append(float(r["value"]))
    return [trees[i] for i in sorted(trees)]


def train_forest(df: DataFrame, features: list[str], weight: str | None = None, trees: int = 20, depth: int = 6,
                 seed: int = 42, subset: str = "auto") -> dict:
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=subset)
    model = (rf.setWeightCol(weight) if weight else rf).fit(_prepared(df, features, weight))
    return {"model_type": "random_forest_classifier", "feature_order": list(features),
            "trees": tree_documents(model, df.sparkSession, "share")}


def train_boosted(df: DataFrame, features: list[str], weight: str | None = None, rounds: int = 20, depth: int = 4,
                  step: float = 0.1, seed: int = 42) -> dict:
    """Boosted trees; the document's calibration reproduces the trained probability."""
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    model = (gbt.setWeightCol(weight) if weight else gbt).fit(_prepared(df, features, weight))
    docs = tree_documents(model, df.sparkSession, "prediction")
    for t, w in zip(docs, model.treeWeights):
        t["value"] = [v * float(w) for v in t["value"]]
    return {"model_type": "boosted_tree_classifier", "feature_order": list(features), "trees": docs,
            "initial_score": 0.0, "learning_rate": 1.0, "calibration_slope": 2.0, "calibration_bias": 0.0}


def covariance(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sample covariance, rows): tasks add up centred products, the driver gets d x d sums."""
    cells = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    x = df.select(*cells)
    first = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features]).first()
    n, mean = int(first["n"]), np.array([first[f] or 0.0 for f in features])

    def products(batches):
        total = np.zeros((len(features), len(features)))
        for pdf in batches:
            c = pdf.to_numpy() - mean
            total += c.T @ c
        yield pd.DataFrame({"i": range(len(features)), "v": list(total)})

    parts = x.mapInPandas(products, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros((len(features), len(features)))
    for r in sums:
        cov[r["i"], r["j"]] = r["v"]
    return mean, cov / max(1, n - 1), n


def train_mahalanobis(df: DataFrame, features: list[str], shrink: float = 0.1, ridge: float = 1e-3) -> dict:
    """Benign mean, shrunk covariance and its pseudo-inverse; threshold at the 95 % benign distance."""
    benign = df.filter("label = 0")
    mean, cov, _ = covariance(benign, features)
    shrunk = (1.0 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(len(features))
    doc = {"model_type": "mahalanobis_covariance", "feature_order": list(features), "mean": mean.tolist(),
           "precision_matrix": np.linalg.pinv(shrunk).tolist(), "threshold_distance": float(len(features))}
    scored = sc.score_mahalanobis(benign, doc, "_s", detail=False)
    cut = exact_quantiles(scored, [], "distance", {"d": 0.95}).first()
    doc["threshold_distance"] = float(cut["d"] or len(features))
    return doc


META = ["anomaly_score", "context_score", "tree_score", "score_gap", "risk_flag_sum"]


def folds(df: DataFrame, k: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Fold number: position in hash order within the label, modulo k."""
    out = hash_positions(df, ["label"], seed, [id_col])
    return out.withColumn("fold", (F.col("_rn") % k).cast("int")).drop("_rn")


def _channels(train: DataFrame, features: list[str], trees: dict) -> dict:
    return {"anomaly_model": train_mahalanobis(train, features), "context_model": train_linear(train, features),
            "tree_model": train_boosted(train, features, **trees)}


def _channel_scores(df: DataFrame, parts: dict) -> DataFrame:
    out = sc.score_mahalanobis(df, parts["anomaly_model"], "anomaly_score", detail=False)
    out = sc.score_linear(out, parts["context_model"], "context_score", detail=False)
    out = sc.score_trees(out, parts["tree_model"], "tree_score").withColumn("risk_flag_sum", F.lit(0.0))
    three = ["anomaly_score", "context_score", "tree_score"]
    return out.withColumn("score_gap", F.greatest(*three) - F.least(*three)).drop("distance")


def train_stacked(df: DataFrame, features: list[str], k: int = 3, trees: dict | None = None, id_col: str = "id") -> dict:
    """Three channels combined by a model trained on scores of rows the channels did not see."""
    trees = trees or {}
    parted = folds(df, k, id_col=id_col)
    held = None
    for i in range(k):
        parts = _channels(parted.filter(F.col("fold") != i), features, trees)
        piece = _channel_scores(parted.filter(F.col("fold") == i), parts).select("label", *META)
        held = piece if held is None else held.unionByName(piece)
    meta = train_linear(held, META, reg=1e-3)
    scales = meta["scales"]
    weights = [w / s for w, s in zip(meta["weights"], scales)]
    bias = meta["bias"] - sum(w * m for w, m in zip(weights, meta["means"]))
    return {"model_type": "hybrid_dual_channel", **_channels(parted, features, trees), "meta_bias": bias,
            "meta_feature_order": META, "meta_weights": weights}


def train_fusion(df: DataFrame, scores: list[str]) -> tuple[dict, DataFrame]:
    """(linear document over score columns, rows with the rank-mean score as a default)."""
    ranked = rank_levels(df, {f"_r_{s}": F.col(s) for s in scores}, 1000)
    mean = sum((F.col(f"_r_{s}") for s in scores[1:]), F.col(f"_r_{scores[0]}")) / len(scores)
    ranked = ranked.withColumn("rank_mean", mean).drop(*[f"_r_{s}" for s in scores])
    return train_linear(ranked, scores), ranked


def train_specialists(df: DataFrame, features: list[str], families: list[str], min_rows: int = 100, **kw) -> dict:
    """A forest per family that has enough rows of both classes."""
    sizes = df.filter(F.col("app_family").isin(families)).groupBy("app_family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    good = [r["app_family"] for r in sizes if r["n"] >= min_rows and 0 < r["p"] < r["n"]]
    return {f: train_forest(df.filter(F.col("app_family") == f), features, **kw) for f in sorted(good)}


def profile_thresholds(scored: DataFrame, min_rows: int = 50) -> DataFrame:
    """Bounded threshold per family, and best-F1 threshold per app, of groups with enough rows."""
    sizes = scored.groupBy("app_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select("app_id")
    family = ev.select_family_threshold(ev.threshold_sweep(scored, by=["app_family"]))
    apps = ev.select_threshold(ev.threshold_sweep(scored.join(sizes, "app_id", "left_semi"), by=["app_id"]),
                               "max_f1", ["app_id"])
    cols = ["threshold", "precision", "recall", "f1"]
    return family.select(F.lit("app_family").alias("dimension"), F.col("app_family").alias("key"), *cols).unionByName(
        apps.select(F.lit("app_id").alias("dimension"), F.col("app_id").alias("key"), *cols))


def evaluate_document(test: DataFrame, doc: dict, threshold: float = 0.5) -> DataFrame:
    # Stored once: five aggregates read it, and scoring may run Python.
    s = materialize(sc.score_document(test, doc, "score").select("label", "score"), "scores")
    return ev.binary_metrics(s, threshold).crossJoin(ev.roc_auc(s)).crossJoin(
        ev.average_precision(s).withColumnRenamed("average_precision", "pr_auc")).crossJoin(ev.brier(s)).crossJoin(ev.ece(s))


TRAINERS = {"linear": train_linear, "forest": train_forest, "boosted": train_boosted}


def compare_families(train: DataFrame, test: DataFrame, features: list[str], options: dict | None = None) -> DataFrame:
    """Metrics of each model family on one holdout."""
    out = None
    for name, trainer in TRAINERS.items():
        doc = trainer(train, features, **(options or {}).get(name, {}))
        line = evaluate_document(test, doc).withColumn("family", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


def protocol_report(df: DataFrame, features: list[str], strategies: list[str], seeds: list[int],
                    id_col: str = "id") -> DataFrame:
    """Mean and deviation of a linear model's metrics per split strategy over seeds."""
    runs = None
    for s in strategies:
        for seed in seeds:
            split, used = group_split(df, s, 0.25, seed, id_col)
            doc = train_linear(split.filter("split = 'train'"), features)
            line = evaluate_document(split.filter("split = 'test'"), doc).withColumns(
                {"strategy": F.lit(s), "used": F.lit(used), "seed": F.lit(seed)})
            runs = line if runs is None else runs.unionByName(line)
    return ev.aggregate_runs(runs, ["strategy"], ["precision", "recall", "f1", "roc_auc", "pr_auc"])


def cluster_thresholds(df: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Per cluster of benign rows: distance to the centroid at 99 and 99.9 percent.

    Without benign rows all rows are taken, as the reference calibrates on all scores then.
    """
    m = materialize(feature_matrix(df, features).select("label", "features"), "clusters")
    benign = m.filter("label = 0")
    m = m if benign.isEmpty() else benign
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(m).transform(m)
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(scaled)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(scaled).select("cluster", vector_to_array("scaled").alias("x"))
    gap = F.zip_with("x", F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b))
    out = out.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v)))
    cuts = exact_quantiles(out, ["cluster"], "distance", {"p99": 0.99, "p999": 0.999})
    return cuts.join(out.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")), "cluster")


def privacy_ablation(windows: DataFrame, seeds: list[int], id_col: str = "id", max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """(metrics per view, drops against the full view) of a linear model trained on each released view."""
    runs = None
    views = privacy_views(windows)
    for view, frame in views.items():
        keyed = materialize(frame.withColumn(id_col, F.concat_ws(":", "app_id", "window_bucket")), f"view-{view}")
        features = [c for c in VIEW_COLUMNS[view] if c in frame.columns]
        for seed in seeds:
            split, _ = group_split(keyed, None, 0.25, seed, id_col)
            doc = train_linear(split.filter("split = 'train'"), features, max_iter=max_iter)
            line = evaluate_document(split.filter("split = 'test'"), doc).withColumns(
                {"view": F.lit(view), "seed": F.lit(seed)})
            runs = line if runs is None else runs.unionByName(line)
    mean = ev.aggregate_runs(runs, ["view"], ["f1", "precision", "recall", "roc_auc", "pr_auc"])
    return mean, ev.relative_drop(mean, "off")


def utility_under_views(windows: DataFrame, models: dict[str, dict], threshold: float = 0.5) -> DataFrame:
    """Fixed models scored on released views: withheld features count as zero."""
    out = None
    for view, frame in privacy_views(windows).items():
        for name, doc in models.items():
            present = [f for f in doc["feature_order"] if f in frame.columns]
            line = ev.binary_metrics(sc.score_model(frame, doc, "score"), threshold).withColumns({
                "view": F.lit(view), "model": F.lit(name), "features": F.lit(len(doc["feature_order"])),
                "present": F.lit(len(present))})
            out = line if out is None else out.unionByName(line)
    return out


# ---- what released data gives away
def _attack_model(name: str, classes: int, features: int, seed: int, quick: bool):
    iters = 10 if quick else 100
    if name == "logistic_regression":
        return LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=iters, regParam=1e-4)
    if name == "random_forest":
        return RandomForestClassifier(featuresCol="scaled", labelCol="y", numTrees=10 if quick else 60, maxDepth=6, seed=seed)
    if name == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", maxIter=iters, seed=seed,
                                              layers=[features, *((16,) if quick else (96, 48)), classes])
    if name == "boosted":
        return OneVsRest(featuresCol="scaled", labelCol="y", classifier=GBTClassifier(maxIter=5 if quick else 40, maxDepth=4, seed=seed))
    raise ValueError(f"unknown attack model {name!r}")


def attack_predictions(train: DataFrame, test: DataFrame, features: list[str], target: str, model: str, seed: int = 42,
                       quick: bool = False) -> tuple[DataFrame, int]:
    """(test rows with truth, guess and probability, number of training classes)."""
    indexer = StringIndexer(inputCol=target, outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    classes = len(indexer.labels)
    tr = feature_matrix(indexer.transform(train), features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(tr)
    fitted = _attack_model(model, classes, len(features), seed, quick).fit(scaler.transform(tr))
    out = fitted.transform(scaler.transform(feature_matrix(indexer.transform(test), features)))
    cols = [F.col("y").cast("int").alias("truth"), F.col("prediction").cast("int").alias("guess")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return out.select(*cols), classes


def leakage_attack(train: DataFrame, test: DataFrame, features: list[str], target: str,
                   models: tuple[str, ...] = ("logistic_regression", "random_forest", "mlp"), seed: int = 42,
                   quick: bool = False) -> DataFrame:
    """Attack metrics per model; ``strongest`` marks the one that learns most."""
    out = None
    for i, name in enumerate(models):
        pred, classes = attack_predictions(train, test, features, target, name, seed + 11 * i, quick)
        line = multiclass_metrics(pred, classes=classes)
        if "probability" in pred.columns:
            k = min(5, classes)
            own = F.get("probability", F.col("truth"))
            rank = F.size(F.filter("probability", lambda p: p > own))
            line = line.crossJoin(pred.agg(F.avg(F.coalesce((rank < k).cast("double"), F.lit(0.0))).alias("top_5_accuracy")))
        else:
            line = line.withColumn("top_5_accuracy", F.lit(None).cast("double"))
        line = line.withColumn("model", F.lit(name))
        out = line if out is None else out.unionByName(line)
    best = F.row_number().over(Window.orderBy(F.desc("normalized_leakage"), F.desc("macro_f1"), F.desc("accuracy"), "model"))
    return out.withColumn("strongest", (best == 1).cast("int"))


def leakage_by_group(train: DataFrame, test: DataFrame, target: str, groups: dict[str, list[str]] | None = None, **kw) -> DataFrame:
    out = None
    for name, columns in (groups or FEATURE_GROUPS).items():
        have = [c for c in columns if c in train.columns]
        if have:
            line = leakage_attack(train, test, have, target, **kw).withColumn("feature_group", F.lit(name))
            out = line if out is None else out.unionByName(line)
    return out


TARGETS = {"app_id": "app_id", "app_family": "app_family", "dataset_source": "dataset_source",
           "context": "context_bucket", "destination_behavior": "behaviour_bucket"}


def leakage_suite(windows: DataFrame, views: list[str] | None = None, targets: list[str] | None = None,
                  min_rows: int = 20, seed: int = 42, **kw) -> DataFrame:
    """Every view against every target, on group holdouts; strongest model per (view, task)."""
    keyed = behaviour_bucket(context_bucket(windows)).withColumn("id", F.concat_ws(":", "app_id", "window_bucket"))
    labels = keyed.select("app_id", "window_bucket", "id", "context_bucket", "behaviour_bucket")
    out = None
    for view, frame in privacy_views(windows).items():
        if views and view not in views:
            continue
        features = [c for c in VIEW_COLUMNS[view] if c in frame.columns]
        rows = frame.join(labels, ["app_id", "window_bucket"])
        for task in targets or TARGETS:
            target = TARGETS[task]
            usable = materialize(target_frame(rows.withColumn("_target", F.col(target)), "_target", min_rows), "task")
            if usable.select("_target").distinct().limit(2).count() < 2:
                continue
            split = materialize(class_holdout(usable, "_target", ["dataset_source", "environment_id", "session_id"],
                                              0.3, seed), "holdout")
            line = leakage_attack(split.filter("split = 'train'"), split.filter("split = 'test'"), features, "_target",
                                  seed=seed, **kw)
            line = line.withColumns({"view": F.lit(view), "task": F.lit(task)})
            out = line if out is None else out.unionByName(line)
    return out.filter("strongest = 1")


def open_world(df: DataFrame, features: list[str], target: str, groups: list[str], model: str = "random_forest",
               ratio: float = 0.25, recall_floor: float = 0.90, seed: int = 42, quick: bool = False,
               id_col: str = "id") -> DataFrame | None:
    """Hold out classes; call a row unknown when its best known probability is below a calibrated cut."""
    names = df.select(F.col(target).alias("c")).distinct()
    placed = hash_positions(names, [], seed, ["c"])
    n = names.count()
    if n < 4:
        return None
    hidden = min(max(1, round(n * ratio)), n - 2)
    unknown = placed.filter(F.col("_rn") <= hidden).select(F.col("c").alias(target))
    outside, inside = df.join(unknown, target, "left_semi"), df.join(unknown, target, "left_anti")
    outer = class_holdout(inside, target, groups, 0.25, seed, id_col)
    outer = materialize(outer, "holdout")
    test = outer.filter("split = 'test'").drop("split")
    calibrated = class_holdout(outer.filter("split = 'train'").drop("split"), target, groups, 0.2, seed + 17, id_col)
    calibrated = materialize(calibrated, "holdout")
    fit, held = calibrated.filter("split = 'train'"), calibrated.filter("split = 'test'")
    kept = [target, *features]
    both = held.select(*kept, F.lit("held").alias("part")).unionByName(
        test.select(*kept, F.lit("known").alias("part"))).unionByName(outside.select(*kept, F.lit("unknown").alias("part")))
    return _open_world_metrics(fit, both, features, target, model, recall_floor, seed, quick)


def _open_world_metrics(fit: DataFrame, rows: DataFrame, features: list[str], target: str, model: str,
                        recall_floor: float, seed: int, quick: bool) -> DataFrame:
    indexer = StringIndexer(inputCol=target, outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(fit)
    tr = feature_matrix(indexer.transform(fit), features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(tr)
    fitted = _attack_model(model, len(indexer.labels), len(features), seed, quick).fit(scaler.transform(tr))
    out = fitted.transform(scaler.transform(feature_matrix(indexer.transform(rows), features)))
    out = out.select("part", F.array_max(vector_to_array("probability")).alias("sure"),
                     (F.col("y") == F.col("prediction")).cast("double").alias("right"))
    cut = exact_quantiles(out.filter("part = 'held'"), [], "sure", {"cut": max(0.0, 1.0 - recall_floor)})
    judged = out.filter("part <> 'held'").crossJoin(F.broadcast(cut)).select(
        (F.col("part") == "unknown").cast("int").alias("label"), (1.0 - F.col("sure")).alias("score"),
        (1.0 - F.col("cut")).alias("threshold"), "cut", "right", "part")
    m = ev.binary_metrics(judged, "threshold").select(
        F.col("precision").alias("unknown_precision"), F.col("recall").alias("unknown_recall"), F.col("f1").alias("unknown_f1"))
    known = judged.filter("part = 'known'").agg(F.avg("right").alias("known_accuracy"), F.max("cut").alias("cut"))
    return m.crossJoin(known).crossJoin(ev.roc_auc(judged).withColumnRenamed("roc_auc", "unknown_auroc"))


def representation_leakage(train: DataFrame, test: DataFrame, target: str, name: str, features: list[str],
                           min_rows: int = 20, max_rows: int = 0, seed: int = 42, quick: bool = False) -> DataFrame:
    """Forest attack on one representation, over classes that both sides have enough rows of."""
    a = target_frame(representation(train, name), target, min_rows, max_rows)
    b = target_frame(representation(test, name), target, max(1, min_rows // 4), max_rows)
    a, b = materialize(a.select(target, *features), "attack"), materialize(b.select(target, *features), "attack")
    shared = a.select(target).distinct().join(b.select(target).distinct(), target, "left_semi")
    line = leakage_attack(a.join(shared, target, "left_semi"), b.join(shared, target, "left_semi"), features, target,
                          ("random_forest",), seed, quick)
    return line.withColumn("representation", F.lit(name))
