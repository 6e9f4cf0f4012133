"""Corpus metadata: provenance, families, balance, manifest, feedback and retraining sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.functions.scalars import C, clip, col, contains_any, file_parent, file_stem, number, token
from netloom.operators.flows import app_family
from netloom.plans.ordered import first_rows, with_group

# Dataset source of each profile, and the path words that reveal a profile.
PROFILE_SOURCES = {
    "generic_flow": "generic_flow", "cicflowmeter": "cicandmal2017_android", "westermo": "westermo",
    "sdncampus": "sdncampus_flow_statistics", "parrot": "parrot2025_mitmproxy",
    "android_spyware": "android_spyware_mendeley", "android_mischief": "android_mischief_rat_traffic",
    "itc_net_blend": "itc_net_blend60_scenario_e", "android_apt_behavior": "android_apt_behavior_dataset",
}
PATH_PROFILES = {
    "sdncampus": "sdncampus", "westermo": "westermo", "android_spyware": "android_spyware",
    "android_mischief": "android_mischief", "itc_net_blend": "itc_net_blend",
    "cicandmal2017": "cicflowmeter", "pcap_iscx": "cicflowmeter", "parrot": "parrot",
}
PROFILE_ENVIRONMENTS = {
    "sdncampus": "sdncampus", "android_spyware": "android_spyware_lab", "android_mischief": "android_mischief_lab",
    "itc_net_blend": "itc_net_blend60_scenario_e", "parrot": "parrot2025_mitmproxy",
}


def profile_from_path(path: C) -> Column:
    name = token(path)
    out = F.when(F.lit(False), F.lit(""))
    for needle, profile in PATH_PROFILES.items():
        out = out.when(name.contains(needle), profile)
    return out.otherwise("generic_flow")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def provenance_columns(path: C, profile: Column) -> dict[str, Column]:
    stem = token(file_stem(path))
    parent = F.when(F.length(file_parent(path)) > 0, token(file_parent(path))).otherwise(stem)
    plain = ~parent.isin("real", "data")
    other = F.when(profile == "westermo", stem).when(
        profile == "cicflowmeter", F.when(plain, parent).otherwise("cicandmal2017")).otherwise(
        F.when(plain, parent).otherwise(stem))
    return {
        "dataset_source": F.coalesce(_lookup(PROFILE_SOURCES, profile), stem),
        "dataset_profile": profile,
        "dataset_variant": stem,
        "environment_id": F.coalesce(_lookup(PROFILE_ENVIRONMENTS, profile), other),
        "session_id": stem,
    }


def add_provenance(df: DataFrame, profile: str | None = None, path: str = "source_path") -> DataFrame:
    """Source, profile, variant, environment and session of every row from its file path."""
    p = F.lit(profile) if profile else profile_from_path(path)
    return df.withColumns(provenance_columns(path, p))


def recover_provenance(df: DataFrame, path: C) -> DataFrame:
    """Fill placeholder provenance from the path, and a placeholder family from the app id."""
    found = provenance_columns(path, profile_from_path(path))

    def repaired(name: str, value: Column, placeholders: list[str]) -> Column:
        if name not in df.columns:
            return value
        t = F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
        return F.when(t.isin("", "nan", "none", *placeholders), value).otherwise(F.col(name).cast("string"))

    out = {n: repaired(n, v, [K.PROVENANCE[n]]) for n, v in found.items()}
    family = app_family("app_id") if "app_id" in df.columns else F.lit(K.DEFAULT_FAMILY)
    out["app_family"] = repaired("app_family", family, ["other_app", "unknown"])
    return df.withColumns(out)


def merge_flows(*frames: DataFrame) -> DataFrame:
    """Union by name; missing provenance gets its default, a missing family is derived."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in out.columns else F.lit(d)
                           for c, d in K.PROVENANCE.items()})
    family = F.coalesce("app_family", F.lit(K.DEFAULT_FAMILY)) if "app_family" in out.columns else app_family("app_id")
    return out.withColumn("app_family", family)


MANIFEST_COLUMNS = [*K.PROVENANCE, "app_family"]


def manifest(df: DataFrame) -> dict[str, DataFrame]:
    """Rows and labels per source, rows per family, completeness with the ready flag."""
    filled = df.withColumns({
        c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(K.PROVENANCE.get(c, K.DEFAULT_FAMILY)))
        for c in MANIFEST_COLUMNS if c in df.columns})
    sources = filled.groupBy("dataset_source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"), F.countDistinct("app_family").alias("app_family_count"),
        F.countDistinct("session_id").alias("session_count"), F.countDistinct("environment_id").alias("environment_count"))
    families = filled.groupBy("app_family").agg(F.count(F.lit(1)).alias("rows"))
    share = {c: F.avg((F.trim(F.col(c)) != "").cast("double")) for c in MANIFEST_COLUMNS}
    complete = filled.agg(F.count(F.lit(1)).alias("rows"), *[v.alias(c) for c, v in share.items()])
    complete = complete.withColumn("ready", (F.least(*MANIFEST_COLUMNS) >= 0.999).cast("int"))
    return {"sources": sources, "families": families, "completeness": complete}


def source_weights(df: DataFrame) -> DataFrame:
    """clip(sqrt(median source size / own size), 0.65, 3)."""
    source = F.coalesce(F.nullif(F.col("dataset_source"), F.lit("")), F.lit("unknown_source"))
    counts = df.groupBy(source.alias("dataset_source")).agg(F.count(F.lit(1)).alias("rows"))
    counts = with_group(counts, [], _median=F.percentile("rows", F.lit(0.5)))
    ratio = F.greatest(F.lit(1e-6), F.col("_median") / F.col("rows"))
    return counts.select("dataset_source", "rows", clip(F.sqrt(ratio), 0.65, 3.0).alias("weight"))


# Triage states that say dangerous or harmless.
POSITIVE_STATES = ["RESOLVED", "DANGEROUS", "TRUE_POSITIVE", "MALICIOUS"]
NEGATIVE_STATES = ["FALSE_POSITIVE", "NEUTRAL", "DISMISSED", "BENIGN"]


def feedback_to_rows(df: DataFrame) -> DataFrame:
    """Triaged alert records as labelled rows; a feature object is spread into columns."""
    def pick(*names: str, default=None) -> Column:
        have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(default).cast("string"))

    status = F.upper(F.coalesce(pick("triage_status", "triageStatus"), F.lit("")))
    label = F.when(status.isin(POSITIVE_STATES), 1).when(status.isin(NEGATIVE_STATES), 0)
    out = df.withColumns({
        "app_id": pick("app_id", "appId", default="unknown"),
        "timestamp_end": F.coalesce(pick("last_seen", "timestamp", "createdAtMillis").try_cast("long"), F.lit(0)),
        "label": label, "feedback_status": status,
        "dataset_source": F.lit("android_feedback"), "dataset_profile": F.lit("user_triage"),
        "dataset_variant": F.lit("local_feedback"), "environment_id": pick("device_id_pseudo", default="local_device"),
        "session_id": pick("alert_id", "id", default="feedback")}).filter(F.col("label").isNotNull())
    kept = ["app_id", "timestamp_end", "label", "feedback_status", *K.PROVENANCE]
    features = next((c for c in ("feature_window", "features") if c in df.columns), None)
    return out.select(*kept, *([f"{features}.*"] if features else []))


# Defaults of the numeric columns of a retraining set.
RETRAIN_DEFAULTS = {"anomaly_score": 0.0, "confidence": 0.5, "uncertainty": 0.5, "drift_score": 0.0, "beacon_score": 0.0}
RETRAIN_TEXT = ["app_id", "source_model", "triage_status", "triage_note"]


def retraining_set(df: DataFrame, max_rows: int = 50_000, id_col: str = "alert_id") -> DataFrame:
    """Labelled samples: latest record per alert, defaults filled, newest ``max_rows``."""
    if "label" in df.columns:
        label = F.coalesce(F.col("label").try_cast("int"), F.lit(-1))
    else:
        status = F.upper(F.trim("triage_status"))
        label = F.when(status == "FALSE_POSITIVE", 0).when(status == "RESOLVED", 1).otherwise(-1)
    out = df.withColumn("label", label).filter(F.col("label").isin(0, 1))
    ts = number("timestamp") if "timestamp" in df.columns else F.lit(0.0)
    out = out.withColumn("timestamp", ts.cast("long"))
    body = F.struct(*[c for c in out.columns if c != id_col])
    latest = out.groupBy(id_col).agg(F.max_by(body, F.struct("timestamp", F.xxhash64(body))).alias("_b"))
    out = latest.select(id_col, "_b.*")
    out = out.withColumns({
        **{c: number(c, d) if c in out.columns else F.lit(d) for c, d in RETRAIN_DEFAULTS.items()},
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in out.columns else F.lit("") for c in RETRAIN_TEXT}})
    kept = [id_col, "app_id", "source_model", *RETRAIN_DEFAULTS, "triage_status", "triage_note", "timestamp", "label"]
    return out.select(*kept).orderBy(F.desc("timestamp"), F.desc(id_col)).limit(max_rows)


def retraining_report(df: DataFrame, min_per_class: int = 25) -> DataFrame:
    neg, pos = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return df.agg(
        F.count(F.lit(1)).alias("rows_exported"), neg.alias("label_0"), pos.alias("label_1"),
        F.coalesce(F.try_divide(pos.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("positive_ratio"),
        (F.greatest(pos, neg) / F.greatest(F.lit(1), F.least(pos, neg))).alias("imbalance_ratio"),
        ((pos >= min_per_class) & (neg >= min_per_class)).cast("int").alias("sufficient_per_class"))


# Path words that mark harmless data and known kinds of collections.
BENIGN_WORDS = ["benign", "normal", "legitimate", "goodware"]
COLLECTIONS = ["adware", "ransomware", "scareware", "smsmalware", "benign", "malware"]


def collection_from_path(path: C) -> Column:
    p = F.lower(col(path))
    out = F.when(F.lit(False), F.lit(""))
    for w in COLLECTIONS:
        out = out.when(p.contains(w), w)
    return out.otherwise("unknown_profile")


def label_from_path(path: C) -> Column:
    return F.when(contains_any(F.lower(col(path)), BENIGN_WORDS), 0).otherwise(1)


def label_from_column_or_path(df: DataFrame, path: C) -> Column:
    """Label column if present (number, or 0 for harmless words, else 1), otherwise path words."""
    names = {c.strip().lower(): c for c in df.columns}
    source = next((names[n] for n in ("label", "class", "category", "malware", "is_anomaly") if n in names), None)
    if source is None:
        return label_from_path(path)
    text = F.lower(F.trim(F.col(f"`{source}`").cast("string")))
    worded = F.when(text.isin(BENIGN_WORDS), 0).otherwise(1)
    return clip(F.coalesce(number(F.col(f"`{source}`"), None).cast("int"), worded), 0, 1).cast("int")


def app_id_from_path(path: C, profile: str) -> Column:
    """Application name from a capture's file name; the rule depends on the profile."""
    stem = file_stem(path)
    if profile == "parrot":
        return F.trim(F.regexp_replace(stem, r"_\d{4}-\d{2}-\d{2}-\d{4}_\d+$", ""))
    if profile == "itc_net_blend":
        name = F.regexp_replace(F.regexp_replace(stem, r"(?i)_final$", ""), r"([A-E])\d+$", "")
        return F.coalesce(F.nullif(token(name), F.lit("unknown")), F.lit("unknown_android_app"))
    return F.coalesce(F.nullif(token(stem), F.lit("unknown")), F.lit("unknown_spyware_capture"))


def capture_label(path: C, profile: str) -> Column:
    if profile in ("parrot", "itc_net_blend"):
        return F.lit(0)
    return F.when(F.lower(file_stem(path)).rlike("normal|benign"), 0).otherwise(1)
