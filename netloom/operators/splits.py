"""Group splits, samples and example weights. Pseudo-random order is a hash of (seed, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import C, clip
from netloom.operators.flows import app_family
from netloom.plans.ordered import hash_positions, positions, with_group
from netloom.session import materialize

FOLD_MS = 14_400_000  # four hours


def split_columns(df: DataFrame) -> DataFrame:
    """Defaults of the columns splits rely on, and the four-hour time fold."""
    def text(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast("string"), default) if name in df.columns else default

    source = text("dataset_source", F.lit("unknown_source"))
    variant = text("dataset_variant", source)
    family = app_family("app_id") if "app_id" in df.columns else F.lit("other_app")
    ts = next((c for c in ("window_end_ms", "timestamp_end") if c in df.columns), None)
    fold = F.expr(f"cast({ts} div {FOLD_MS}L as string)") if ts else F.lit("0")
    return df.withColumns({
        "dataset_source": source, "environment_id": text("environment_id", F.lit("unknown_environment")),
        "dataset_variant": variant, "session_id": text("session_id", variant),
        "app_family": text("app_family", family), "time_fold": text("time_fold", fold)})


# Split strategies in the order they are tried, and the columns of their keys.
STRATEGIES = {
    "source_env_session": ["dataset_source", "environment_id", "session_id"],
    "source_env_family_time": ["dataset_source", "environment_id", "app_family", "time_fold"],
    "source_family": ["dataset_source", "app_family"],
    "family_time": ["app_family", "time_fold"],
    "app_family_time": ["app_id", "app_family", "time_fold"],
    "temporal_holdout": ["time_fold"],
}
PREFIXES = {"dataset_source": "unknown_source", "environment_id": "unknown_environment",
            "session_id": "unknown_session", "app_family": "other_app", "time_fold": "time", "app_id": "app"}


def group_keys(df: DataFrame, id_col: str = "id", strategies: list[str] | None = None) -> DataFrame:
    """Key columns ``key_<strategy>``; a blank part is replaced by one that is unique to the row."""
    base = split_columns(df)

    def part(c: str) -> Column:
        own = F.concat_ws("_", F.lit(PREFIXES[c]), F.col(id_col).cast("string"))
        t = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(t.isin("", "nan", "None", "<NA>"), own).otherwise(t)

    return base.withColumns({f"key_{s}": F.concat_ws("|", *[part(c) for c in STRATEGIES[s]])
                             for s in strategies or STRATEGIES})


def assign_groups(df: DataFrame, key: str, frac: float, seed: int, name: str = "split") -> DataFrame:
    """Test side: the first groups in hash order, as many as make up ``frac`` of the groups."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    placed = with_group(hash_positions(groups, [], seed, [key]), [], _groups=F.count(F.lit(1)))
    test = F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("_groups") * frac))
    side = placed.select(F.col(key).alias("_k"), F.when(test, "test").otherwise("train").alias(name))
    return df.join(side, df[key].eqNullSafe(F.col("_k")), "left").drop("_k")


def stratified(df: DataFrame, frac: float, seed: int, id_col: str = "id", label: str = "label",
               name: str = "split") -> DataFrame:
    """Per label, the first rows in hash order are the test side."""
    placed = with_group(hash_positions(df, [label], seed, [id_col]), [label], _n=F.count(F.lit(1)))
    test = F.col("_rn") <= F.round(F.col("_n") * frac)
    return placed.withColumn(name, F.when(test, "test").otherwise("train")).drop("_rn", "_n")


def group_sides(df: DataFrame, names: list[str], frac: float, seed: int, id_col: str, label: str, tries: int) -> DataFrame:
    """Side of every group under every strategy and try: place, attempt, key, side, lo, hi, groups.

    The rows are read once and combined to one row per (strategy, group) with its smallest and
    largest label; all tries are hash orders of those.
    """
    keyed = group_keys(df, id_col, names)
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"key_{n}").alias("key")) for i, n in enumerate(names)])
    groups = keyed.select(F.col(label).alias("label"), F.inline(pairs)).groupBy("place", "key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"))
    groups = groups.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    by = ["place", "attempt"]
    placed = hash_positions(groups, by, F.lit(seed) + F.col("attempt"), ["key"])
    placed = with_group(placed, by, groups=F.count(F.lit(1)))
    test = F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("groups") * frac))
    return placed.withColumn("side", F.when(test, "test").otherwise("train")).drop("_rn")


def group_split(df: DataFrame, strategy: str | None = None, frac: float = 0.25, seed: int = 42,
                id_col: str = "id", label: str = "label", tries: int = 3) -> tuple[DataFrame, str]:
    """(rows with ``split``, strategy used): the first strategy whose sides both hold two classes.

    The sides of all groups are stored; one row of them, the first strategy and try that will do,
    decides. The number of jobs does not depend on the strategies or tries.
    """
    wanted = [strategy] if strategy else []
    names = [*wanted, *[s for s in STRATEGIES if s not in wanted]]
    sides = materialize(group_sides(df, names, frac, seed, id_col, label, tries), "sides")
    by = ["place", "attempt"]
    per_side = sides.groupBy(*by, "side").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("groups").alias("groups"))
    good = per_side.groupBy(*by).agg(
        F.count_if((F.col("lo") != F.col("hi")) & (F.col("groups") >= 2)).alias("mixed")).filter("mixed = 2")
    first = good.orderBy(*by).first()
    if first is None:
        return stratified(split_columns(df), frac, seed, id_col, label), "stratified_random_fallback"
    used, key = names[first["place"]], f"key_{names[first['place']]}"
    chosen = sides.filter((F.col("place") == first["place"]) & (F.col("attempt") == first["attempt"]))
    chosen = chosen.select(F.col("key").alias("_k"), F.col("side").alias("split"))
    out = group_keys(df, id_col, [used])
    return out.join(chosen, out[key] == F.col("_k"), "left").drop("_k", key), used


def nested_split(df: DataFrame, outer: float = 0.25, inner: float = 0.25, seed: int = 42, **kw):
    """(train / validation rows, test rows, strategies)."""
    first, s1 = group_split(df, None, outer, seed, **kw)
    inside, s2 = group_split(first.filter("split = 'train'").drop("split"), None, inner, seed + 17, **kw)
    return inside.replace({"test": "validation"}, subset=["split"]), first.filter("split = 'test'"), (s1, s2)


def split_summary(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("dataset_source").alias("dataset_sources"),
        F.countDistinct("app_family").alias("app_families"), F.countDistinct("time_fold").alias("time_folds"))


def quotas(counts: DataFrame, n: int, key: str) -> DataFrame:
    """Largest-remainder shares of n over one row per key (``rows``); never more than a key has."""
    out = with_group(counts, [], _all=F.sum("rows"))
    want = F.least(F.lit(n), F.col("_all"))
    exact = F.col("rows") * want / F.col("_all")
    out = out.withColumns({"_base": F.floor(exact), "_part": exact - F.floor(exact), "_want": want})
    out = with_group(out, [], _given=F.sum("_base"))
    out = positions(out, [], [F.desc("_part"), F.asc(key)], "_rn")
    extra = F.when(F.col("_rn") <= F.col("_want") - F.col("_given"), 1).otherwise(0)
    return out.select(key, (F.col("_base") + extra).alias("quota"))


def sample_by(df: DataFrame, key: str, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly n rows (or all), shared over the key's values by their size, chosen by hash."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    share = quotas(counts, n, key).select(F.col(key).alias("_k"), "quota")
    placed = hash_positions(df, [key], seed, [id_col])
    out = placed.join(share, placed[key].eqNullSafe(F.col("_k")), "left")
    return out.filter(F.col("_rn") <= F.col("quota")).drop("_rn", "_k", "quota")


def sample_by_source(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    return sample_by(df, "dataset_source", n, seed, id_col)


def cap_windows(df: DataFrame, benign: int = 0, total: int = 0, seed: int = 42, id_col: str = "id") -> DataFrame:
    """All positives, at most ``benign`` benign rows, then at most ``total`` rows."""
    out = df
    if benign > 0:
        out = df.filter("label = 1").unionByName(sample_by_source(df.filter("label = 0"), benign, seed, id_col))
    return sample_by_source(out, total, seed, id_col) if total > 0 else out


def sample_flows(df: DataFrame, n: int, seed: int = 42, id_col: str = "flow_id") -> DataFrame:
    """At most n rows: up to half of them positive, the rest filled with negatives."""
    c = df.agg(F.count_if(F.col("label") > 0).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if n <= 0 or c["n"] <= n:
        return df
    both = c["p"] > 0 and c["p"] < c["n"]
    take = min(c["p"], max(1, n // 2) if both else n)
    pos = sample_by_source(df.filter("label > 0"), take, seed, id_col)
    return pos.unionByName(sample_by_source(df.filter("label <= 0"), n - take, seed, id_col)) if n > take else pos


def sample(df: DataFrame, mode: str, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``natural`` (any n rows), ``balanced`` (equal shares of the labels) or ``source_label``."""
    if mode == "natural":
        placed = hash_positions(df, [], seed, [id_col])
        return placed.filter(F.col("_rn") <= n).drop("_rn")
    if mode == "balanced":
        kinds = max(1, df.select("label").distinct().count())
        placed = hash_positions(df, ["label"], seed, [id_col])
        return placed.filter(F.col("_rn") <= max(1, n // kinds)).drop("_rn")
    if mode == "source_label":
        keyed = df.withColumn("_sl", F.concat_ws("|", "dataset_source", F.col("label").cast("string")))
        return sample_by(keyed, "_sl", n, seed, id_col).drop("_sl")
    raise ValueError(f"unknown sample mode {mode!r}")


# Sources and families that are hard to tell from attacks, and their weights.
HARD_BENIGN_SOURCES = ["parrot2025_mitmproxy", "sdncampus_flow_statistics", "itc_net_blend60_scenario_e"]
HARD_BENIGN_FAMILIES = ["browser", "telemetry", "system", "background"]
HARD_POSITIVE_SOURCE = "cicandmal2017_android"
SERVICE_HARD_SOURCES = ["sdncampus_flow_statistics", "itc_net_blend60_scenario_e"]


def _add(test: Column, amount: float) -> Column:
    return F.when(test, amount).otherwise(0.0)


def example_weight() -> Column:
    source, family = F.col("dataset_source"), F.col("app_family")
    benign = 1.0 + _add(source.isin(HARD_BENIGN_SOURCES), 1.25) + _add(family.isin(HARD_BENIGN_FAMILIES), 0.65)
    attack = (1.15 + _add(source == HARD_POSITIVE_SOURCE, 0.15) + _add(family == "service", 0.30)
              + _add(family == "malware", 0.15))
    return F.when(F.col("label") == 0, benign).otherwise(attack)


def service_example_weight(df: DataFrame) -> DataFrame:
    """Service form: label and family weight times the source balance weight."""
    from netloom.operators.metadata import source_weights

    source, family = F.col("dataset_source"), F.col("app_family")
    benign = 1.0 + _add(source.isin(SERVICE_HARD_SOURCES), 0.85) + _add(family.isin(HARD_BENIGN_FAMILIES), 0.45)
    base = F.when(F.col("label") == 0, benign).otherwise(1.0 + _add(family == "malware", 0.15))
    w = source_weights(df).select(F.col("dataset_source").alias("_s"), "weight")
    return df.join(w, F.col("dataset_source") == F.col("_s"), "left").withColumn(
        "example_weight", base * F.col("weight")).drop("_s", "weight")


def balance_weight(df: DataFrame) -> DataFrame:
    """sqrt(median group size / own group size) over source x family x label, within 0.35..4."""
    keys = ["dataset_source", "app_family", "label"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = with_group(sizes, [], _median=F.percentile("_n", F.lit(0.5)))
    weight = clip(F.sqrt(F.col("_median") / F.col("_n")), 0.35, 4.0)
    small = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], weight.alias("balance_weight"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(small, cond, "left").drop(*[f"_k_{k}" for k in keys])


def mined_weight(threshold: float, base: C = "weight", score: C = "score") -> Column:
    """Base weight times 3 / 1.75 for missed rows and 2.5 for noisy false alarms."""
    source, family = F.col("dataset_source"), F.col("app_family")
    hit = F.col(score) >= threshold if isinstance(score, str) else score >= threshold
    missed, noisy = (F.col("label") == 1) & ~hit, (F.col("label") == 0) & hit
    noisy = noisy & (family.isin("service", "other_app", "system") | (source == "parrot2025_mitmproxy"))
    out = F.col(base) if isinstance(base, str) else base
    for test, factor in ((missed & (family == "service"), 3.0), (missed & (source == HARD_POSITIVE_SOURCE), 1.75),
                         (noisy, 2.5)):
        out = out * F.when(test, factor).otherwise(1.0)
    return out


def teacher_weight(score: C = "teacher_score") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    w = 1.0 + 0.75 * F.abs(s - 0.5) * 2.0
    wrong = (s >= 0.5).cast("int") != F.col("label")
    return clip(w * F.when(wrong, 1.25).otherwise(1.0), 0.5, 2.5)


def class_weight(df: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
    """total / (classes x class size), scaled to a mean of 1 (which it has already)."""
    out = with_group(df, [label], _n=F.count(F.lit(1)))
    out = with_group(out, [], _all=F.count(F.lit(1)), _kinds=F.countDistinct(label))
    return out.withColumn(name, F.col("_all") / (F.col("_kinds") * F.col("_n"))).drop("_n", "_all", "_kinds")


def oversample(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Repeat benign rows 1 to 3 times by their example weight."""
    times = clip(F.rint(weight if weight is not None else example_weight()), 1, 3).cast("int")
    return df.filter("label = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def assign_clients(df: DataFrame, k: int, min_rows: int = 8) -> DataFrame:
    """Client of each row: its full group if large enough, else its source and family.

    With too few large groups, coarser groups ranked by size are dealt to k clients.
    """
    base = split_columns(df)
    fine = F.concat_ws("|", "dataset_source", "environment_id", "session_id", "app_family")
    keyed = base.withColumn("_fine", fine)
    large = keyed.groupBy("_fine").count().filter(F.col("count") >= min_rows)
    if large.limit(max(4, min(k, 6))).count() >= max(4, min(k, 6)):
        out = with_group(keyed, ["_fine"], _n=F.count(F.lit(1)))
        coarse = F.concat_ws("|", "dataset_source", "app_family")
        return out.withColumn("client", F.when(F.col("_n") >= min_rows, F.col("_fine")).otherwise(coarse)).drop(
            "_fine", "_n")
    keyed = base.withColumn("_coarse", F.concat_ws("|", "dataset_source", "app_family", "time_fold"))
    ranked = positions(keyed.groupBy("_coarse").count(), [], [F.desc("count"), F.asc("_coarse")], "_rn")
    named = ranked.select(F.col("_coarse").alias("_k"), F.format_string(
        "client_%02d", ((F.col("_rn") - 1) % max(1, k)).cast("int")).alias("client"))
    return keyed.join(named, F.col("_coarse") == F.col("_k"), "left").drop("_coarse", "_k")
