"""Privacy views, sequences, splits, samples and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.base import query
from netloom.catalog.evaluate import scored, show
from netloom.catalog.sql import cte, with_
from netloom.functions.scalars import r6
from netloom.operators import privacy as pv
from netloom.operators import sequences as sq
from netloom.operators import splits as sp
from netloom.sources.tables import flow_view

KEYS = ["app_id", "window_bucket"]


@query("h01_stable_hash", with_("flows", select="SELECT flow_id, sha256('netloom:' || app_id) AS hashed FROM flows"))
def h01(spark, sf):
    return flow_view(spark, sf).select("flow_id", pv.stable_hash("app_id").alias("hashed"))


@query("h02_flow_views", with_("flows", select=" UNION ALL ".join(f"""
SELECT '{t}' AS tier, flow_id, {a} AS app_id, {d} AS destination_key, {p} AS dst_port, {r} AS protocol FROM flows""" for t, a, d, p, r in (
    ("off", "app_id", "destination_key", "dst_port::VARCHAR", "protocol"),
    ("low", "sha256('netloom:' || app_id)", "sha256('netloom:' || destination_key)", "dst_port::VARCHAR", "protocol"),
    ("medium", "sha256('netloom:' || app_id)", "''", "CASE WHEN dst_port <= 1023 THEN 'system' WHEN dst_port <= 49151 THEN 'registered' ELSE 'dynamic' END", "protocol"),
    ("strict", "sha256('netloom:' || app_id)", "''", "CASE WHEN dst_port <= 1023 THEN 'system' WHEN dst_port <= 49151 THEN 'registered' ELSE 'dynamic' END", "protocol || '_LIKE'")))))
def h02(spark, sf):
    f, out = flow_view(spark, sf), None
    for tier in pv.VIEW_COLUMNS:
        v = pv.flow_privacy_view(f, tier).select(F.lit(tier).alias("tier"), "flow_id", "app_id", "destination_key",
                                                 F.col("dst_port").cast("string").alias("dst_port"), "protocol")
        out = v if out is None else out.unionByName(v)
    return out


def rank_sql(expr: str, buckets: int, by: str) -> str:
    """Level of the average percent rank of expr in its group."""
    return f"""CASE WHEN min({expr}) OVER (PARTITION BY {by}) = max({expr}) OVER (PARTITION BY {by}) THEN 0.0 ELSE floor(least(0.999999, (
      rank() OVER (PARTITION BY {by} ORDER BY {expr}) + (count(*) OVER (PARTITION BY {by}, {expr}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {by})) * {buckets}) / {float(buckets - 1)} END"""


@query("h03_rank_quantize", with_("windows", select=f"SELECT app_id, window_bucket, round({rank_sql('flow_count', 5, '1')}, 6) AS flow_count_bucket, round({rank_sql('ln(1 + burstiness)', 5, '1')}, 6) AS burst FROM windows"))
def h03(spark, sf):
    w = scored(spark, sf)
    out = pv.rank_quantize(pv.rank_quantize(w, "flow_count", 5), "burstiness", 5, log=True, name="burst")
    return show(out, KEYS, ["flow_count_bucket", "burst"])


@query("h04_rank_by_source", with_("windows", select=f"SELECT app_id, window_bucket, round({rank_sql('flow_count', 4, 'dataset_source')}, 6) AS flow_count_bucket FROM windows"))
def h04(spark, sf):
    return show(pv.rank_quantize(scored(spark, sf), "flow_count", 4, ["dataset_source"]), KEYS, ["flow_count_bucket"])


@query("h05_super_bucket", with_("windows", select="SELECT app_id, window_bucket, round_even(outbound_ratio * 2, 0) / 2.0 AS half, round_even(small_flow_ratio * 4, 0) / 4.0 AS quarter FROM windows"))
def h05(spark, sf):
    return scored(spark, sf).select(*KEYS, pv.super_bucket("outbound_ratio", 2).alias("half"), pv.super_bucket("small_flow_ratio", 4).alias("quarter"))


@query("h06_privacy_columns", with_("windows", select=f"""
, w AS (SELECT *, hour(make_timestamp(window_end_ms * 1000)) AS hr, round(destination_diversity, 9) AS dd FROM windows)
SELECT app_id, window_bucket, round(CASE WHEN hr < 6 THEN 0 WHEN hr < 12 THEN 1.0 / 3 WHEN hr < 18 THEN 2.0 / 3 ELSE 1 END, 6) AS hour_period,
  CASE WHEN isodow(make_timestamp(window_end_ms * 1000)) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend, CASE WHEN hr < 7 THEN 0.0 WHEN hr < 19 THEN 0.5 ELSE 1.0 END AS temporal_regime,
  round_even(novelty_score * 4, 0) / 4.0 AS novelty_bucket, round({rank_sql('flow_count', 5, '1')}, 6) AS activity_level_bucket,
  round({rank_sql('ln(1 + total_bytes_out + total_bytes_in)', 4, 'dataset_source')}, 6) AS volume_dp_bucket,
  round({rank_sql('ln(1.0 + flow_count)', 4, 'dataset_source')}, 6) AS activity_dp_bucket,
  round_even(({rank_sql('ln(1 + byte_rate)', 4, 'dataset_source')} + {rank_sql('ln(1 + packet_rate)', 4, 'dataset_source')}) * 0.5 * 4, 0) / 4.0 AS rate_dp_bucket,
  round_even(packet_imbalance * 2, 0) / 2.0 AS packet_imbalance_super_bucket FROM w"""))
def h06(spark, sf):
    out = pv.privacy_columns(scored(spark, sf))
    return show(out, KEYS, ["hour_period", "is_weekend", "temporal_regime", "novelty_bucket", "activity_level_bucket", "volume_dp_bucket",
                            "activity_dp_bucket", "rate_dp_bucket", "packet_imbalance_super_bucket"])


@query("h07_view_columns", with_("windows", select="""
SELECT 'off' AS view, 73 AS columns, count(*) AS rows, 0 AS leaks FROM windows UNION ALL SELECT 'low', 73, count(*), 0 FROM windows
UNION ALL SELECT 'medium', 21, count(*), 0 FROM windows UNION ALL SELECT 'strict', 18, count(*), 0 FROM windows"""))
def h07(spark, sf):
    hidden = {"novelty_score", "destination_diversity", "periodic_beacon_score", "high_port_ratio", "destination_concentration"}
    out = None
    for view, df in pv.privacy_views(scored(spark, sf)).items():
        leaks = len(hidden & set(df.columns)) if view in ("medium", "strict") else 0
        line = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(view).alias("view"), F.lit(len(df.columns)).alias("columns"), "rows",
                                                              F.lit(leaks).alias("leaks"))
        out = line if out is None else out.unionByName(line)
    return out


LOG4 = "floor(greatest(0, least(0.999999, ln(1 + greatest(0, {c})) / 12.0)) * 4) / 3.0"
LOG8 = "floor(greatest(0, least(0.999999, ln(1 + greatest(0, {c})) / 14.0)) * 8) / 7.0"


@query("h08_reduce_features", with_("windows", select=f"""
SELECT app_id, window_bucket, round({LOG4.format(c='flow_count')}, 6) AS m_flow_count, round({LOG4.format(c='burstiness')}, 6) AS m_burstiness, 0.0 AS m_novelty_score,
  round_even(outbound_ratio * 4, 0) / 4.0 AS m_outbound_ratio, round({LOG8.format(c='byte_rate')}, 6) AS p_byte_rate, round_even(novelty_score * 8, 0) / 8.0 AS p_novelty_score,
  round(floor(day_of_week - 1) / 6.0, 6) AS p_day_of_week, 0.0 AS p_threat_tag_ratio FROM windows"""))
def h08(spark, sf):
    w = scored(spark, sf)
    m, p = pv.reduce_features(w, "medium"), pv.reduce_features(w, "medium_plus")
    a = m.select(*KEYS, *[r6(c).alias(f"m_{c}") for c in ("flow_count", "burstiness", "novelty_score", "outbound_ratio")])
    b = p.select(*KEYS, *[r6(c).alias(f"p_{c}") for c in ("byte_rate", "novelty_score", "day_of_week", "threat_tag_ratio")])
    return a.join(b, KEYS)


@query("h09_hash_features", with_("windows", select="""
SELECT app_id, window_bucket, round((('0x' || substr(sha256('netloom:high_port_ratio:' || CAST(round_even(CAST(high_port_ratio AS DECIMAL(30, 12)), 6) AS DECIMAL(30, 6))), 1, 12))::BIGINT % 64) / 63.0, 6) AS high_port_ratio,
  round((('0x' || substr(sha256('netloom:dns_flow_ratio:' || CAST(round_even(CAST(dns_flow_ratio AS DECIMAL(30, 12)), 6) AS DECIMAL(30, 6))), 1, 12))::BIGINT % 64) / 63.0, 6) AS dns_flow_ratio FROM windows"""))
def h09(spark, sf):
    return show(pv.hash_features(scored(spark, sf)), KEYS, ["high_port_ratio", "dns_flow_ratio"])


@query("h10_representations")
def h10(spark, sf):
    out = None
    for name in pv.REPRESENTATIONS:
        line = pv.representation(scored(spark, sf), name).agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("flow_count").alias("flow_counts"),
            F.countDistinct("novelty_score").alias("novelties")).withColumn("representation", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


def export_flows(spark, sf):
    from netloom.catalog.normalize import export_rows

    return export_rows(spark, sf).withColumns({"device_label": F.lit("phone"), "http_path": F.lit("/a"), "tls_sni": F.lit("s.example")})


@query("h11_export_tiers", with_("flows", select="""
, f AS (SELECT *, CASE WHEN k % 3 = 0 THEN dst_host END AS hint, '10.0.0.' || k % 5 AS src FROM flows)
SELECT 'OFF' AS mode, flow_id, app_id, src AS src_ip, dst_port, coalesce(hint, '93.184.216.34') || ':' || dst_port AS destination_key, hint AS site_hint, '/a' AS http_path, 's.example' AS tls_sni, 'phone' AS device_label FROM f
UNION ALL SELECT 'LOW', flow_id, app_id, sha256('netloom:' || src), dst_port, coalesce(hint || ':' || dst_port, sha256(destination_key)), hint, '/a', 's.example', 'phone' FROM f
UNION ALL SELECT 'STRICT', flow_id, sha256('netloom:' || app_id), sha256('netloom:' || src), dst_port, sha256(destination_key), NULL, NULL, NULL, 'phone' FROM f
UNION ALL SELECT 'CUSTOM', flow_id, sha256('netloom:' || app_id), sha256('netloom:' || src), CASE WHEN dst_port IN (53, 80, 443) THEN dst_port WHEN dst_port <= 49151 THEN 49152 ELSE 65535 END,
  coalesce(hint || ':' || CASE WHEN dst_port IN (53, 80, 443) THEN dst_port WHEN dst_port <= 49151 THEN 49152 ELSE 65535 END, sha256(destination_key)), hint, NULL, 's.example', NULL FROM f"""))
def h11(spark, sf):
    f, out = export_flows(spark, sf), None
    for mode, options in (("OFF", {}), ("LOW", {}), ("STRICT", {}), ("CUSTOM", {"site_hint": True})):
        v = pv.export_view(f, mode, options).select(F.lit(mode).alias("mode"), "flow_id", "app_id", "src_ip", F.col("dst_port").cast("long").alias("dst_port"),
                                                    "destination_key", "site_hint", "http_path", "tls_sni", "device_label")
        out = v if out is None else out.unionByName(v)
    return out


@query("h12_write_views")
def h12(spark, sf):
    import uuid

    from netloom.session import shared_dir

    path = f"{shared_dir(spark)}/netloom-views-{uuid.uuid4().hex}"
    return pv.write_views(flow_view(spark, sf), scored(spark, sf), path).drop("path")


# ---- sequences
@query("i01_codes", with_("flows", select="""
SELECT flow_id, CASE WHEN dst_port <= 1023 THEN 0.0 WHEN dst_port <= 49151 THEN 0.5 ELSE 1.0 END AS port_bucket, CASE protocol WHEN 'TCP' THEN 1.0 ELSE 0.5 END AS protocol_code FROM flows"""))
def i01(spark, sf):
    return flow_view(spark, sf).select("flow_id", sq.port_bucket("dst_port").alias("port_bucket"), sq.protocol_code("protocol").alias("protocol_code"))


cte("seq", ["flows"], """
SELECT app_id, dataset_source, environment_id, session_id, c.start, f.*  EXCLUDE (app_id, dataset_source, environment_id, session_id)
FROM (SELECT *, row_number() OVER w - 1 AS pos, greatest(0, coalesce(timestamp_end - lag(timestamp_end) OVER w, 0)) AS gap, ln(1.0 + bytes_out + bytes_in) AS lb, bytes_out / (bytes_out + bytes_in + 1.0::DOUBLE) AS ob,
    count(*) OVER (PARTITION BY app_id, dataset_source, environment_id, session_id) AS n
  FROM flows WINDOW w AS (PARTITION BY app_id, dataset_source, environment_id, session_id ORDER BY timestamp_end, flow_id)) f
JOIN (SELECT unnest(range(0, 200000, 4)) AS start) c ON c.start <= f.pos AND f.pos < c.start + 8
""")


@query("i02_flow_sequences", with_("seq", select="""
SELECT app_id || '|' || dataset_source || '|' || environment_id || '|' || session_id || '|' || start AS sequence_id, round(count(*) / 8.0, 6) AS seq_flow_fraction, round(ln(1.0 + sum(bytes_out + bytes_in)), 6) AS seq_log_total_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY app_id, dataset_source, environment_id, session_id, pos ORDER BY start) AS x FROM seq) GROUP BY ALL HAVING count(*) >= 6"""))
def i02(spark, sf):
    s = sq.flow_sequences(flow_view(spark, sf), 8, 4, 6)
    return show(s, ["sequence_id"], ["seq_flow_fraction", "seq_log_total_bytes"])


@query("i03_sequence_features", with_("seq", select="""
SELECT app_id || '|' || dataset_source || '|' || environment_id || '|' || session_id || '|' || start AS sequence_id, round(ln(1 + avg(duration_ms)), 6) AS seq_log_mean_duration_ms, round(ln(1 + avg(gap)), 6) AS seq_log_mean_interarrival_ms,
  round(avg(ob), 6) AS seq_outbound_ratio_mean, round(count(DISTINCT protocol) / count(*)::DOUBLE, 6) AS seq_protocol_diversity, round(coalesce(max(lb) FILTER (pos = start + 7), 0), 6) AS s07_log_total_bytes,
  round(coalesce(max(ln(1.0 + gap)) FILTER (pos = start + 2), 0), 6) AS s02_log_interarrival_ms FROM seq GROUP BY ALL HAVING count(*) >= 6"""))
def i03(spark, sf):
    s = sq.flow_sequences(flow_view(spark, sf), 8, 4, 6)
    return show(s, ["sequence_id"], ["seq_log_mean_duration_ms", "seq_log_mean_interarrival_ms", "seq_outbound_ratio_mean",
                                     "seq_protocol_diversity", "s07_log_total_bytes", "s02_log_interarrival_ms"])


@query("i04_target_frame", with_("flows", select="""
SELECT flow_id, destination_key FROM (SELECT *, count(*) OVER (PARTITION BY destination_key) AS n, row_number() OVER (PARTITION BY destination_key ORDER BY flow_id) AS rn FROM flows) WHERE n >= 200 AND rn <= 150"""))
def i04(spark, sf):
    return sq.target_frame(flow_view(spark, sf), "destination_key", 200, 150, ["flow_id"]).select("flow_id", "destination_key")


def level_id(c: str) -> str:
    return f"CAST(round({rank_sql(c, 3, '1')} * 2) AS INT)"


@query("i05_buckets", with_("windows", select=f"""
SELECT app_id, window_bucket, environment_id || '|' || window_end_ms // 14400000 AS context_bucket,
  'nov' || {level_id('novelty_score')} || '|div' || {level_id('destination_diversity')} || '|port' || {level_id('high_port_ratio')} || '|beacon' || {level_id('round(periodic_beacon_score, 9)')} AS behaviour_bucket FROM windows"""))
def i05(spark, sf):
    w = scored(spark, sf).withColumn("periodic_beacon_score", F.round("periodic_beacon_score", 9))
    return sq.behaviour_bucket(sq.context_bucket(w)).select(*KEYS, "context_bucket", "behaviour_bucket")


@query("i06_cap_classes", with_("flows", select="""
, c AS (SELECT destination_key, row_number() OVER (ORDER BY count(*) DESC, destination_key) AS rn FROM flows GROUP BY 1)
SELECT flow_id, CASE WHEN rn <= 9 THEN destination_key ELSE '__other__' END AS destination_key FROM flows JOIN c USING (destination_key)"""))
def i06(spark, sf):
    return sq.cap_classes(flow_view(spark, sf), "destination_key", 10).select("flow_id", "destination_key")


def hashed(seed, *parts: str) -> str:
    """Order expression of rank_by_hash."""
    return f"substr(sha256({seed} || '|' || {" || '|' || ".join(parts)}), 1, 15)"


@query("i07_class_holdout", with_("scored", select=f"""
, g AS (SELECT app_family, session_id, count(*) AS n FROM scored GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY app_family ORDER BY {hashed(42, 'app_family', 'session_id')}, session_id) AS upto, sum(n) OVER (PARTITION BY app_family) AS c FROM g),
t AS (SELECT *, upto - n < greatest(1, round(c * 0.3::DOUBLE)) AND upto < c AS test FROM p),
r AS (SELECT s.id, t.c, t.test, max(t.test::INT) OVER (PARTITION BY s.app_family) AS whole,
  row_number() OVER (PARTITION BY s.app_family ORDER BY {hashed(42, 's.id')}, s.id) AS rn FROM scored s JOIN t ON s.app_family = t.app_family AND s.session_id = t.session_id)
SELECT id, CASE WHEN CASE WHEN whole = 1 THEN test ELSE rn <= least(greatest(1, round(c * 0.3::DOUBLE)), c - 1) END THEN 'test' ELSE 'train' END AS split FROM r WHERE c >= 2"""))
def i07(spark, sf):
    return sq.class_holdout(scored(spark, sf), "app_family", ["session_id"]).select("id", "split")


@query("i08_attack_metrics", with_("flows", select="""
, p AS (SELECT k % 5 AS truth, CASE WHEN k % 3 = 0 THEN k % 5 ELSE (k + 1) % 4 END AS guess FROM flows),
c AS (SELECT c, (SELECT count(*) FROM p WHERE truth = c) AS support, (SELECT count(*) FROM p WHERE guess = c) AS predicted, (SELECT count(*) FROM p WHERE truth = c AND guess = c) AS tp FROM range(5) r(c))
SELECT sum(support)::BIGINT AS rows, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(2.0 * tp / (support + predicted)), 6) AS macro_f1, round(avg(tp / support::DOUBLE), 6) AS balanced_accuracy,
  round((sum(tp) / sum(support) - 0.2) / 0.8, 6) AS normalized_leakage FROM c"""))
def i08(spark, sf):
    k = F.col("k")
    p = flow_view(spark, sf).select((k % 5).alias("truth"), F.when(k % 3 == 0, k % 5).otherwise((k + 1) % 4).alias("guess"))
    return show(sq.multiclass_metrics(p), ["rows"], ["accuracy", "macro_f1", "balanced_accuracy", "normalized_leakage"])


# ---- splits, samples, weights
@query("j01_split_columns", with_("windows", select="SELECT app_id, window_bucket, window_end_ms // 14400000 || '' AS time_fold, dataset_source AS dataset_source, dataset_variant AS session_id FROM windows"))
def j01(spark, sf):
    return sp.split_columns(scored(spark, sf).drop("session_id")).select(*KEYS, "time_fold", "dataset_source", "session_id")


@query("j02_group_keys", with_("windows", select="""
SELECT app_id, window_bucket, dataset_source || '|' || CASE WHEN environment_id = 'env_0' THEN 'unknown_environment_' || app_id || ':' || window_bucket ELSE environment_id END || '|' || session_id AS key_source_env_session,
  app_family || '|' || window_end_ms // 14400000 AS key_family_time FROM windows"""))
def j02(spark, sf):
    s = scored(spark, sf).withColumn("environment_id", F.regexp_replace("environment_id", "env_0", " "))
    return sp.group_keys(s).select(*KEYS, "key_source_env_session", "key_family_time")


def split_sql(p: str, rows: str, seed: int, frac: float, first: str | None = None) -> str:
    """Tables of a group split: every strategy and attempt, then the first whose sides hold two classes."""
    names = [*([first] if first else []), *[n for n in sp.STRATEGIES if n != first]]
    keys = [" || '|' || ".join("CAST(window_end_ms // 14400000 AS VARCHAR)" if c == "time_fold" else c for c in sp.STRATEGIES[n]) for n in names]
    return f"""{p}k AS (SELECT id, label, unnest({names}) AS strategy, unnest({list(range(len(names)))}) AS place, unnest([{', '.join(keys)}]) AS key FROM {rows}),
{p}g AS (SELECT strategy, key, attempt, row_number() OVER (PARTITION BY strategy, attempt ORDER BY {hashed(f'({seed} + attempt)', 'key')}, key) AS rn,
  count(*) OVER (PARTITION BY strategy, attempt) AS n FROM (SELECT DISTINCT strategy, key FROM {p}k) CROSS JOIN (SELECT unnest([0, 1, 2]) AS attempt)),
{p}a AS (SELECT k.*, g.attempt, g.n, CASE WHEN g.rn <= greatest(1, ceil(g.n * {frac}::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM {p}k k JOIN {p}g g USING (strategy, key)),
{p}b AS (SELECT place, attempt FROM (SELECT place, attempt, split, count(DISTINCT label) AS kinds, min(n) AS n FROM {p}a GROUP BY ALL)
  GROUP BY ALL HAVING count(*) = 2 AND min(kinds) = 2 AND min(n) >= 2 ORDER BY place, attempt LIMIT 1),
{p}o AS (SELECT id, split, strategy FROM {p}a JOIN {p}b USING (place, attempt))"""


@query("j03_group_split", with_("scored", select=f"""
, {split_sql('a_', 'scored', 42, 0.25, 'source_env_session')} SELECT id, split, strategy FROM a_o"""))
def j03(spark, sf):
    out, used = sp.group_split(scored(spark, sf), "source_env_session")
    return out.select("id", "split", F.lit(used).alias("strategy"))


@query("j04_nested_split", with_("scored", select=f"""
, {split_sql('a_', 'scored', 42, 0.25)}, train AS (SELECT scored.* FROM scored JOIN a_o USING (id) WHERE split = 'train'),
{split_sql('b_', 'train', 59, 0.25)}
SELECT id, split FROM a_o WHERE split = 'test' UNION ALL SELECT id, CASE split WHEN 'test' THEN 'validation' ELSE split END FROM b_o"""))
def j04(spark, sf):
    train, test, _ = sp.nested_split(scored(spark, sf))
    return train.select("id", "split").unionByName(test.select("id", "split"))


@query("j05_split_summary", with_("windows", select="""
SELECT split, count(*) AS rows, count(DISTINCT dataset_source) AS dataset_sources, count(DISTINCT app_family) AS app_families, count(DISTINCT window_end_ms // 14400000) AS time_folds
FROM (SELECT *, CASE WHEN window_bucket % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM windows) GROUP BY split"""))
def j05(spark, sf):
    s = sp.split_columns(scored(spark, sf)).withColumn("split", F.when(F.col("window_bucket") % 4 == 0, "test").otherwise("train"))
    return sp.split_summary(s)


def sample_sql(p: str, rows: str, key: str, want: str, id_col: str) -> str:
    """Tables of a sample shared over the key by largest remainders; ``{p}o`` holds its ids."""
    size = f"(SELECT sum(n) FROM {p}c)"
    return f"""{p}c AS (SELECT {key} AS key, count(*) AS n FROM {rows} GROUP BY 1),
{p}q AS (SELECT *, n * least({want}, {size}) / {size}::DOUBLE AS x FROM {p}c),
{p}r AS (SELECT *, floor(x) AS b, row_number() OVER (ORDER BY x - floor(x) DESC, key) AS rn FROM {p}q),
{p}s AS (SELECT key, b + CASE WHEN rn <= least({want}, {size}) - (SELECT sum(b) FROM {p}r) THEN 1 ELSE 0 END AS quota FROM {p}r),
{p}i AS (SELECT {id_col}, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY {hashed(42, id_col)}, {id_col}) AS rn FROM {rows}),
{p}o AS (SELECT {id_col} FROM {p}i JOIN {p}s USING (key) WHERE {p}i.rn <= quota)"""


@query("j06_sample_by_source", with_("flows", select=f"""
, {sample_sql('a_', 'flows', 'dataset_source', '1237', 'flow_id')} SELECT flow_id FROM a_o"""))
def j06(spark, sf):
    return sp.sample_by_source(flow_view(spark, sf), 1237, id_col="flow_id").select("flow_id")


@query("j07_cap_windows", with_("scored", select=f"""
, benign AS (SELECT * FROM scored WHERE label = 0), {sample_sql('a_', 'benign', 'dataset_source', '200', 'id')}
SELECT id FROM scored WHERE label = 1 UNION ALL SELECT id FROM a_o"""))
def j07(spark, sf):
    return sp.cap_windows(scored(spark, sf), benign=200).select("id")


@query("j08_sample_flows", with_("flows", select=f"""
, pos AS (SELECT * FROM flows WHERE label > 0), neg AS (SELECT * FROM flows WHERE label <= 0), take AS (SELECT least(count(*), 500) AS t FROM pos),
{sample_sql('a_', 'pos', 'dataset_source', '(SELECT t FROM take)', 'flow_id')},
{sample_sql('b_', 'neg', 'dataset_source', '(SELECT 1000 - t FROM take)', 'flow_id')}
SELECT flow_id FROM a_o UNION ALL SELECT flow_id FROM b_o"""))
def j08(spark, sf):
    return sp.sample_flows(flow_view(spark, sf), 1000).select("flow_id")


@query("j09_samples", with_("flows", select=f"""
, {sample_sql('a_', 'flows', "dataset_source || '|' || label", '400', 'flow_id')},
ranked AS (SELECT flow_id, row_number() OVER (ORDER BY {hashed(42, 'flow_id')}, flow_id) AS rn,
  row_number() OVER (PARTITION BY label ORDER BY {hashed(42, 'flow_id')}, flow_id) AS in_label FROM flows)
SELECT 'natural' AS mode, flow_id FROM ranked WHERE rn <= 400 UNION ALL SELECT 'balanced', flow_id FROM ranked WHERE in_label <= 200
UNION ALL SELECT 'source_label', flow_id FROM a_o"""))
def j09(spark, sf):
    f, out = flow_view(spark, sf), None
    for mode in ("natural", "balanced", "source_label"):
        line = sp.sample(f, mode, 400, id_col="flow_id").select(F.lit(mode).alias("mode"), "flow_id")
        out = line if out is None else out.unionByName(line)
    return out


SRC = "['parrot2025_mitmproxy', 'cicandmal2017_android', 'westermo'][CAST(substr(dataset_source, 5) AS INT) + 1]"


def sourced(spark, sf):
    names = F.array(*[F.lit(x) for x in ("parrot2025_mitmproxy", "cicandmal2017_android", "westermo")])
    return scored(spark, sf).withColumn("dataset_source", F.element_at(names, F.substring("dataset_source", 5, 1).cast("int") + 1))


cte("sourced", ["scored"], f"SELECT * REPLACE ({SRC} AS dataset_source) FROM scored")
EXAMPLE = """CASE WHEN label = 0 THEN 1.0 + CASE WHEN dataset_source = 'parrot2025_mitmproxy' THEN 1.25 ELSE 0 END + CASE WHEN app_family IN ('browser', 'telemetry', 'system', 'background') THEN 0.65 ELSE 0 END
  ELSE 1.15 + CASE WHEN dataset_source = 'cicandmal2017_android' THEN 0.15 ELSE 0 END + CASE app_family WHEN 'service' THEN 0.3 WHEN 'malware' THEN 0.15 ELSE 0 END END"""


@query("j10_example_weight", with_("sourced", select=f"SELECT app_id, window_bucket, round({EXAMPLE}, 6) AS weight FROM sourced"))
def j10(spark, sf):
    return sourced(spark, sf).select(*KEYS, r6(sp.example_weight()).alias("weight"))


@query("j10_service_weight", with_("sourced", select="""
, s AS (SELECT dataset_source, least(3.0, greatest(0.65, sqrt((SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM sourced GROUP BY dataset_source)) / count(*)))) AS w FROM sourced GROUP BY 1)
SELECT app_id, window_bucket, round(w * CASE WHEN label = 0 THEN 1.0 + CASE WHEN app_family IN ('browser', 'telemetry', 'system', 'background') THEN 0.45 ELSE 0 END ELSE 1.0 + CASE WHEN app_family = 'malware' THEN 0.15 ELSE 0 END END, 6) AS example_weight
FROM sourced JOIN s USING (dataset_source)"""))
def j10_service(spark, sf):
    return show(sp.service_example_weight(sourced(spark, sf)), KEYS, ["example_weight"])


@query("j11_balance_weight", with_("windows", select="""
, g AS (SELECT dataset_source, app_family, label, count(*) AS n FROM windows GROUP BY ALL)
SELECT app_id, window_bucket, round(least(4.0, greatest(0.35, sqrt((SELECT quantile_cont(n, 0.5) FROM g) / n))), 6) AS balance_weight FROM windows JOIN g USING (dataset_source, app_family, label)"""))
def j11(spark, sf):
    return show(sp.balance_weight(scored(spark, sf)), KEYS, ["balance_weight"])


@query("j12_mined_weight", with_("sourced", select="""
SELECT app_id, window_bucket, round(2.0 * CASE WHEN label = 1 AND score < 0.5 AND app_family = 'service' THEN 3.0 ELSE 1 END * CASE WHEN label = 1 AND score < 0.5 AND dataset_source = 'cicandmal2017_android' THEN 1.75 ELSE 1 END
  * CASE WHEN label = 0 AND score >= 0.5 AND (app_family IN ('service', 'other_app', 'system') OR dataset_source = 'parrot2025_mitmproxy') THEN 2.5 ELSE 1 END, 6) AS weight FROM sourced"""))
def j12(spark, sf):
    return sourced(spark, sf).select(*KEYS, r6(sp.mined_weight(0.5, F.lit(2.0))).alias("weight"))


@query("j13_teacher_weight", with_("scored", select="""
SELECT app_id, window_bucket, round(greatest(0.5, least(2.5, (1 + 0.75 * abs(score - 0.5) * 2) * CASE WHEN (score >= 0.5) <> (label = 1) THEN 1.25 ELSE 1 END)), 6) AS weight FROM scored"""))
def j13(spark, sf):
    return scored(spark, sf).select(*KEYS, r6(sp.teacher_weight("score")).alias("weight"))


@query("j14_class_weight", with_("windows", select="""
SELECT app_id, window_bucket, round((SELECT count(*) FROM windows) / ((SELECT count(DISTINCT app_family) FROM windows) * count(*) OVER (PARTITION BY app_family))::DOUBLE, 6) AS class_weight FROM windows"""))
def j14(spark, sf):
    return show(sp.class_weight(scored(spark, sf), "app_family"), KEYS, ["class_weight"])


@query("j15_oversample", with_("sourced", select=f"SELECT app_id, window_bucket, unnest(range(1, CAST(least(3, greatest(1, round_even({EXAMPLE}, 0))) AS INT) + 1)) AS copy FROM sourced WHERE label = 0"))
def j15(spark, sf):
    return sp.oversample(sourced(spark, sf)).select(*KEYS, "copy")


@query("j16_assign_clients", with_("windows", select="""
SELECT app_id, window_bucket, CASE WHEN count(*) OVER (PARTITION BY dataset_source, environment_id, session_id, app_family) >= 8 THEN dataset_source || '|' || environment_id || '|' || session_id || '|' || app_family
  ELSE dataset_source || '|' || app_family END AS client FROM windows"""))
def j16(spark, sf):
    return sp.assign_clients(scored(spark, sf), 6).select(*KEYS, "client")
