"""Names, orders, limits and word lists that results depend on."""

# The ordered portable window features.
FEATURES = [
    "flow_count", "total_bytes_out", "total_bytes_in", "mean_packet_size", "outbound_ratio",
    "burstiness", "novelty_score", "connection_frequency_delta", "bytes_per_flow",
    "destination_diversity", "activity_ratio", "periodic_beacon_score", "byte_rate", "packet_rate",
    "mean_duration_ms", "duration_jitter", "port_diversity", "protocol_diversity",
    "packet_imbalance", "small_flow_ratio", "high_port_ratio", "hour_of_day", "day_of_week",
    "is_weekend", "data_quality_score", "ttl_gap", "ttl_metrics_present", "syn_rate_total",
    "rst_rate_total", "ack_rate_total", "fin_rate_total", "psh_rate_total", "fragment_rate_total",
    "tcp_window_mean", "ack_delay_mean", "inter_packet_gap_mean", "payload_mean", "load_mean",
    "transport_metrics_present", "destination_concentration", "destination_transition_rate",
    "dns_flow_ratio", "web_flow_ratio", "private_destination_ratio", "multicast_destination_ratio",
    "flow_count_deviation", "byte_rate_deviation", "destination_diversity_shift", "novelty_shift",
    "recent_flow_count_mean", "recent_byte_rate_mean", "recent_novelty_mean", "flow_count_trend",
    "byte_rate_trend", "novelty_trend", "destination_diversity_trend", "consecutive_burst_windows",
    "low_volume_periodic_score", "destination_risk_score", "lookalike_score",
    "suspicious_destination_ratio", "known_identity_ratio", "mitre_technique_ratio",
    "threat_tag_ratio",
]
SERVER_FEATURES = ["destination_transition_entropy", "protocol_port_profile_diversity", "flow_size_iqr"]

REQUIRED_FLOW_COLUMNS = [
    "app_id", "timestamp_end", "bytes_out", "bytes_in", "packets_out", "packets_in", "dst_novelty",
]

# Per-flow columns averaged into a window, and the name of the mean.
FLAG_MEANS = {
    "dns_flow": "dns_flow_ratio",
    "web_flow": "web_flow_ratio",
    "private_destination": "private_destination_ratio",
    "multicast_destination": "multicast_destination_ratio",
    "destination_risk": "destination_risk_score",
    "lookalike_score_flow": "lookalike_score",
    "suspicious_destination": "suspicious_destination_ratio",
    "known_identity": "known_identity_ratio",
    "mitre_technique_flow": "mitre_technique_ratio",
    "threat_tag_flow": "threat_tag_ratio",
}
TRANSPORT_MEANS = [
    "hour_of_day", "day_of_week", "is_weekend", "data_quality_score", "ttl_gap",
    "ttl_metrics_present", "syn_rate_total", "rst_rate_total", "ack_rate_total", "fin_rate_total",
    "psh_rate_total", "fragment_rate_total", "tcp_window_mean", "ack_delay_mean",
    "inter_packet_gap_mean", "payload_mean", "load_mean", "transport_metrics_present",
]
AVAILABILITY_FLAGS = [
    "has_ttl_metrics", "has_tcp_flag_metrics", "has_fragment_metrics", "has_window_metrics",
    "has_ack_delay_metrics", "has_inter_packet_metrics", "has_payload_metrics", "has_load_metrics",
]
SUMMED_RATES = ["syn", "rst", "ack", "fin", "psh", "fragment"]
HALVED_MEANS = {  # source suffix -> window column
    "win_tcp": "tcp_window_mean",
    "ack_delay_avg": "ack_delay_mean",
    "inter_packet_avg": "inter_packet_gap_mean",
    "payload_avg": "payload_mean",
    "load": "load_mean",
}

PROVENANCE = {
    "dataset_source": "unknown_source",
    "dataset_profile": "unknown_profile",
    "dataset_variant": "unknown_variant",
    "environment_id": "unknown_environment",
    "session_id": "unknown_session",
}

# Port roles.
DNS_PORTS = [53, 853]
WEB_PORTS = [80, 443, 8000, 8080, 8443]
HIGH_PORT = 1024
SMALL_FLOW_BYTES = 256

# Three separate sets of risky top-level domains.
FEATURE_RISKY_TLDS = ["xyz", "top", "club", "click", "work", "icu", "tk", "gq", "ml", "cf"]

# Destination-risk weights of a flow.
HOST_RISK_WEIGHTS = {
    "threat_tag": 0.85, "suspicious_tld": 0.65, "punycode": 0.55,
    "digit_substitution": 0.45, "long_host": 0.30, "many_labels": 0.25,
}
DIGIT_SUBSTITUTION = "[a-z][0-9][a-z]|[0-9][a-z][0-9]"

# App families in order of precedence, with the words that select them.
FAMILY_PREFIXES = {"service_": "service", "uid_": "system"}
FAMILY_WORDS = {
    "browser": ["chrome", "firefox", "browser", "opera", "edge", "safari", "duckduckgo", "brave"],
    "telemetry": ["analytics", "telemetry", "doubleclick", "googleads", "scorecardresearch", "tracking"],
    "remote_access": ["vpn", "ssh", "rdp", "teamviewer", "anydesk", "openvpn", "ipsec", "l2tp"],
    "consumer_app": ["gmail", "outlook", "telegram", "whatsapp", "fbmessenger", "facebook",
                     "instagram", "snapchat", "twitter", "tiktok", "spotify", "netflix", "youtube"],
    "system": ["android", "systemui", "gms", "play_services", "packageinstaller"],
    "background": ["background", "daemon", "worker", "sensor", "watersensor", "temp_humidity"],
    "malware": ["spy", "rat", "mal", "phish", "attack", "anomaly", "bot"],
}
DEFAULT_FAMILY = "other_app"

# Adaptive horizons.
HORIZONS_MS = [30_000, 60_000, 300_000]
LONG_HORIZON_FAMILIES = ["service", "system", "background"]
SPARSE_FLOWS, BUSY_FLOWS = 10, 100

# Baseline deviation that counts as a burst, low-volume byte rate.
BURST_DEVIATION = 0.40
LOW_VOLUME_BYTE_RATE = 128.0
