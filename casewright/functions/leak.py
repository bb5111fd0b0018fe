"""Predicates that keep training targets out of model inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_blank, normalize_token

#: Names of target fields.
TARGET_FIELDS = (
    "attack", "attack_cat", "attack_category", "attack_family", "attack_label", "attack_subtype", "attack_type", "category", "class", "classification",
    "class_id", "detailed_label", "det_label", "family", "family_hint", "ground_truth", "groundtruth", "is_attack", "label", "label_hint",
    "label_id", "label_raw", "malicious", "malware", "outcome", "prediction", "predicted_class", "risk_class", "risk_family", "risk_label",
    "risk_type", "subcategory", "subtype", "target", "target_class", "target_value", "threat", "threat_family", "threat_label", "threat_type",
    "type_attack", "y", "y_true",
)
#: The offline list also takes ``type`` for a target.
OFFLINE_EXTRA = ("type",)
TARGET_TOKENS = ("attack", "threat", "malware")
TARGET_SUFFIXES = ("_attack", "_label", "_category", "_subcategory", "_class", "_family", "_target")
#: Texts that are target values.
TARGET_VALUES = (
    "attack", "backdoor", "benign", "botnet", "brute_force", "bruteforce", "command_and_control", "c2", "c_c", "c_c_filedownload",
    "c_c_torii", "ddos", "ddos_http", "ddos_icmp", "ddos_tcp", "ddos_udp", "dos", "exfiltration", "fingerprinting", "filedownload",
    "injection", "malicious", "malware", "man_in_the_middle", "mirai", "mitm", "part_of_a_horizontal_port_scan", "partofahorizontalportscan", "password", "port_scanning",
    "ransomware", "reconnaissance", "scanning", "sql_injection", "theft", "unknown_attack", "uploading", "vulnerability_scanner", "xss",
)
#: Key grammar of a target assignment in text.
TARGET_KEY = (
    r"(?:attack(?:[-_](?:cat|category|family|label|subtype|type))?|type[-_]attack|detailed[-_]label|det_label|label(?:[-_](?:raw|id))?"
    r"|target(?:[-_](?:class|value))?|ground[-_]?truth|category|subcategory|class(?:[-_]id)?|family|subtype|outcome"
    r"|(?:class|family|label|category)[-_]hint|classification|prediction|predicted[-_]class|risk[-_](?:class|family|label|type)"
    r"|y(?:[-_]true)?|is[-_]attack|malicious|malware|threat(?:[-_](?:family|label|type))?|type)"
)
#: Canonical paths that look like targets and are none.
ALLOWED_PATHS = (
    "attack_indicators", "service_context.protocol_family", "service_context.dns.query_class", "telemetry_context.dns.query_class", "service_context.dns.query.type", "service_context.mqtt.message.type",
    "telemetry_context.mqtt_message.type", "service_context.icmp.type", "service_context.dns.type", "service_context.dns.qry.type", "telemetry_context.iot_sensor.type", "telemetry_context.dns.query.type",
    "telemetry_context.sensor_data.type", "host_context.interface.type", "telemetry_context.geolocation.type", "service_context.process.type", "feature_groups.other.execution_class", "host_context.metric_category",
)
#: Technical fields of raw rows that look like targets and are none.
RAW_FIELDS = (
    "protocol_family", "query_class", "metric_category", "execution_class", "dns_query_type", "dns_qry_type", "mqtt_message_type", "icmp_type", "process_type", "interface_type", "iot_sensor_type", "sensor_data_type", "geolocation_type",
)
#: Top-level fields of an event whose texts may not be target values, and those whose texts may not assign one.
VALUE_CONTAINERS = ("telemetry", "host", "service_context", "host_context", "telemetry_context", "behavior_tags", "uncertainty", "asset_context", "traffic_direction", "transport_proto", "app_proto")
TEXT_FIELDS = ("semantic_text", "anomaly_summary")
#: Features that never reach the models.
FORBIDDEN_PREFIXES = ("origin.", "attack_indicator.", "semantic_hint.", "behavior.", "uncertainty.", "asset_context.")
FORBIDDEN_KEYS = ("attack_indicator_count", "behavior_tag_count", "uncertainty_count")

#: Fields of an event that a blind review may see.
EVIDENCE_FIELDS = (
    "event_id", "modality", "schema_profile", "semantic_text", "anomaly_summary", "src_ip", "src_port", "dst_ip", "dst_port", "transport_proto", "app_proto", "packet_count", "byte_count", "duration_ms", "traffic_direction",
    "asset_context", "host", "host_context", "telemetry_context", "service_context", "behavior_tags", "attack_indicators", "missing_fields",
)


def evidence_snapshot(event: Column) -> Column:
    """A map of an event's fields (nested ones as JSON texts) without all that is no evidence or empty."""
    return F.map_filter(event, lambda k, v: k.isin(*EVIDENCE_FIELDS) & ~is_blank(v) & ~F.trim(v).isin("{}", "[]", '""', "null"))


def is_target_field(name: Column, offline: bool = False) -> Column:
    """Exact name, a target token, the prefix ``attack_`` or a target suffix, after normalising."""
    token = normalize_token(F.trim(name))
    names = (*TARGET_FIELDS, *OFFLINE_EXTRA) if offline else TARGET_FIELDS
    tokens = F.arrays_overlap(F.split(token, "_"), F.array(*(F.lit(t) for t in TARGET_TOKENS)))
    return token.isin(*names) | tokens | token.startswith("attack_") | reduce(lambda a, b: a | b, (token.endswith(s) for s in TARGET_SUFFIXES))


def is_target_value(value: Column) -> Column:
    return F.coalesce(normalize_token(F.trim(value)).isin(*TARGET_VALUES), F.lit(False))


def has_target_text(text: Column) -> Column:
    """An assignment to a target key anywhere in a text."""
    return F.coalesce(text.rlike(rf"(?i)(?<![A-Za-z0-9_.-])[\"']?{TARGET_KEY}[\"']?\s*[:=]\s*"), F.lit(False))


def is_allowed_path(path: Column) -> Column:
    return F.lower(path).isin(*ALLOWED_PATHS)


def root_of(path: Column) -> Column:
    """The top-level field of a dotted path."""
    return F.regexp_extract(path, r"^[^.\[]*", 0)


def names_columns(path: Column) -> Column:
    """Lists whose items are names of columns."""
    return (path == "evidence_fields") | path.startswith("feature_groups.")


def is_allowed_feature(name: Column) -> Column:
    """False for features by forbidden prefixes or keys, which are derived from targets or identity."""
    return ~(reduce(lambda a, b: a | b, (name.startswith(p) for p in FORBIDDEN_PREFIXES)) | name.isin(*FORBIDDEN_KEYS))


def flat_violations(values: Column) -> Column:
    """Keys of a flat map that are targets with a value, or hold a target value; sorted."""
    bad = F.map_filter(values, lambda k, v: (is_target_field(k) & ~is_allowed_path(k) & (F.coalesce(v, F.lit("")) != "")) | is_target_value(v))
    return F.array_sort(F.map_keys(bad))


def sanitize_flat(values: Column) -> Column:
    """A flat map without target keys and target values."""
    return F.map_filter(values, lambda k, v: ~(is_target_field(k, offline=True) & ~is_allowed_path(k)) & ~is_target_value(v))


def scrub_simple(text: Column) -> Column:
    """Text without unquoted target assignments, spaces tidied: the subset of the scrubber that is one pattern."""
    gone = F.regexp_replace(text, rf"(?i)(^|[^A-Za-z0-9_.-]){TARGET_KEY}\s*[:=]\s*[^\s,;|]*", "$1")
    return F.trim(F.regexp_replace(gone, r"\s+", " "))
