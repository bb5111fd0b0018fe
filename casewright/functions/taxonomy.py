"""Attack taxonomy: types, dataset names and the resolution of native labels as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import normalize_token

#: The first fourteen types, and the two that the wider taxonomy adds.
TYPES_14 = ("Backdoor", "DDoS_HTTP", "DDoS_ICMP", "DDoS_TCP", "DDoS_UDP", "Fingerprinting", "MITM", "Password", "Port_Scanning", "Ransomware", "SQL_injection", "Uploading", "Vulnerability_scanner", "XSS")
TYPES_16 = (*TYPES_14, "DoS", "Command_and_Control")
VERSION_16 = "multidataset_attack_type_v1_2026-09-06"
VERSION_14 = "taxonomy_14"
STATUSES = ("exact", "forced", "benign", "ambiguous", "out_of_taxonomy")
DATASETS = {"edgeiiotset": "edge_iiotset", "edge_iiotset": "edge_iiotset", "botiot": "bot_iot", "bot_iot": "bot_iot", "iot_23": "iot23", "iot23": "iot23", "toniot": "ton_iot", "ton_iot": "ton_iot"}
BENIGN = ("normal", "benign", "benigno")

#: Rules (dataset, class, subclass, status, type, reason) of the sixteen types; ``*`` fits all.
#: The first rule that fits wins. The type ``?`` is decided by the raw protocol, ``=`` is the class's own name.
RULES_16 = (
    ("edge_iiotset", "=", "*", "exact", "=", "edge_native_attack_type"),
    ("edge_iiotset", "*", "*", "out_of_taxonomy", None, "edge_label_not_in_multidataset_taxonomy"),
    ("bot_iot", "ddos", "http", "exact", "DDoS_HTTP", "bot_target_subcategory"),
    ("bot_iot", "ddos", "tcp", "exact", "DDoS_TCP", "bot_target_subcategory"),
    ("bot_iot", "ddos", "udp", "exact", "DDoS_UDP", "bot_target_subcategory"),
    ("bot_iot", "ddos", "*", "ambiguous", None, "bot_ddos_requires_target_subcategory"),
    ("bot_iot", "dos", "*", "exact", "DoS", "bot_native_dos_coarsened"),
    ("bot_iot", "reconnaissance", "os_fingerprint", "exact", "Fingerprinting", "bot_target_os_fingerprint"),
    ("bot_iot", "reconnaissance", "service_scan", "forced", "Port_Scanning", "bot_service_scan_forced_to_port_scanning"),
    ("bot_iot", "reconnaissance", "*", "ambiguous", None, "bot_reconnaissance_requires_target_subcategory"),
    ("bot_iot", "theft", "*", "out_of_taxonomy", None, "bot_theft_insufficient_support"),
    ("bot_iot", "*", "*", "out_of_taxonomy", None, "bot_label_not_in_multidataset_taxonomy"),
    ("iot23", "partofahorizontalportscan", "*", "exact", "Port_Scanning", "iot23_horizontal_port_scan"),
    ("iot23", "c_c", "*", "exact", "Command_and_Control", "iot23_native_command_and_control"),
    ("iot23", "c_c_filedownload", "*", "exact", "Command_and_Control", "iot23_native_command_and_control"),
    ("iot23", "c_c_torii", "*", "exact", "Command_and_Control", "iot23_native_command_and_control"),
    ("iot23", "ddos", "*", "forced", "?", "iot23_ddos"),
    ("iot23", "filedownload", "*", "out_of_taxonomy", None, "iot23_filedownload_insufficient_support"),
    ("iot23", "*", "*", "out_of_taxonomy", None, "iot23_label_not_in_multidataset_taxonomy"),
    ("ton_iot", "backdoor", "*", "exact", "Backdoor", "ton_native_exact_label"),
    ("ton_iot", "mitm", "*", "exact", "MITM", "ton_native_exact_label"),
    ("ton_iot", "password", "*", "exact", "Password", "ton_native_exact_label"),
    ("ton_iot", "ransomware", "*", "exact", "Ransomware", "ton_native_exact_label"),
    ("ton_iot", "xss", "*", "exact", "XSS", "ton_native_exact_label"),
    ("ton_iot", "ddos", "*", "forced", "?", "ton_ddos"),
    ("ton_iot", "dos", "*", "exact", "DoS", "ton_native_dos_coarsened"),
    ("ton_iot", "injection", "*", "forced", "SQL_injection", "ton_injection_forced_to_sql_injection"),
    ("ton_iot", "scanning", "*", "forced", "Port_Scanning", "ton_scanning_forced_to_port_scanning"),
    ("ton_iot", "*", "*", "out_of_taxonomy", None, "ton_label_not_in_multidataset_taxonomy"),
)
#: The same for the fourteen types, which never derive a type from the protocol.
RULES_14 = (
    ("edge_iiotset", "=", "*", "exact", "=", "edge_native_attack_type"),
    ("edge_iiotset", "*", "*", "out_of_taxonomy", None, "edge_label_not_in_taxonomy_14"),
    ("ton_iot", "backdoor", "*", "exact", "Backdoor", "ton_native_exact_label"),
    ("ton_iot", "mitm", "*", "exact", "MITM", "ton_native_exact_label"),
    ("ton_iot", "password", "*", "exact", "Password", "ton_native_exact_label"),
    ("ton_iot", "ransomware", "*", "exact", "Ransomware", "ton_native_exact_label"),
    ("ton_iot", "xss", "*", "exact", "XSS", "ton_native_exact_label"),
    ("ton_iot", "ddos", "*", "ambiguous", None, "ton_ddos_does_not_identify_subtype"),
    ("ton_iot", "injection", "*", "ambiguous", None, "ton_injection_does_not_identify_subtype"),
    ("ton_iot", "scanning", "*", "ambiguous", None, "ton_scanning_does_not_identify_subtype"),
    ("ton_iot", "dos", "*", "out_of_taxonomy", None, "dos_is_not_ddos"),
    ("ton_iot", "*", "*", "out_of_taxonomy", None, "ton_label_not_in_taxonomy_14"),
    ("bot_iot", "ddos", "http", "exact", "DDoS_HTTP", "bot_target_subcategory"),
    ("bot_iot", "ddos", "tcp", "exact", "DDoS_TCP", "bot_target_subcategory"),
    ("bot_iot", "ddos", "udp", "exact", "DDoS_UDP", "bot_target_subcategory"),
    ("bot_iot", "ddos", "*", "ambiguous", None, "bot_ddos_requires_target_subcategory"),
    ("bot_iot", "reconnaissance", "os_fingerprint", "exact", "Fingerprinting", "bot_target_os_fingerprint"),
    ("bot_iot", "reconnaissance", "service_scan", "ambiguous", None, "service_scan_is_not_strictly_port_scanning"),
    ("bot_iot", "reconnaissance", "*", "ambiguous", None, "bot_reconnaissance_requires_target_subcategory"),
    ("bot_iot", "dos", "*", "out_of_taxonomy", None, "dos_is_not_ddos"),
    ("bot_iot", "theft", "*", "out_of_taxonomy", None, "theft_is_not_an_attack_type_14"),
    ("bot_iot", "*", "*", "out_of_taxonomy", None, "bot_label_not_in_taxonomy_14"),
    ("iot23", "partofahorizontalportscan", "*", "exact", "Port_Scanning", "iot23_horizontal_port_scan"),
    ("iot23", "ddos", "*", "ambiguous", None, "iot23_ddos_does_not_identify_protocol_subtype"),
    ("iot23", "*", "*", "out_of_taxonomy", None, "iot23_label_not_in_taxonomy_14"),
)
#: Raw service and protocol that settle a generic DDoS, in order of precedence.
PROTOCOLS = (("service", ("http", "http_alt", "http_proxy"), "DDoS_HTTP", "raw_service_http"), ("icmp", ("icmp",), "DDoS_ICMP", "raw_protocol_icmp"), ("protocol", ("udp",), "DDoS_UDP", "raw_protocol_udp"), ("protocol", ("tcp",), "DDoS_TCP", "raw_protocol_tcp"))


def normalize_dataset(value: Column) -> Column:
    key = normalize_token(value)
    out = key
    for alias, name in DATASETS.items():
        out = F.when(key == alias, F.lit(name)).otherwise(out)
    return out


def resolve(dataset: Column, native: Column, sub: Column, proto: Column | None = None, service: Column | None = None, rules: tuple = RULES_16) -> Column:
    """(status, attack_type, reason) of a native label."""
    data, cls, part = normalize_dataset(dataset), normalize_token(native), normalize_token(sub)
    proto_key = normalize_token(F.lit(None).cast("string") if proto is None else proto)
    service_key = normalize_token(F.lit(None).cast("string") if service is None else service)
    own = F.lit(None).cast("string")
    for name in TYPES_14:
        own = F.when(cls == name.lower(), F.lit(name)).otherwise(own)
    row = lambda status, kind, reason: F.struct(F.lit(status).alias("status"), (F.lit(kind) if not isinstance(kind, Column) else kind).cast("string").alias("attack_type"), F.lit(reason).alias("reason"))
    out = row("out_of_taxonomy", None, "dataset_not_supported")
    for name, c, s, status, kind, reason in reversed(rules):
        fits = data == name
        if c == "=":
            fits = fits & own.isNotNull()
        elif c != "*":
            fits = fits & (cls == c)
        if s != "*":
            fits = fits & (part == s)
        if kind == "?":
            found = row("ambiguous", None, f"{reason}_missing_raw_protocol")
            for field, keys, type_, said in reversed(PROTOCOLS):
                test = service_key.isin(*keys) if field == "service" else proto_key.startswith("icmp") if field == "icmp" else proto_key.isin(*keys)
                found = F.when(test, row("forced", type_, f"{reason}_{said}")).otherwise(found)
        else:
            found = row(status, own if kind == "=" else kind, reason)
        out = F.when(fits, found).otherwise(out)
    return F.when(cls.isin(*BENIGN), row("benign", None, "handled_by_binary_detector")).otherwise(out)


def derive_origin(path: Column, markers: tuple[tuple[str, str], ...]) -> Column:
    """Origin of a file path: the first marker that it contains."""
    out = F.lit("unknown")
    for marker, name in reversed(markers):
        out = F.when(F.lower(path).contains(marker), F.lit(name)).otherwise(out)
    return out


def classes(version: str) -> tuple[str, ...]:
    """The closed class list of a version; an unknown version is an error."""
    known = {VERSION_16: TYPES_16, VERSION_14: TYPES_14}
    if version not in known:
        raise ValueError(f"unknown taxonomy version {version!r}")
    return known[version]


def report(spark: SparkSession) -> DataFrame:
    """(version, n_classes, n_rules, sha256): every version with the hash of its class list as compact JSON."""
    rules = {VERSION_16: RULES_16, VERSION_14: RULES_14}
    rows = [(v, len(classes(v)), len(rules[v]), list(classes(v))) for v in sorted(rules)]
    frame = spark.createDataFrame(rows, "version string, n_classes long, n_rules long, names array<string>")
    return frame.select("version", "n_classes", "n_rules", F.sha2(F.to_json("names"), 256).alias("sha256"))
