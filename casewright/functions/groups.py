"""Feature groups, ports, keyword families, modality and schema profile of raw columns.

The word lists are ordered rules: the first that fits a name wins, and words are
looked for as substrings of the name's tokens joined by spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import normalize_token

#: Fixed values: (group, words in the name, whole tokens, words in the joined name, pairs of tokens).
FEATURE_RULES = (
    ("iot_telemetry", ("temperature", "thermostat", "sensor", "humidity", "pressure", "water", "weather"), (), (), ()),
    ("bytes", ("byte", "bytes", "payload", "tcp len", "frame len", "sbytes", "dbytes"), (), (), ()),
    ("packets", ("pkt", "pkts", "packet"), (), (), ()),
    ("source_port", (), ("srcport", "sport"), ("srcport", "sourceport", "idorigp"), (("src", "port"), ("source", "port"), ("orig", "p"))),
    ("destination_port", (), ("dstport", "dport"), ("dstport", "destport", "destinationport", "idrespp"), (("dst", "port"), ("dest", "port"), ("destination", "port"), ("resp", "p"))),
    ("source_address", ("src", "source", "orig", "saddr", "id orig"), (), (), ()),
    ("destination_address", ("dst", "dest", "resp", "daddr", "id resp"), (), (), ()),
    ("protocol", ("proto", "protocol"), (), (), ()),
    ("duration", ("duration", "dur"), (), (), ()),
    ("state_flags", ("status", "state", "flag", "flgs", "history", "conn", "ack", "seq"), (), (), ()),
    ("flow_statistics", ("rate", "mean", "stddev", "sum", "min", "max", "magnitude", "radius", "covariance"), (), (), ()),
    ("host_metrics", ("cpu", "processor", "process", "memory", "disk", "thread", "handle", "pid", "cmd"), (), (), ()),
    ("application_service", ("service", "http", "dns", "mqtt", "modbus", "ssl", "tls"), (), (), ()),
    ("textual_alert_context", ("message", "description", "rule", "alert", "raw", "log"), (), (), ()),
)
#: The rules by which ingest groups columns.
INGEST_RULES = (
    ("iot_telemetry", ("temperature", "thermostat", "sensor", "humidity", "pressure", "water", "weather"), (), (), ()),
    ("host_metrics", ("cpu", "processor", "process", "memory", "disk", "thread", "handle", "pid", "cmd"), (), (), ()),
    ("textual_alert_context", ("message", "description", "rule", "alert", "raw", "log", "signature"), (), (), ()),
    ("network_volume", ("byte", "payload", "tcp len", "frame len", "sbytes", "dbytes", "pkt", "packet", "rate"), (), (), ()),
    ("protocol", ("proto", "protocol", "service", "http", "dns", "mqtt", "modbus", "ssl", "tls"), (), (), ()),
    ("ports", (), (), ("srcport", "sourceport", "dstport", "destport", "destinationport"), (("src", "port"), ("dst", "port"), ("source", "port"), ("destination", "port"))),
    ("network_endpoint", ("src", "source", "orig", "saddr", "dst", "dest", "resp", "daddr"), (), (), ()),
    ("timing", ("duration", "dur", "time", "timestamp", "date"), (), (), ()),
    ("state_flags", ("status", "state", "flag", "flgs", "history", "conn", "ack", "seq"), (), (), ()),
    ("statistics", ("mean", "stddev", "sum", "min", "max", "magnitude", "radius", "covariance"), (), (), ()),
)
#: Names of well-known ports.
COMMON_PORTS = {20: "ftp_data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 110: "pop3", 123: "ntp", 143: "imap", 443: "https", 1883: "mqtt", 5683: "coap", 8080: "http_alt"}
#: Keywords of attack families.
FAMILY_HINTS = {
    "ddos": ("ddos", "dos", "flood", "syn", "udp flood", "tcp flood"),
    "scanning": ("scan", "recon", "probe", "enumerat"),
    "botnet": ("botnet", "mirai", "gafgyt", "torii", "c&c", "c2"),
    "bruteforce": ("brute", "password", "login", "credential"),
    "injection": ("injection", "sql", "xss", "command injection"),
    "malware": ("malware", "ransom", "backdoor", "trojan", "worm"),
    "exfiltration": ("exfil", "data theft", "leak"),
    "mitm": ("mitm", "man in the middle", "spoof"),
}
#: Other names of modalities and of schema profiles, and the profiles.
MODALITY_ALIASES = {"iot_telemetry": "telemetry", "sensor": "telemetry", "sensor_telemetry": "telemetry", "host_metrics": "host_log", "endpoint": "host_log", "endpoint_metrics": "host_log", "network_packet": "network_flow", "network_traffic": "network_flow", "flow": "network_flow", "alert_text": "alert", "log": "alert"}
PROFILE_ALIASES = {"host_log": "host_metrics", "endpoint": "host_metrics", "endpoint_metrics": "host_metrics", "telemetry": "iot_telemetry", "sensor": "iot_telemetry", "packet": "network_packet", "pcap": "pcap_ref", "alert": "alert_text", "log": "alert_text"}
PROFILES = ("network_flow", "network_packet", "host_metrics", "iot_telemetry", "alert_text", "pcap_ref", "unknown")
#: Words in column names that speak for a kind of row.
TELEMETRY_WORDS = ("sensor", "temperature", "thermostat", "humidity", "pressure", "gps", "fridge", "garage", "motion", "light", "latitude", "longitude")
NETWORK_WORDS = ("src", "source", "orig", "dst", "dest", "resp", "ip", "port", "proto", "packet", "byte", "tcp", "udp", "icmp", "http", "dns", "mqtt")
ALERT_WORDS = ("alert", "description", "event", "log", "message", "raw", "rule", "signature")
HOST_WORDS = ("process", "processor", "cpu", "memory", "logicaldisk", "disk", "paged", "privileged", "interrupt", "dpc", "thread", "handle", "windows", "linux", "vsize", "rsize", "majflt", "minflt")
HOST_SENSOR_WORDS = ("sensor", "temperature", "thermostat", "humidity", "pressure", "gps", "fridge", "garage", "modbus")
PACKET_PREFIXES = ("arp.", "eth.", "frame.", "http.", "icmp.", "ip.", "mqtt.", "tcp.", "udp.")
#: Words that make a column worth keeping when nothing else chooses.
PRIORITY_WORDS = ("src", "source", "orig", "dst", "dest", "resp", "ip", "port", "proto", "packet", "pkt", "byte", "duration", "severity", "date", "time", "timestamp", "process", "memory", "cpu", "processor", "disk", "sensor", "temp", "humidity", "pressure")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def _grouped(name: Column, rules: tuple) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    joined = F.replace(spaced, F.lit(" "), F.lit(""))
    token = lambda t: spaced.rlike(f"(^| ){t}( |$)")
    out = F.lit("other")
    for group, words, tokens, compact, pairs in reversed(rules):
        fits = _any(spaced, words) | _any(joined, compact)
        for t in tokens:
            fits = fits | token(t)
        for a, b in pairs:
            fits = fits | (token(a) & token(b))
        out = F.when(fits, F.lit(group)).otherwise(out)
    return out


def rules_sql(name: str, rules: tuple) -> str:
    """The same ladder as DuckDB SQL, over an expression."""
    spaced = f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'))"
    token = lambda t: f"regexp_matches({spaced}, '(^| ){t}( |$)')"
    cases = []
    for group, words, tokens, compact, pairs in rules:
        tests = [f"contains({spaced}, '{w}')" for w in words] + [f"contains(replace({spaced}, ' ', ''), '{w}')" for w in compact] + [token(t) for t in tokens] + [f"({token(a)} AND {token(b)})" for a, b in pairs]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{group}'")
    return f"CASE {' '.join(cases)} ELSE 'other' END"


def feature_group(name: Column) -> Column:
    """Group of a feature name for the models."""
    return _grouped(name, FEATURE_RULES)


def ingest_group(name: Column) -> Column:
    """Group of a raw column name at ingest."""
    return _grouped(name, INGEST_RULES)


def port_bucket(port: Column) -> Column:
    """Name of a well-known port, else system, registered or ephemeral."""
    names = F.create_map(*(F.lit(x) for pair in COMMON_PORTS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, port.cast("int")), F.when(port < 1024, "system").when(port < 49152, "registered").when(port.isNotNull(), "ephemeral"))


def keyword_hints(text: Column) -> Column:
    """Attack families of which a keyword is in the text, in fixed order."""
    lower = F.lower(text)
    return F.array_compact(F.array(*(F.when(_any(lower, words), F.lit(family)) for family, words in FAMILY_HINTS.items())))


def _alias(value: Column, aliases: dict[str, str]) -> Column:
    out = value
    for key, name in aliases.items():
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out


def _has(keys: Column, words: tuple[str, ...]) -> Column:
    return F.exists(keys, lambda k: _any(F.lower(k), words))


def has_host(keys: Column) -> Column:
    hits = F.size(F.filter(keys, lambda k: _any(F.lower(k), HOST_WORDS)))
    sensors = F.size(F.filter(keys, lambda k: _any(F.lower(k), HOST_SENSOR_WORDS)))
    return (hits > 0) & (hits >= sensors)


def _clean(value: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")


def normalize_modality(value: Column, keys: Column) -> Column:
    """Modality by its aliases, corrected by what the column names show."""
    cleaned = _clean(value)
    modality = _alias(F.when(cleaned == "", F.lit("network_flow")).otherwise(cleaned), MODALITY_ALIASES)
    return F.when((modality == "telemetry") & has_host(keys), F.lit("host_log")).when((modality == "network_flow") & _has(keys, TELEMETRY_WORDS) & ~_has(keys, NETWORK_WORDS), F.lit("telemetry")).otherwise(modality)


def infer_profile(value: Column, modality: Column, keys: Column) -> Column:
    """Schema profile: the stated one by its aliases, else the first rule that fits."""
    stated = _alias(_clean(value), PROFILE_ALIASES)
    packets = F.size(F.filter(keys, lambda k: reduce(lambda a, b: a | b, (F.lower(k).startswith(p) for p in PACKET_PREFIXES))))
    inferred = (
        F.when((modality == "host_log") | has_host(keys), "host_metrics")
        .when((modality == "telemetry") | (_has(keys, TELEMETRY_WORDS) & ~_has(keys, NETWORK_WORDS)), "iot_telemetry")
        .when(modality == "alert", "alert_text")
        .when(modality == "pcap_ref", "pcap_ref")
        .when(packets >= 3, "network_packet")
        .when(_has(keys, ALERT_WORDS), "alert_text")
        .when(_has(keys, NETWORK_WORDS) | (modality == "network_flow"), "network_flow")
        .otherwise("unknown")
    )
    return F.when(stated.isin(*PROFILES), stated).otherwise(inferred)


def schema_profile(profile: Column, modality: Column, keys: Column) -> Column:
    """Profile of a canonical event: explicit, by modality, by telemetry key names, else the modality."""
    lower = F.transform(keys, F.lower)
    packet = F.exists(lower, lambda k: reduce(lambda a, b: a | b, (k.startswith(p) for p in ("tcp.", "udp.", "icmp.", "mqtt.", "http.", "arp."))))
    flow = F.arrays_overlap(lower, F.array(F.lit("src_port"), F.lit("dst_port"))) | F.exists(lower, lambda k: k.contains("state") | k.contains("proto"))
    return (
        F.when(F.coalesce(profile, F.lit("")) != "", profile)
        .when(modality == "host_log", "host_metrics")
        .when(modality == "telemetry", "iot_telemetry")
        .when(modality == "alert", "alert_text")
        .when(packet, "network_packet")
        .when(flow, "network_flow")
        .otherwise(modality)
    )


def column_score(name: Column, value_present: Column) -> Column:
    """How many priority words a column name holds, plus one for a value."""
    hits = reduce(lambda a, b: a + b, (F.lower(name).contains(w).cast("int") for w in PRIORITY_WORDS))
    return hits + value_present.cast("int")


def origin_features(dataset: Column, source_file: Column, profile: Column) -> Column:
    """Array of (key, value) features that say where a row comes from; production models don't get them."""
    folder = normalize_token(F.coalesce(F.try_element_at(F.split(F.coalesce(source_file, F.lit("")), "/"), F.lit(-2)), F.lit("")))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    return F.filter(F.array(entry(F.lit("origin.dataset"), normalize_token(F.coalesce(dataset, F.lit("unknown")))), entry(F.lit("origin.source_dir"), folder), entry(F.concat(F.lit("origin_schema."), profile), F.lit("1"))), lambda e: e["value"] != "")
