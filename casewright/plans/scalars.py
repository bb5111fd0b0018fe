"""Queries over scalar functions and flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import contracts, groups, hashing, leak, taxonomy, values
from casewright.operators import vectors
from casewright.operators import sampling as S
from casewright.session import spread, table

from .views import sql, v_attempt, v_case, v_manifest

_ORDER = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_WORD = lambda column, n: f"lower(split_part({column}, ' ', {n}))"


def _case(number: str, *ways: str, other: str) -> str:
    """One expression for each remainder of a number."""
    return f"CASE {number} % {len(ways) + 1} " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(ways)) + f" ELSE {other} END"


_PAD = lambda n: f"lpad(CAST({n} AS STRING), 2, '0')"
_CLOCK = f"concat({_PAD('o_orderkey % 24')}, ':', {_PAD('o_orderkey % 60')}, ':', {_PAD('o_custkey % 60')})"
_SECONDS = "(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_custkey % 60)"
_YMD = lambda mark: f"concat(CAST(year(o_orderdate) AS STRING), '{mark}', {_PAD('month(o_orderdate)')}, '{mark}', {_PAD('day(o_orderdate)')})"
_MONTH = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * CAST(month(o_orderdate) AS INT) - 2, 3)"
_TIMES = (
    (f"concat({_YMD('-')}, ' ', {_CLOCK})", _SECONDS), (f"concat({_YMD('/')}, ' ', {_CLOCK})", _SECONDS), (f"concat(CAST(day(o_orderdate) AS STRING), '-', {_MONTH}, '-', CAST(year(o_orderdate) AS STRING), ' ', {_CLOCK})", _SECONDS),
    (f"concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING), ' ', {_CLOCK})", _SECONDS), (f"concat({_YMD('-')}, 'T', {_CLOCK}, 'Z')", _SECONDS), (_YMD("-"), "0"),
    ("CAST(1000000000 + o_orderkey AS STRING)", None), ("concat(CAST(1000000000 + o_orderkey AS STRING), '.5')", None), ("CAST(o_custkey % 1000 AS STRING)", None), ("o_orderpriority", None),
)

#: Inputs of scalar functions, made of columns by expressions that both engines read alike: table and (name, expression) pairs.
MADE = {
    "number": ("orders", {"raw": _case("o_orderkey", _ORDER, f"concat('-', {_ORDER})", "concat('  ', CAST(o_custkey AS STRING), ' ')", "concat(CAST(o_orderkey AS STRING), ',', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'))", "concat('1_', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'))", "concat('+', CAST(o_custkey AS STRING), '.0')", "o_orderpriority", "o_orderstatus", "concat('.', CAST(o_custkey AS STRING))", "concat(CAST(o_custkey AS STRING), '.')", "concat(CAST(o_custkey AS STRING), 'e', CAST(o_orderkey % 14 AS STRING))", "CASE WHEN o_custkey % 2 = 0 THEN 'nan' ELSE 'None' END", "CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '-' END", "concat('0.0', CAST(o_custkey % 2 AS STRING))", other="concat(CAST(o_custkey AS STRING), 'd')")}),
    "duration": ("part", {"raw": _case("p_partkey", "concat(CAST(p_size AS STRING), 'ms')", "concat(CAST(p_size AS STRING), '.5s')", "concat('1m', CAST(p_size AS STRING), 's')", "concat(CAST(p_size AS STRING), 'h', CAST(p_partkey % 60 AS STRING), 'm3s')", "CAST(p_size AS STRING)", "concat(CAST(p_size AS STRING), '.25')", other="p_brand")}),
    "name": ("part", {"name": "concat(" + _case("p_size", "'src_'", "'id.resp_'", "'tcp.'", "'Frame.'", "'dns.qry.'", "'min '", "'conn_'", "'http-'", "'id.orig_'", other="''") + f", {_WORD('p_name', 1)}, " + _case("p_partkey", "'_port'", "'.bytes'", "'_ip'", "'.len'", "'_state'", "' message'", "'Duration'", "'_pct'", "'_h'", "'.srcport'", "'_temperature'", other="''") + ")"}),
    "feature": ("part", {"name": "concat(" + _case("p_partkey", "'origin.'", "'behavior.'", "'context.service.'", "'semantic_hint.'", "'uncertainty.'", "'asset_context.'", "'attack_indicator.'", other="''") + f", CASE WHEN p_size % 9 = 0 THEN 'behavior_tag_count' ELSE {_WORD('p_type', 2)} END)"}),
    "target": ("part", {"name": _case("p_partkey", "'Label'", "'type'", "'Y_True'", f"concat('attack ', {_WORD('p_type', 2)})", f"concat({_WORD('p_type', 1)}, '_label')", f"concat({_WORD('p_type', 2)}, '-Category')", "concat('is_', lower(p_brand))", f"concat('my threat ', {_WORD('p_name', 1)})", f"concat({_WORD('p_type', 1)}, '.target')", f"concat('k', {_WORD('p_type', 3)}, 'class')", f"concat('Class ', {_WORD('p_type', 3)})", other=_WORD("p_name", 2))}),
    "value": ("events", {"v": _case("event_id", "concat('DDoS-', CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'Udp' ELSE event_type END)", "concat(' ', CASE user_id % 2 WHEN 0 THEN 'XSS' ELSE event_type END, ' ')", "upper(event_type)", "concat('SQL', CASE user_id % 2 WHEN 0 THEN ' ' ELSE '' END, 'Injection')", "props", "CASE user_id % 2 WHEN 0 THEN 'C&C' ELSE 'benign' END", other="event_type")}),
    "path": ("customer", {"path": "concat(" + _case("c_nationkey", "'service_context.dns'", "'Host_Context'", "'telemetry_context.dns'", "'service_context'", other="lower(c_mktsegment)") + ", '.', " + _case("c_custkey", "'type'", "'query_class'", "'Interface.Type'", "'protocol_family'", "'query.type'", other="lower(c_mktsegment)") + ")"}),
    "chain": ("events", {"modality": _case("event_id", "'network_flow'", "'Sensor'", "'telemetry'", "'flow'", "''", "'endpoint-metrics'", "'alert_text'", "'pcap ref'", "'host_log'", "'alert'", other="event_type"), "cols": "concat(" + _case("user_id", "'src_ip,dst_port'", "'temperature'", "'cpu,memory'", "'tcp.len,ip.src,eth.dst'", "'proto'", "'msg'", "'Humidity,src_ip'", other="event_type") + ", ',', event_type)"}),
    "dataset": ("part", {"raw": "concat(" + _case("p_partkey", "'Edge-IIoTset'", "'EdgeIIoTset'", "'Bot IoT'", "'botiot'", "'IoT-23'", "' TON_IoT '", "'toniot'", "''", other="p_brand") + ", CASE WHEN p_size % 7 = 0 THEN '!' ELSE '' END)"}),
    "label": ("events", {"dataset": _case("event_id", "'Edge-IIoTset'", "'bot_iot'", "'IoT-23'", "'ton_iot'", "'TonIoT'", "'botiot'", other="event_type"), "native": _case("user_id", "'DDoS_TCP'", "'DDoS'", "'Reconnaissance'", "'ddos'", "'DoS'", "'C&C'", "'xss'", "'Injection'", "'scanning'", "'Theft'", "'PartOfAHorizontalPortScan'", "'Normal'", other="event_type"), "sub": _case("event_id", "'HTTP'", "'TCP'", "'OS_Fingerprint'", "'Service scan'", other="''"), "proto": _case("user_id", "'TCP'", "'udp'", "'icmp6'", "event_type", other="''"), "service": _case("event_id", "'http'", "'dns'", "'HTTP-proxy'", "''", "event_type", other="''")}),
    "time": ("orders", {"raw": _case("o_orderkey", *(t for t, _ in _TIMES), other="''")}),
}
_TIME_US = _case("o_orderkey", *(f"epoch_us(o_orderdate) + {sec} * 1000000" if sec else us for (_, sec), us in zip(_TIMES, [None] * 6 + ["(1000000000 + o_orderkey) * 1000000", "(1000000000 + o_orderkey) * 1000000 + 500000", "NULL", "NULL"], strict=True)), other="NULL")


def _made(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The key and the made columns of every row of a table."""
    name, columns = MADE[kind]
    rows = table(spark, d, name)
    return rows.select(F.col(rows.columns[0] if name != "lineitem" else "l_orderkey").alias("k"), *(F.expr(e).alias(c) for c, e in columns.items()))


def _from(kind: str) -> str:
    """The same in SQL."""
    name, columns = MADE[kind]
    key = {"orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "customer": "c_custkey"}[name]
    return f"(SELECT {key} AS k, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name}) AS t"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


NUM_SQL = values.NUMBER_PATTERN
TRIM = r"regexp_replace(raw, '^\s+|\s+$', '', 'g')"
TOKEN = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '_', 'g'), '_')"
TOKEN40 = lambda x: f"coalesce(nullif(left({TOKEN(x)}, 40), ''), 'unknown')"
TARGET_SQL = lambda x, extra=(): f"({TOKEN(f'trim({x})')} IN {_in((*leak.TARGET_FIELDS, *extra))} OR regexp_matches({TOKEN(f'trim({x})')}, '(^|_)(attack|threat|malware)(_|$)') OR regexp_matches({TOKEN(f'trim({x})')}, '(_attack|_label|_category|_subcategory|_class|_family|_target)$') OR starts_with({TOKEN(f'trim({x})')}, 'attack_'))"


def _part_tokens(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", values.normalize_token(F.concat_ws(" / ", "p_type", "p_brand")).alias("token"))


def _port(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") * 37) % 65536).alias("port"))
    return e.select("event_id", "port", groups.port_bucket(F.col("port")).alias("bucket"))


PORT_SQL = "CASE port " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in groups.COMMON_PORTS.items()) + " ELSE CASE WHEN port < 1024 THEN 'system' WHEN port < 49152 THEN 'registered' ELSE 'ephemeral' END END"
HINT_SQL = "list_aggregate(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{f}' END" for f, ws in groups.FAMILY_HINTS.items()) + "], lambda x: x IS NOT NULL), 'string_agg', ',')"


def _measures(spark, d) -> DataFrame:
    """Line measures in long form: one (event, key, number) row each."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*(F.sum(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice")))
    return li.unpivot(["l_orderkey"], ["l_quantity", "l_tax", "l_discount", "l_extendedprice"], "key", "num").withColumn("key", F.when(F.col("key") == "l_quantity", "src_bytes").when(F.col("key") == "l_tax", "dst_bytes").when(F.col("key") == "l_discount", "duration").otherwise("rate_sum"))


MEASURE_SQL = ", m AS (SELECT l_orderkey, sum(l_quantity) AS src_bytes, sum(l_tax) AS dst_bytes, sum(l_discount) AS duration, sum(l_extendedprice) AS rate_sum FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, 'src_bytes' AS key, src_bytes AS num FROM m UNION ALL SELECT l_orderkey, 'dst_bytes', dst_bytes FROM m UNION ALL SELECT l_orderkey, 'duration', duration FROM m UNION ALL SELECT l_orderkey, 'rate_sum', rate_sum FROM m)"


def _group_stats(spark, d):
    m = _measures(spark, d).withColumn("grp", groups.feature_group(F.col("key")))
    r = lambda c: F.round(c, 6)
    return m.groupBy("l_orderkey", "grp").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.log1p(F.abs("num")))).alias("abs_log_mean"), r(F.min("num")).alias("lo"), r(F.max("num")).alias("hi"), r(F.avg("num")).alias("mean"),
        F.round(F.stddev_pop("num"), 4).alias("std"), r(F.max("num") - F.min("num")).alias("span"),
        F.round(F.count_if(F.col("num") == 0) / F.count(F.lit(1)), 6).alias("zero_ratio"), F.round(F.count_if(F.col("num") > 0) / F.count(F.lit(1)), 6).alias("positive_ratio"),
    )


def _row_map(spark, d) -> DataFrame:
    """Customers as flat string maps, some keys of which look like targets."""
    c = table(spark, d, "customer")
    seg = F.when(F.col("c_custkey") % 7 == 0, F.lit("ddos")).otherwise(F.lower("c_mktsegment"))
    return c.select("c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("label"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("x")), F.lit("segment"), seg, F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("threat_score"), F.when(F.col("c_custkey") % 2 == 0, F.lit("9"))).alias("m"))


ROWMAP_SQL = ", rm AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS label, CASE WHEN c_custkey % 7 = 0 THEN 'ddos' ELSE lower(c_mktsegment) END AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_custkey % 2 = 0 THEN '9' END AS threat_score FROM customer)"


def _columns(spark, d) -> DataFrame:
    """Proposed column lists, some with a repeat or an unknown name, some empty, against the row's columns."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    proposed = F.array(F.lit("c_name"), F.when(k % 3 == 2, "c_nationkey").otherwise(F.concat(F.lit("x"), (k % 3).cast("string"))), F.when(k % 5 == 0, "c_name").otherwise("c_phone"), F.when(k % 2 == 0, "c_acctbal").otherwise("c_custkey"))
    return c.select("c_custkey", F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(proposed).alias("proposed"), F.array(*(F.lit(x) for x in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_phone", "x1"))).alias("present"))


def _ranking(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), v.alias("present")) for k, (n, v) in enumerate(
        (("src_ip", F.col("c_custkey") % 2 == 0), ("c_name", F.lit(True)), ("port_time", F.col("c_acctbal") > 0), ("zzz", F.lit(False)), ("proto", F.col("c_nationkey") > 10))
    )))).alias("c")).select("c_custkey", "c.*")
    scored = c.withColumn("score", groups.column_score(F.col("name"), F.col("present")).cast("bigint")).where("score > 0")
    w = Window.partitionBy("c_custkey").orderBy(F.desc("score"), F.asc("pos"))
    return scored.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 3").select("c_custkey", "name", "score", "rn")


PRIORITY_SQL = " + ".join(f"CAST(contains(lower(name), '{w}') AS BIGINT)" for w in groups.PRIORITY_WORDS)


def _features_long(spark, d):
    """Feature map of an order in long form: ports, numbers, group flags."""
    o = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 37) % 65536).alias("dst_port"), F.col("o_totalprice").alias("byte_count"), F.col("o_orderpriority").alias("transport_proto"))
    kv = lambda k, v: F.struct(k.alias("key"), v.cast("double").alias("num"))
    rows = F.array(
        kv(F.lit("byte_count.present"), F.lit(1)), kv(F.lit("byte_count.log1p_abs"), F.round(F.log1p(F.abs("byte_count")), 6)), kv(F.lit("dst_port.present"), F.lit(1)), kv(F.lit("dst_port.raw"), F.col("dst_port")),
        kv(F.concat(F.lit("dst_port."), groups.port_bucket(F.col("dst_port"))), F.lit(1)), kv(F.concat(F.lit("transport_proto="), values.normalize_token_40(F.col("transport_proto"))), F.lit(1)), kv(F.lit("semantic_hint.ddos"), F.lit(1)),
    )
    return o.select("o_orderkey", F.explode(F.filter(rows, lambda r: leak.is_allowed_feature(r["key"]))).alias("f")).select("o_orderkey", "f.key", "f.num")


FEATURES_SQL = f"""SELECT o_orderkey, key, num FROM (SELECT o_orderkey, unnest(['byte_count.present', 'byte_count.log1p_abs', 'dst_port.present', 'dst_port.raw', 'dst_port.' || bucket, 'transport_proto=' || tok]) AS key,
 unnest([CAST(1 AS DOUBLE), round(ln(1 + abs(o_totalprice)), 6), 1, CAST(port AS DOUBLE), 1, 1]) AS num FROM (SELECT *, {PORT_SQL} AS bucket, {TOKEN40('o_orderpriority')} AS tok FROM (SELECT *, (o_orderkey * 37) % 65536 AS port FROM orders)))"""


def _vocabulary(spark, d):
    return vectors.indexed(_features_long(spark, d), "key").select("key", F.col("index").alias("idx"))


#: One deviation from a good answer in each line: field, value, the code that must come.
DEVIATIONS = (
    ("ok", "false", "not_ok"), ("abstain", "true", "abstain_declared"), ("review", "true", "review_declared"), ("failure", "'timeout'", "failure_declared"), ("fallback", "true", "fallback_declared"), ("cache_key", "'k'", "cache_key_declared"),
    ("from_cache", "CAST(NULL AS BOOLEAN)", "from_cache_invalid"), ("source", "'adapter'", "source_invalid"), ("provider", "'other'", "provider_mismatch"), ("model", "' '", "model_missing"), ("selected", "array('a', '')", "columns_invalid"),
    ("selected", "CAST(array() AS ARRAY<STRING>)", "columns_missing"), ("selected", "array('a', 'a')", "columns_repeated"), ("selected", "array('z')", "columns_unknown"), ("notes", "array('parsed_by_llm')", "notes_incomplete"),
    ("notes", "array('parsed_by_llm', 'source:mistral_live', ' LLM_Failed once')", "notes_forbidden"), ("notes", "array('parsed_by_llm', 'source:mistral_live', 'security_boundary:sanitized')", "notes_claim"),
    ("notes", "array('parsed_by_llm', 'source:mistral_live', 'source:mistral_cache')", "live_as_cache"), ("content_hash", "'abc'", "content_hash_invalid"), ("pipeline_hash", "'x'", "pipeline_hash_invalid"), ("content_hash", "sha2('other', 256)", "content_hash_mismatch"),
    ("n_unknown", "1", "event_fields_unknown"), ("n_leaks", "1", "event_leaks"), ("event_id", "'x'", "event_id_mismatch"), ("origin_file", "'other'", "origin_mismatch"), ("event_split", "'val'", "provenance_mismatch"),
    ("confidence", "CAST(NULL AS DOUBLE)", "confidence_missing"), ("event_confidence", "confidence + 0.001D", "confidence_mismatch"), ("given", "true", "source_invalid"),
)
GOOD_ANSWER = (
    ("ok", "true"), ("abstain", "false"), ("review", "false"), ("failure", "''"), ("fallback", "false"), ("cache_key", "CAST(NULL AS STRING)"), ("from_cache", "false"), ("given", "false"), ("source", "'llm'"), ("provider", "'mistral'"), ("model", "'m'"), ("selected", "array('a', 'b')"), ("row_keys", "array('a', 'b', 'c')"),
    ("notes", "array('parsed_by_llm', 'source:mistral_live')"), ("content_hash", "sha2(state, 256)"), ("pipeline_hash", "CAST(NULL AS STRING)"), ("input_hash", "sha2(state, 256)"), ("n_unknown", "0"), ("n_leaks", "0"), ("event_id", "concat('llm::events::inline::', seq)"), ("dataset", "'events'"), ("source_file", "CAST(NULL AS STRING)"),
    ("row_id", "CAST(seq AS STRING)"), ("split", "'stream'"), ("origin_dataset", "'events'"), ("origin_file", "'inline'"), ("origin_row", "CAST(seq AS STRING)"), ("event_split", "'stream'"), ("confidence", "confidence"), ("event_confidence", "confidence"),
)


def _contract(spark, d):
    """Every attempt as an answer with one deviation, or none."""
    k = F.col("seq") % (len(DEVIATIONS) + 1)
    a = v_attempt(spark, d)
    values_ = {name: F.expr(good) for name, good in GOOD_ANSWER}
    for i, (name, bad, _) in enumerate(DEVIATIONS):
        values_[name] = F.when(k == i, F.expr(bad)).otherwise(values_[name])
    r = a.select("seq", F.struct(*(c.alias(name) for name, c in values_.items())).alias("r"))
    return r.select("seq", F.coalesce(contracts.first_failure(contracts.standardization_rules(F.col("r"))), F.lit("valid")).alias("code"))


CONTRACT_SQL = f"SELECT seq, CASE seq % {len(DEVIATIONS) + 1} " + " ".join(f"WHEN {i} THEN '{code}'" for i, (_, _, code) in enumerate(DEVIATIONS)) + " ELSE 'valid' END AS code FROM v_attempt"


def _guard(spark, d):
    """Every attempt as a request: a row, a text or an event, some of them with too much, too little or the wrong split."""
    a, k = v_attempt(spark, d), F.col("seq") % 10
    none = F.lit(None)
    row = F.when(k.isin(0, 1, 4, 5), F.create_map(F.lit("state"), F.col("state"))).when(k == 8, F.create_map().cast("map<string,string>"))
    text = F.when(k.isin(2, 4), F.col("state")).when(k == 9, F.lit("  "))
    event = F.when(k.isin(3, 5, 6), F.col("props"))
    code = contracts.input_guard(F.when(k == 1, "dev").otherwise("train"), F.when(k == 7, " ").otherwise("events"), row, F.coalesce(text, none.cast("string")), event, k != 6)
    return a.groupBy(F.coalesce(code, F.lit("accepted")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


GUARD_SQL = "SELECT CASE seq % 10 WHEN 1 THEN 'standardization_input_invalid' WHEN 7 THEN 'standardization_input_invalid' WHEN 4 THEN 'standardization_input_ambiguous' WHEN 5 THEN 'standardization_input_ambiguous' WHEN 6 THEN 'canonical_event_invalid' WHEN 8 THEN 'standardization_input_missing' WHEN 9 THEN 'standardization_input_missing' ELSE 'accepted' END AS code, count(*) AS n FROM v_attempt GROUP BY 1"


def _complete(spark, d):
    """Customers as rows and, in part, as what a model made of them."""
    c = table(spark, d, "customer")
    text = lambda name: F.col(name).cast("string")
    payload = F.map_filter(F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("mapping_confidence"), F.when(F.col("c_custkey") % 4 != 0, (F.col("c_acctbal") / 5000).cast("string")), F.lit("ts"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2020-01-01")), F.lit("missing_fields"), F.lit("duration_ms,c_name,ts,bogus")), lambda k, v: v.isNotNull())
    row = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("cpu_pct"), text("c_nationkey"), F.lit("seg"), F.col("c_mktsegment"), F.lit("gone"), F.lit(""))
    parts = contracts.completed(payload, row, F.lit("customers"), F.lit(None).cast("string"), text("c_custkey"), F.when(F.col("c_custkey") % 5 != 0, "test"), ("ts", "duration_ms", "c_name"))
    flat = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return c.select("c_custkey", parts["event_id"].alias("event_id"), F.round(parts["mapping_confidence"], 6).alias("mapping_confidence"), parts["split"].alias("split"), F.array_join(parts["missing_fields"], ",").alias("missing_fields"), flat(parts["telemetry"]).alias("telemetry"), flat(parts["host"]).alias("host"))


COMPLETE_SQL = "SELECT c_custkey, 'llm::customers::inline::' || c_custkey AS event_id, round(greatest(0, least(1, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 5000 ELSE CAST(0.5 AS DOUBLE) END)), 6) AS mapping_confidence, CASE WHEN c_custkey % 5 <> 0 THEN 'test' ELSE 'stream' END AS split, CASE WHEN c_custkey % 3 = 0 THEN 'duration_ms' ELSE 'duration_ms,ts' END AS missing_fields, 'seg' AS telemetry, 'cpu_pct' AS host FROM customer"


def _prune(spark, d):
    m = _row_map(spark, d)
    kept = F.map_filter("m", lambda k, v: ~values.is_blank(v))
    return m.select("c_custkey", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept_keys"))


def _sanitized(spark, d):
    m = _row_map(spark, d)
    return m.select("c_custkey", F.array_join(F.array_sort(F.map_keys(leak.sanitize_flat(F.col("m")))), ",").alias("kept_keys"))


def _violations(spark, d):
    m = _row_map(spark, d)
    return m.select("c_custkey", F.array_join(leak.flat_violations(F.col("m")), ",").alias("violations"))


def _infer_groups(spark, d):
    m = _row_map(spark, d).select("c_custkey", F.explode("m").alias("key", "value")).where(~values.is_blank(F.col("value")))
    g = m.withColumn("grp", groups.ingest_group(F.concat(F.lit("src_"), F.col("key"))))
    return g.groupBy("c_custkey", "grp").agg(F.array_join(F.slice(F.array_sort(F.collect_set("key")), 1, 40), ",").alias("columns"))


#: A closed schema of the kinds that stages use.
CUSTOMER_SCHEMA = {
    "type": "object",
    "required": ["id", "balance"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "balance": {"type": ["number", "null"], "minimum": 0, "maximum": 9000},
        "segment": {"type": "string", "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2}},
        "place": {"type": "object", "required": ["nation"], "properties": {"nation": {"type": "integer"}}},
    },
}


def _schema_violations(spark, d):
    """Customers as JSON, spoiled by the customer's number, against a closed schema."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    number = lambda name: F.col(name).cast("string")
    js = F.concat(
        F.lit('{"id":'), F.when(k % 5 == 0, F.lit('"x"')).otherwise(k.cast("string")), F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',"balance":'), F.when(k % 11 == 0, F.lit("null")).otherwise(number("c_acctbal")))), F.lit(',"segment":"'), F.col("c_mktsegment"),
        F.lit('","tags":["ok"'), F.when(k % 3 == 0, F.lit(',"a"')).when(k % 13 == 0, F.lit(",1")).otherwise(F.lit("")), F.lit('],"place":{'), F.when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit('"nation":'), number("c_nationkey"))), F.lit("}"), F.when(k % 19 == 0, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}"),
    )
    return spread(c, "c_custkey").select("c_custkey", F.array_join(contracts.schema_violations(F.parse_json(js), CUSTOMER_SCHEMA), ",").alias("violations"))


SCHEMA_SQL = "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN '$:required' END, CASE WHEN c_custkey % 19 = 0 THEN '$:additionalProperties' END, CASE WHEN c_custkey % 5 = 0 THEN '$.id:type' END, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN CASE WHEN c_acctbal < 0 THEN '$.balance:minimum' WHEN c_acctbal > 9000 THEN '$.balance:maximum' END END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN '$.segment:enum' END, CASE WHEN c_custkey % 3 = 0 THEN '$.tags[]:minLength' WHEN c_custkey % 13 = 0 THEN '$.tags[]:type' END, CASE WHEN c_custkey % 17 = 0 THEN '$.place:required' END) AS violations FROM customer"


def _retry(spark, d):
    """Waits after failed tries and refused calls, by the attempt's number."""
    a, k = v_attempt(spark, d), F.col("seq")
    wait = contracts.limit_wait(F.when(k % 2 == 0, F.lit("1m")), F.when(k % 3 == 0, F.lit("2s")), F.lit(None).cast("string"), F.when(k % 5 == 0, F.lit("Please Try Again in 200.5 s")).otherwise(F.lit("")), F.when(k % 7 == 0, 503).otherwise(429))
    return a.select("seq", contracts.connection_wait(k % 6).alias("wait_s"), wait.alias("limit_s"))


RETRY_SQL = "SELECT seq, least(pow(CAST(2 AS DOUBLE), seq % 6), CAST(10 AS DOUBLE)) AS wait_s, CAST(CASE WHEN seq % 5 = 0 THEN 120 WHEN seq % 2 = 0 THEN 60.75 WHEN seq % 7 = 0 THEN 10.75 WHEN seq % 3 = 0 THEN 2.75 ELSE 1.75 END AS DOUBLE) AS limit_s FROM v_attempt"


def _url_validity(spark, d):
    p = table(spark, d, "pages")
    host = F.try_parse_url("url", F.lit("HOST"))
    return p.select("page_id", F.coalesce(F.col("url").rlike("^https?://") & (F.length(host) > 0), F.lit(False)).alias("url_ok"), F.concat(F.lit("2024-02-"), (F.col("page_id") % 31 + 1).cast("string")).alias("day"), F.concat(F.lit("2024-02-"), F.lpad((F.col("page_id") % 31 + 1).cast("string"), 2, "0")).try_cast("date").isNotNull().alias("day_ok"))


def _context_projection(spark, d):
    e = table(spark, d, "events")
    m = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1), F.lit("empty"), F.lit(""), F.lit("user"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))), lambda k, v: ~values.is_blank(v))
    return e.select("event_id", F.size(m).cast("bigint").alias("n_fields"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("fields"))


def _context_features(spark, d):
    e = table(spark, d, "events")
    k = values.coerce_number(F.regexp_extract("props", "([0-9]+)", 1))
    return e.select("event_id", k.alias("context_service_k"), F.round(F.log1p(F.abs(k)), 6).alias("log1p_abs"), F.concat(F.lit("context.service.type."), values.compact_category(F.col("event_type"))).alias("cat"))


def _selected_ok(spark, d):
    c = _columns(spark, d)
    p = F.col("proposed")
    ok = (F.size(p) > 0) & (F.size(p) == F.size(F.array_distinct(p))) & (F.size(F.array_except(p, F.col("present"))) == 0)
    return c.select("c_custkey", ok.alias("ok"))


_WORDS = lambda words: f"len(list_filter(keys, lambda x: {' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in words)}))"
_ALIASED = lambda text, aliases: f"CASE {text} {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in aliases.items())} ELSE {text} END"
#: Modality and columns with their lower-cased names as a list and the modality without blanks and hyphens.
CHAIN_SQL = f"(SELECT *, string_split(lower(cols), ',') AS keys, translate(lower(trim(modality)), '- ', '__') AS m FROM {_from('chain')})"
_HOST_SQL = f"({_WORDS(groups.HOST_WORDS)} > 0 AND {_WORDS(groups.HOST_WORDS)} >= {_WORDS(groups.HOST_SENSOR_WORDS)})"
_SENSORS_SQL = f"({_WORDS(groups.TELEMETRY_WORDS)} > 0 AND {_WORDS(groups.NETWORK_WORDS)} = 0)"
_MODALITY = f"({_ALIASED('(CASE WHEN m = ' + repr('') + ' THEN ' + repr('network_flow') + ' ELSE m END)', groups.MODALITY_ALIASES)})"
MODALITY_SQL = f"CASE WHEN {_MODALITY} = 'telemetry' AND {_HOST_SQL} THEN 'host_log' WHEN {_MODALITY} = 'network_flow' AND {_SENSORS_SQL} THEN 'telemetry' ELSE {_MODALITY} END"
PROFILE_SQL = f"CASE WHEN modality = 'host_log' OR {_HOST_SQL} THEN 'host_metrics' WHEN modality = 'telemetry' OR {_SENSORS_SQL} THEN 'iot_telemetry' WHEN modality = 'alert' THEN 'alert_text' WHEN modality = 'pcap_ref' THEN 'pcap_ref' WHEN len(list_filter(keys, lambda x: {' OR '.join(f'starts_with(x, {chr(39)}{w}{chr(39)})' for w in groups.PACKET_PREFIXES)})) >= 3 THEN 'network_packet' WHEN {_WORDS(groups.ALERT_WORDS)} > 0 THEN 'alert_text' WHEN {_WORDS(groups.NETWORK_WORDS)} > 0 OR modality = 'network_flow' THEN 'network_flow' ELSE 'unknown' END"

CONV = {
    "normalize_token": (_part_tokens, f"SELECT p_partkey, {TOKEN(chr(39) + chr(39) + ' || p_type || ' + chr(39) + ' / ' + chr(39) + ' || p_brand')} AS token FROM part"),
    "normalize_token_40": (lambda s, d: table(s, d, "part").select("p_partkey", values.normalize_token_40(F.concat_ws("  ", "p_name", "p_type", "p_name")).alias("token")), f"SELECT p_partkey, {TOKEN40(chr(39) + chr(39) + ' || p_name || ' + chr(39) + '  ' + chr(39) + ' || p_type || ' + chr(39) + '  ' + chr(39) + ' || p_name')} AS token FROM part"),
    "coerce_number": (lambda s, d: _made(s, d, "number").select("k", "raw", values.coerce_number(F.col("raw")).alias("num")), f"SELECT k, raw, CASE WHEN abs(x) <= 1000000000000 THEN x END AS num FROM (SELECT k, raw, CASE WHEN lower({TRIM}) IN {_in(values.NUMBER_BLANKS)} THEN NULL WHEN regexp_matches({TRIM}, '{NUM_SQL}') THEN TRY_CAST(replace({TRIM}, '_', '') AS DOUBLE) END AS x FROM {_from('number')})"),
    "normalize_int": (lambda s, d: _made(s, d, "number").select("k", "raw", values.normalize_int(F.col("raw")).alias("n")), rf"SELECT k, raw, CASE WHEN regexp_matches(replace({TRIM}, ',', ''), '^[-+]?[0-9]+(\.0+)?$') THEN TRY_CAST(regexp_replace(replace({TRIM}, ',', ''), '\.0+$', '') AS BIGINT) END AS n FROM {_from('number')}"),
    "normalize_float": (lambda s, d: _made(s, d, "number").select("k", "raw", values.normalize_float(F.col("raw")).alias("x")), rf"SELECT k, raw, CASE WHEN regexp_matches(replace({TRIM}, ',', ''), '^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$') THEN TRY_CAST(replace({TRIM}, ',', '') AS DOUBLE) END AS x FROM {_from('number')}"),
    "blank_flags": (lambda s, d: _made(s, d, "number").select("k", "raw", values.is_blank(F.col("raw")).alias("blank"), values.is_empty_or_zero(F.col("raw")).alias("empty_or_zero")), f"SELECT k, raw, {TRIM} IN {_in(values.BLANKS)} AS blank, {TRIM} IN {_in(values.ZERO_BLANKS)} OR coalesce(CASE WHEN regexp_matches({TRIM}, '{NUM_SQL}') THEN TRY_CAST(replace({TRIM}, '_', '') AS DOUBLE) = 0 END, false) AS empty_or_zero FROM {_from('number')}"),
    "compact_category": (lambda s, d: table(s, d, "part").select("p_partkey", values.compact_category(F.when(F.col("p_partkey") % 5 == 0, F.lit("ip 10.0.0.1")).when(F.col("p_partkey") % 7 == 0, F.lit(" NaN ")).otherwise(F.col("p_type"))).alias("cat")), f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE {TOKEN40('p_type')} END AS cat FROM part"),
    "value_preview": (lambda s, d: table(s, d, "documents").select("doc_id", values.value_preview(F.col("text")).alias("preview")), "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM documents"),
    "duration_seconds": (lambda s, d: _made(s, d, "duration").select("k", "raw", F.round(values.duration_seconds(F.col("raw")), 6).alias("sec")), r"SELECT k, raw, round(CASE WHEN regexp_matches(raw, '^([0-9]+(\.[0-9]+)?(ms|s|m|h))+$') THEN coalesce(TRY_CAST(regexp_extract(raw, '([0-9]+(?:\.[0-9]+)?)ms', 1) AS DOUBLE) * 0.001, 0) + coalesce(TRY_CAST(regexp_extract(raw, '([0-9]+(?:\.[0-9]+)?)s', 1) AS DOUBLE), 0) + coalesce(TRY_CAST(regexp_extract(raw, '([0-9]+(?:\.[0-9]+)?)m(?:[^s]|$)', 1) AS DOUBLE) * 60, 0) + coalesce(TRY_CAST(regexp_extract(raw, '([0-9]+(?:\.[0-9]+)?)h', 1) AS DOUBLE) * 3600, 0) ELSE TRY_CAST(raw AS DOUBLE) END, 6) AS sec FROM " + _from("duration")),
    "feature_group": (lambda s, d: _made(s, d, "name").select("k", "name", groups.feature_group(F.col("name")).alias("grp")), f"SELECT k, name, {groups.rules_sql('name', groups.FEATURE_RULES)} AS grp FROM {_from('name')}"),
    "ingest_group": (lambda s, d: _made(s, d, "name").select("k", "name", groups.ingest_group(F.col("name")).alias("grp")), f"SELECT k, name, {groups.rules_sql('name', groups.INGEST_RULES)} AS grp FROM {_from('name')}"),
    "port_bucket": (_port, f"SELECT event_id, port, {PORT_SQL} AS bucket FROM (SELECT event_id, (event_id * 37) % 65536 AS port FROM events)"),
    "numeric_features": (lambda s, d: table(s, d, "part").select("p_partkey", F.lit(1).cast("bigint").alias("present"), F.round(F.log1p(F.abs("p_retailprice")), 6).alias("log1p_abs")), "SELECT p_partkey, CAST(1 AS BIGINT) AS present, round(ln(1 + abs(p_retailprice)), 6) AS log1p_abs FROM part"),
    "group_numeric_stats": (_group_stats, sql(MEASURE_SQL + f" SELECT l_orderkey, grp, count(*) AS n, round(avg(ln(1 + abs(num))), 6) AS abs_log_mean, round(min(num), 6) AS lo, round(max(num), 6) AS hi, round(avg(num), 6) AS mean, round(stddev_pop(num), 4) AS std, round(max(num) - min(num), 6) AS span, round(count(*) FILTER (num = 0) / count(*), 6) AS zero_ratio, round(count(*) FILTER (num > 0) / count(*), 6) AS positive_ratio FROM (SELECT *, {groups.rules_sql('key', groups.FEATURE_RULES)} AS grp FROM u) GROUP BY 1, 2")),
    "context_features": (_context_features, f"SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS context_service_k, round(ln(1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)), 6) AS log1p_abs, 'context.service.type.' || {TOKEN40('event_type')} AS cat FROM events"),
    "keyword_hints": (lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(groups.keyword_hints(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit("SYN flood scan")), F.when(F.col("p_partkey") % 4 == 0, F.lit("password leak")))), ",").alias("hints")), f"SELECT p_partkey, coalesce({HINT_SQL}, '') AS hints FROM (SELECT p_partkey, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' SYN flood scan' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ' password leak' ELSE '' END) AS t FROM part)"),
    "event_features_long": (_features_long, FEATURES_SQL),
    "feature_vocabulary": (_vocabulary, f"SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT key FROM ({FEATURES_SQL}))"),
    "feature_allowlist": (lambda s, d: _made(s, d, "feature").where(leak.is_allowed_feature(F.col("name"))).select("k", "name"), "SELECT k, name FROM " + _from("feature") + " WHERE NOT (" + " OR ".join(f"starts_with(name, '{p}')" for p in leak.FORBIDDEN_PREFIXES) + f" OR name IN {_in(leak.FORBIDDEN_KEYS)})"),
    "feature_leaks": (lambda s, d: _features_long(s, d).select("key").distinct().where(leak.is_target_field(F.col("key"))).agg(F.count(F.lit(1)).alias("n_leaks")), f"SELECT count(*) AS n_leaks FROM (SELECT DISTINCT key FROM ({FEATURES_SQL})) WHERE {TARGET_SQL('key')}"),
    "schema_profile": (lambda s, d: _made(s, d, "chain").select("k", "modality", "cols", groups.schema_profile(F.lit(""), F.col("modality"), F.split("cols", ",")).alias("profile")), "SELECT k, modality, cols, CASE WHEN modality = 'host_log' THEN 'host_metrics' WHEN modality = 'telemetry' THEN 'iot_telemetry' WHEN modality = 'alert' THEN 'alert_text' WHEN regexp_matches(cols, '(^|,)(tcp|udp|icmp|mqtt|http|arp)\\.') THEN 'network_packet' WHEN regexp_matches(cols, '(^|,)(src_port|dst_port)(,|$)|state|proto') THEN 'network_flow' ELSE modality END AS profile FROM " + _from("chain")),
    "parse_timestamp": (lambda s, d: _made(s, d, "time").select("k", "raw", F.unix_micros(values.parse_timestamp(F.col("raw"))).alias("us")), f"SELECT o_orderkey AS k, {MADE['time'][1]['raw']} AS raw, CAST({_TIME_US} AS BIGINT) AS us FROM orders"),
    "url_validity": (_url_validity, "SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS url_ok, '2024-02-' || (page_id % 31 + 1) AS day, TRY_CAST('2024-02-' || lpad(CAST(page_id % 31 + 1 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS day_ok FROM pages"),
    "target_field_predicate": (lambda s, d: _made(s, d, "target").select("k", "name", leak.is_target_field(F.col("name")).alias("runtime"), leak.is_target_field(F.col("name"), offline=True).alias("offline")), f"SELECT k, name, {TARGET_SQL('name')} AS runtime, {TARGET_SQL('name', leak.OFFLINE_EXTRA)} AS offline FROM {_from('target')}"),
    "target_value_predicate": (lambda s, d: _made(s, d, "value").select("k", "v", leak.is_target_value(F.col("v")).alias("target")), f"SELECT k, v, {TOKEN('trim(v)')} IN {_in(leak.TARGET_VALUES)} AS target FROM {_from('value')}"),
    "target_text_predicate": (lambda s, d: table(s, d, "documents").select("doc_id", leak.has_target_text(F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" label=")).otherwise(F.lit(" xlabel=")), F.col("lang"))).alias("hit")), rf"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 2 = 0 THEN ' label=' ELSE ' xlabel=' END || lang, '(?i)(^|[^A-Za-z0-9_.-])[\x22\x27]?{leak.TARGET_KEY}[\x22\x27]?\s*[:=]\s*') AS hit FROM documents"),
    "target_path_allowlist": (lambda s, d: _made(s, d, "path").select("k", "path", leak.is_allowed_path(F.col("path")).alias("allowed")), f"SELECT k, path, lower(path) IN {_in(leak.ALLOWED_PATHS)} AS allowed FROM {_from('path')}"),
    "canonical_leak_violations": (_violations, sql(ROWMAP_SQL + " SELECT c_custkey, concat_ws(',', CASE WHEN label <> '' THEN 'label' END, CASE WHEN segment = 'ddos' THEN 'segment' END, CASE WHEN threat_score IS NOT NULL THEN 'threat_score' END) AS violations FROM rm")),
    "selected_columns_ok": (_selected_ok, "SELECT c_custkey, c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS ok FROM customer"),
    "validated_columns": (lambda s, d: _columns(s, d).select("c_custkey", F.array_join(F.slice(F.array_intersect("proposed", "present"), 1, 40), ",").alias("cols")), "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'c_name' || CASE c_custkey % 3 WHEN 1 THEN ',x1' WHEN 2 THEN ',c_nationkey' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',c_phone' END || CASE WHEN c_custkey % 2 = 0 THEN ',c_acctbal' ELSE ',c_custkey' END END AS cols FROM customer"),
    "prune_empty": (_prune, sql(ROWMAP_SQL + " SELECT c_custkey, concat_ws(',', CASE WHEN label <> '' THEN 'label' END, 'name', 'nation', 'segment', CASE WHEN threat_score IS NOT NULL THEN 'threat_score' END) AS kept_keys FROM rm")),
    "event_context_projection": (_context_projection, "SELECT event_id, CAST(2 + CAST(user_id % 2 = 0 AS INT) AS BIGINT) AS n_fields, 'k,type' || CASE WHEN user_id % 2 = 0 THEN ',user' ELSE '' END AS fields FROM events"),
    "column_ranking": (_ranking, f"SELECT c_custkey, name, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, pos) AS rn FROM (SELECT c_custkey, pos, name, CAST({PRIORITY_SQL} + CAST(present AS BIGINT) AS BIGINT) AS score FROM (SELECT c_custkey, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['src_ip', 'c_name', 'port_time', 'zzz', 'proto']) AS name, unnest([c_custkey % 2 = 0, true, c_acctbal > 0, false, c_nationkey > 10]) AS present FROM customer)) WHERE score > 0) WHERE rn <= 3"),
    "sanitize_row": (_sanitized, sql(ROWMAP_SQL + " SELECT c_custkey, concat_ws(',', 'name', 'nation', CASE WHEN segment <> 'ddos' THEN 'segment' END) AS kept_keys FROM rm")),
    "schema_violations": (_schema_violations, SCHEMA_SQL),
    "complete_event": (_complete, COMPLETE_SQL),
    "infer_groups": (_infer_groups, sql(ROWMAP_SQL + f" SELECT c_custkey, grp, string_agg(key, ',' ORDER BY key) AS columns FROM (SELECT c_custkey, key, {groups.rules_sql(chr(39) + 'src_' + chr(39) + ' || key', groups.INGEST_RULES)} AS grp FROM (SELECT c_custkey, unnest(['name', 'label', 'segment', 'nation', 'threat_score']) AS key, unnest([name, label, segment, nation, threat_score]) AS value FROM rm) WHERE value IS NOT NULL AND value <> '') GROUP BY 1, 2")),
    "normalize_dataset": (lambda s, d: _made(s, d, "dataset").select("k", "raw", taxonomy.normalize_dataset(F.col("raw")).alias("dataset")), f"SELECT k, raw, coalesce(a.name, {TOKEN('raw')}) AS dataset FROM {_from('dataset')} LEFT JOIN (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {chr(39)}{y}{chr(39)})' for x, y in taxonomy.DATASETS.items())}) AS a(alias, name) ON a.alias = {TOKEN('raw')}"),
    "normalize_modality": (lambda s, d: _made(s, d, "chain").select("k", "modality", "cols", groups.normalize_modality(F.col("modality"), F.split("cols", ",")).alias("found")), f"SELECT k, modality, cols, {MODALITY_SQL} AS found FROM {CHAIN_SQL}"),
    "infer_profile": (lambda s, d: _made(s, d, "chain").select("k", "modality", "cols", groups.infer_profile(F.lit(""), F.col("modality"), F.split("cols", ",")).alias("found")), f"SELECT k, modality, cols, {PROFILE_SQL} AS found FROM {CHAIN_SQL}"),
    "input_guard_code": (_guard, sql(GUARD_SQL)),
    "standardization_contract_code": (_contract, sql(CONTRACT_SQL)),
    "retry_backoff": (_retry, sql(RETRY_SQL)),
    "derive_origin": (lambda s, d: v_manifest(s, d).groupBy(taxonomy.derive_origin(F.concat(F.lit("/data/"), F.col("origin"), F.lit("/"), F.col("detail")), (("asia", "ton_network"), ("africa", "ton_linux"), ("europe", "ton_windows"))).alias("origin")).agg(F.count(F.lit(1)).alias("n")), sql("SELECT CASE WHEN origin = 'ASIA' THEN 'ton_network' WHEN origin = 'AFRICA' THEN 'ton_linux' WHEN origin = 'EUROPE' THEN 'ton_windows' ELSE 'unknown' END AS origin, count(*) AS n FROM v_manifest GROUP BY 1")),
    "canonical_json": (lambda s, d: table(s, d, "customer").select("c_custkey", hashing.canonical_json(F.create_map(F.lit("b"), F.lower("c_mktsegment"), F.lit("a"), F.col("c_nationkey").cast("string"))).alias("js")), """SELECT c_custkey, '{"a":"' || c_nationkey || '","b":"' || lower(c_mktsegment) || '"}' AS js FROM customer"""),
    "content_hash": (lambda s, d: table(s, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("h")), "SELECT doc_id, sha256(text) AS h FROM documents"),
    "row_digest": (lambda s, d: table(s, d, "customer").select("c_custkey", hashing.row_digest(F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("nat"), F.col("c_nationkey").cast("string"), F.lit("nam"), F.col("c_name"))).alias("digest")), "SELECT c_custkey, left(sha256('nam=' || c_name || '|nat=' || c_nationkey || '|seg=' || c_mktsegment), 32) AS digest FROM customer"),
    "feature_fingerprint": (lambda s, d: table(s, d, "orders").select("o_orderkey", hashing.fingerprint({"price": F.round(F.col("o_totalprice") * 100).cast("bigint"), "prio": F.col("o_orderpriority"), "cust": F.col("o_custkey")}).alias("fp")), "SELECT o_orderkey, sha256('cust=' || o_custkey || '|price=' || CAST(round(o_totalprice * 100) AS BIGINT) || '|prio=' || o_orderpriority) AS fp FROM orders"),
    "scrub_text_simple": (lambda s, d: table(s, d, "documents").select("doc_id", leak.scrub_simple(F.concat(F.lit("label="), F.col("lang"), F.lit(" src ok class: x1, end "), F.col("source"))).alias("clean")), "SELECT doc_id, 'src ok , end ' || source AS clean FROM documents"),
    "bind_identity": (lambda s, d: v_case(s, d).select("case_id", F.concat_ws("::", F.lit("llm"), F.col("profile"), F.when(F.col("case_id") % 2 == 0, F.lit("f.csv")).otherwise(F.lit("inline")), F.col("case_id")).alias("event_id"), F.when(F.col("case_id") % 2 == 0, F.lit("f.csv")).alias("source_file")), sql("SELECT case_id, 'llm::' || profile || '::' || CASE WHEN case_id % 2 = 0 THEN 'f.csv' ELSE 'inline' END || '::' || case_id AS event_id, CASE WHEN case_id % 2 = 0 THEN 'f.csv' END AS source_file FROM v_case")),
}


def _taxonomy_query(rules):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _made(spark, d, "label")
        return rows.withColumn("r", taxonomy.resolve(*(F.col(c) for c in ("dataset", "native", "sub", "proto", "service")), rules=rules)).select("k", "dataset", "native", "sub", "proto", "service", "r.status", "r.attack_type", "r.reason")

    return run


def _taxonomy_sql(rules) -> str:
    names = ", ".join(f"('{n.lower()}', '{n}')" for n in taxonomy.TYPES_14)
    lit = lambda x: "NULL" if x is None else f"'{x}'"
    listed = ", ".join(f"({k}, {lit(a)}, {lit(b)}, {lit(c)}, {lit(s)}, {lit(t)}, {lit(r)})" for k, (a, b, c, s, t, r) in enumerate(rules))
    data = f"coalesce((SELECT n FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in taxonomy.DATASETS.items())}) AS a(k, n) WHERE k = {TOKEN('dataset')}), {TOKEN('dataset')})"
    kind = "CASE WHEN sk IN ('http', 'http_alt', 'http_proxy') THEN 'service_http' WHEN starts_with(pk, 'icmp') THEN 'protocol_icmp' WHEN pk IN ('udp', 'tcp') THEN 'protocol_' || pk END"
    return f"""WITH t AS (SELECT *, {data} AS dk, {TOKEN('native')} AS ck, {TOKEN('sub')} AS bk, {TOKEN('proto')} AS pk, {TOKEN('service')} AS sk FROM (SELECT DISTINCT dataset, native, sub, proto, service FROM {_from('label')}) AS t),
n(key, own) AS (VALUES {names}), r(k, rd, rc, rs, status, kind, reason) AS (VALUES {listed}),
j AS (SELECT t.*, n.own, r.*, {kind} AS raw FROM t LEFT JOIN n ON t.ck = n.key LEFT JOIN r ON r.rd = t.dk AND (r.rc = '*' OR (r.rc = '=' AND n.own IS NOT NULL) OR r.rc = t.ck) AND (r.rs = '*' OR r.rs = t.bk) AND t.ck NOT IN ('normal', 'benign', 'benigno')),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset, native, sub, proto, service ORDER BY k) AS rn FROM j)
SELECT t.k, e.* FROM {_from('label')} JOIN (SELECT dataset, native, sub, proto, service, CASE WHEN ck IN ('normal', 'benign', 'benigno') THEN 'benign' WHEN k IS NULL THEN 'out_of_taxonomy' WHEN kind = '?' AND raw IS NULL THEN 'ambiguous' ELSE status END AS status,
CASE WHEN kind = '=' THEN own WHEN kind = '?' THEN CASE raw WHEN 'service_http' THEN 'DDoS_HTTP' WHEN 'protocol_icmp' THEN 'DDoS_ICMP' WHEN 'protocol_udp' THEN 'DDoS_UDP' WHEN 'protocol_tcp' THEN 'DDoS_TCP' END ELSE kind END AS attack_type,
CASE WHEN ck IN ('normal', 'benign', 'benigno') THEN 'handled_by_binary_detector' WHEN k IS NULL THEN 'dataset_not_supported' WHEN kind = '?' THEN reason || coalesce('_raw_' || raw, '_missing_raw_protocol') ELSE reason END AS reason FROM f WHERE rn = 1) e ON t.dataset = e.dataset AND t.native = e.native AND t.sub = e.sub AND t.proto = e.proto AND t.service = e.service"""


CONV["taxonomy_resolve"] = (_taxonomy_query(taxonomy.RULES_16), _taxonomy_sql(taxonomy.RULES_16))
CONV["taxonomy_resolve_14"] = (_taxonomy_query(taxonomy.RULES_14), _taxonomy_sql(taxonomy.RULES_14))

QUERIES = {name: q for name, (q, _) in CONV.items()}
ORACLES = {name: o for name, (_, o) in CONV.items()}
