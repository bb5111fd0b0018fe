"""Contracts of stage inputs and outputs as columns: ordered rules, a JSON-schema subset, completion of events and waits.

A contract's rules are ordered pairs (code, what must hold); the first that
doesn't hold gives its code. Unknown (null) counts as not holding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import groups, values

#: Where records may come from, the live provider, marks that notes must and must not hold.
SPLITS = ("train", "val", "test", "stream")
PROVIDER = "mistral"
PARSED, LIVE, CACHED, PASSED = "parsed_by_llm", "source:mistral_live", "source:mistral_cache", "source:prestandardized"
FORBIDDEN_NOTES = ("fallback", "adapter", "llm_failed", "llm_error")
CLAIMED = "security_boundary:sanitized"


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that doesn't hold; null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in rules))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _is_false(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def standardization_rules(r: Column) -> list[tuple[str, Column]]:
    """What a successful standardization must fulfil; ``r`` is a struct of the answer, the input and the event they give.

    Fields: ok, abstain, review, failure, fallback, cache_key, from_cache, given
    (the input was standardized already), source, provider, model, selected,
    row_keys, notes, content_hash, pipeline_hash, input_hash, n_unknown, n_leaks,
    event_id, dataset, source_file, row_id, split, origin_dataset, origin_file,
    origin_row, event_split, confidence, event_confidence.
    """
    given, cached, notes, selected = r["given"], F.coalesce(r["from_cache"], F.lit(False)), r["notes"], r["selected"]
    marked = lambda word: F.coalesce(F.array_contains(notes, word), F.lit(False))
    place = F.coalesce(r["source_file"], F.lit("inline"))
    tabular = ~given & (F.coalesce(F.size(r["row_keys"]), F.lit(0)) > 0)
    return [
        ("not_ok", r["ok"]),
        ("abstain_declared", _is_false(r["abstain"])),
        ("review_declared", _is_false(r["review"])),
        ("failure_declared", _blank(r["failure"])),
        ("fallback_declared", _is_false(r["fallback"])),
        ("cache_key_declared", _blank(r["cache_key"])),
        ("from_cache_invalid", r["from_cache"].isNotNull()),
        ("source_invalid", r["source"] == F.when(given, "prestandardized").otherwise("llm")),
        ("given_from_cache", ~(given & cached)),
        ("given_with_provider", ~given | r["provider"].isNull()),
        ("provider_mismatch", given | (r["provider"] == PROVIDER)),
        ("model_missing", ~_blank(r["model"])),
        ("columns_invalid", selected.isNotNull() & ~F.exists(selected, _blank)),
        ("given_with_columns", ~given | (F.size(selected) == 0)),
        ("columns_missing", ~tabular | (F.size(selected) > 0)),
        ("columns_repeated", ~tabular | (F.size(F.array_distinct(selected)) == F.size(selected))),
        ("columns_unknown", ~tabular | (F.size(F.array_except(selected, r["row_keys"])) == 0)),
        ("notes_invalid", notes.isNotNull() & ~F.exists(notes, lambda n: n.isNull())),
        ("notes_incomplete", F.when(given, marked(PASSED)).otherwise(marked(PARSED) & F.when(cached, marked(CACHED)).otherwise(marked(LIVE)))),
        ("notes_forbidden", ~F.exists(notes, lambda n: reduce(lambda a, b: a | b, (F.lower(F.trim(n)).contains(w) for w in FORBIDDEN_NOTES)))),
        ("notes_claim", ~marked(CLAIMED)),
        ("live_as_cache", cached | ~marked(CACHED)),
        ("content_hash_invalid", (_is_false(cached) & r["content_hash"].isNull()) | _is_sha256(r["content_hash"])),
        ("pipeline_hash_invalid", (_is_false(cached) & r["pipeline_hash"].isNull()) | _is_sha256(r["pipeline_hash"])),
        ("content_hash_mismatch", given | r["content_hash"].isNull() | (r["content_hash"] == r["input_hash"])),
        ("event_fields_unknown", r["n_unknown"] == 0),
        ("event_leaks", r["n_leaks"] == 0),
        ("event_id_mismatch", given | (r["event_id"] == F.concat_ws("::", F.lit("llm"), r["dataset"], place, r["row_id"]))),
        ("origin_mismatch", given | ((r["origin_dataset"] == r["dataset"]) & (r["origin_file"] == place) & r["origin_row"].eqNullSafe(r["row_id"]))),
        ("provenance_mismatch", given | (r["event_split"] == r["split"])),
        ("confidence_missing", r["confidence"].isNotNull() & ~F.isnan(r["confidence"])),
        ("confidence_mismatch", F.abs(r["confidence"] - r["event_confidence"]) <= 1e-9),
    ]


def input_guard(split: Column, dataset: Column, row: Column, text: Column, event: Column, event_valid: Column) -> Column:
    """Failure code of a standardize request, null if it may go on; ``row`` is a map, ``event`` a text, either may be null."""
    has_row, has_text = F.coalesce(F.size(row), F.lit(0)) > 0, ~_blank(text)
    return first_failure(
        [
            ("standardization_input_invalid", split.isin(*SPLITS) & ~_blank(dataset)),
            ("standardization_input_ambiguous", ~(row.isNotNull() & has_text) & ~(event.isNotNull() & (has_row | has_text))),
            ("canonical_event_invalid", event.isNull() | event_valid),
            ("standardization_input_missing", event.isNotNull() | has_row | has_text),
        ]
    )


#: How a declared type is told from a variant's own description.
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "null": "^VOID$", "object": "^OBJECT<", "array": "^ARRAY<"}


def schema_violations(value: Column, schema: dict, path: str = "$") -> Column:
    """Array of ``path:rule`` that a variant breaks, in the order of the schema; a value of a wrong type is looked at no further.

    Knows type (one or several), enum, minLength, minimum, maximum, required,
    properties, additionalProperties (false) and items. The schema is compiled
    to one expression; places of a list all stand for ``[]``.
    """
    kind = F.schema_of_variant(value)
    declared = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))
    right = reduce(lambda a, b: a | b, (kind.rlike(_TYPES[t]) for t in declared)) if declared else F.lit(True)
    rules: list[tuple[str, Column]] = []
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    numeric, is_text, is_object = kind.rlike(_TYPES["number"]), kind.rlike(_TYPES["string"]), kind.rlike(_TYPES["object"])
    if "enum" in schema:
        rules.append(("enum", F.coalesce(text.isin(*(str(x) for x in schema["enum"])), F.lit(None in schema["enum"]))))
    if "minLength" in schema:
        rules.append(("minLength", ~is_text | (F.length(F.trim(text)) >= schema["minLength"])))
    if "minimum" in schema:
        rules.append(("minimum", ~numeric | (number >= schema["minimum"])))
    if "maximum" in schema:
        rules.append(("maximum", ~numeric | (number <= schema["maximum"])))
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    if schema.get("required"):
        rules.append(("required", ~is_object | (F.size(F.array_except(F.array(*(F.lit(k) for k in schema["required"])), keys)) == 0)))
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        known = F.array(*(F.lit(k) for k in properties)) if properties else F.array().cast("array<string>")
        rules.append(("additionalProperties", ~is_object | (F.size(F.array_except(keys, known)) == 0)))
    own = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(f"{path}:{rule}")) for rule, holds in rules))) if rules else F.array().cast("array<string>")
    parts = [own]
    none = F.array().cast("array<string>")
    for key, child in properties.items():
        inner = F.try_variant_get(value, f"$.{key}", "variant")
        parts.append(F.when(is_object & F.array_contains(keys, key), schema_violations(inner, child, f"{path}.{key}")).otherwise(none))
    if isinstance(schema.get("items"), dict):
        listed = F.try_variant_get(value, "$", "array<variant>")
        each = F.array_distinct(F.flatten(F.transform(listed, lambda v: schema_violations(v, schema["items"], f"{path}[]"))))
        parts.append(F.when(kind.rlike(_TYPES["array"]), each).otherwise(none))
    return F.when(right, F.concat(*parts)).otherwise(F.array(F.lit(f"{path}:type")))


#: The most values that an event keeps beside the fields that it knows.
MOST_EXTRA = 120


def completed(payload: Column, row: Column, dataset: Column, source_file: Column, row_id: Column, split: Column, fields: tuple[str, ...]) -> dict[str, Column]:
    """Parts of an event whose ``payload`` (map of texts) came from a model and whose ``row`` (map of texts) is the input.

    The identity comes from the input only. Fields that were called missing are
    kept if they are, and ``ts`` is added if it is. Values of the row that the
    payload doesn't hold are kept, host metrics apart, in the order of their names.
    """
    confidence = F.coalesce(payload["mapping_confidence"].try_cast("double"), F.lit(0.5))
    lacking = lambda name: values.is_blank(F.try_element_at(payload, F.lit(name) if isinstance(name, str) else name))
    named = F.filter(F.split(F.coalesce(payload["missing_fields"], F.lit("")), ","), lambda f: f.isin(*fields) & lacking(f))
    extra = F.map_from_entries(F.slice(F.array_sort(F.map_entries(F.map_filter(row, lambda k, v: ~values.is_blank(v) & ~F.map_contains_key(payload, k)))), 1, MOST_EXTRA))
    is_host = lambda k: groups.ingest_group(k) == "host_metrics"
    return {
        "event_id": F.concat_ws("::", F.lit("llm"), F.coalesce(dataset, F.lit("generic")), F.coalesce(source_file, F.lit("inline")), row_id),
        "mapping_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)),
        "split": F.when(split.isin(*SPLITS), split).otherwise("stream"),
        "missing_fields": F.when(lacking("ts"), F.array_union(named, F.array(F.lit("ts")))).otherwise(F.array_distinct(named)),
        "telemetry": F.map_filter(extra, lambda k, v: ~is_host(k)),
        "host": F.map_filter(extra, lambda k, v: is_host(k)),
    }


#: Bounds of waits in seconds.
MOST_BACKOFF, LEAST_WAIT, MOST_WAIT, MARGIN, SERVER_WAIT = 10.0, 1.0, 120.0, 0.75, 10.0


def connection_wait(attempt: Column, base: float = 1.0) -> Column:
    """Seconds before another try at a connection: doubled each time, bounded."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(0))), F.lit(MOST_BACKOFF))


def limit_wait(retry_after: Column, reset_tokens: Column, reset_requests: Column, message: Column, status: Column) -> Column:
    """Seconds after a refused call: the longest that the answer names, with a margin, bounded."""
    named = F.regexp_extract(message, r"(?i)try again in\s+([0-9.]+)\s*s", 1).try_cast("double")
    server = F.when(status.isin(500, 502, 503, 504), SERVER_WAIT)
    longest = F.coalesce(F.greatest(*(values.duration_seconds(c) for c in (retry_after, reset_tokens, reset_requests)), named, server), F.lit(1.0))
    return F.least(F.greatest(longest + MARGIN, F.lit(LEAST_WAIT)), F.lit(MOST_WAIT))


# What the stages and the tools hand on

#: Fields of each stage's output that its contract looks at, and where it may go next.
STAGE_SCHEMAS = {
    "ingest": "event_id string, normalized boolean, mapping_confidence double, schema_version string, modality string",
    "detection": "event_id string, is_malicious boolean, probability double, evidence array<string>, model_name string, next_route string",
    "classification": "event_id string, confidence double, decision_threshold double, model_task string, next_route string",
    "explanation": "event_id string, risk_summary string, mitigations array<string>, confidence double, catalog_scope string, next_route string",
    "judge": "event_id string, approved boolean, final_confidence double, action string",
}
ROUTES = {"detection": ("classify", "judge", "end"), "classification": ("explain", "judge", "end"), "explanation": ("judge", "end")}
ACTIONS = ("approve", "rework", "human_interrupt", "reject")


def stage_rules(stage: str, r: Column) -> list[tuple[str, Column]]:
    """What the output of a stage must fulfil; ``r`` is a struct of its schema. A threshold and a task may be left to their defaults."""
    share = lambda name: (f"{name}_invalid", r[name].between(0, 1) & ~F.isnan(r[name]))
    given = lambda name: (f"{name}_missing", r[name].isNotNull())
    route = ("next_route_invalid", r["next_route"].isin(*ROUTES.get(stage, ("",)))) if stage in ROUTES else None
    rules = {
        "ingest": lambda: [given("event_id"), given("normalized"), share("mapping_confidence"), given("schema_version"), given("modality")],
        "detection": lambda: [given("event_id"), given("is_malicious"), share("probability"), given("evidence"), given("model_name")],
        "classification": lambda: [given("event_id"), share("confidence"), ("decision_threshold_invalid", F.coalesce(r["decision_threshold"], F.lit(0.65)).between(0, 1)), ("model_task_invalid", F.coalesce(r["model_task"], F.lit("attack_type")) == "attack_type")],
        "explanation": lambda: [given("event_id"), given("risk_summary"), given("mitigations"), share("confidence"), ("catalog_scope_invalid", F.coalesce(r["catalog_scope"], F.lit("attack_type")) == "attack_type")],
        "judge": lambda: [given("event_id"), given("approved"), share("final_confidence"), ("action_invalid", r["action"].isin(*ACTIONS))],
    }[stage]()
    return [*rules, *([route] if route else [])]


def stage_failure(stage: str, output: Column) -> Column:
    """Code of the first rule that a stage's output, a JSON text, breaks; ``not_an_object`` for what is none; null if it is good."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(output)).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.lit("not_an_object")).otherwise(first_failure(stage_rules(stage, F.from_json(output, STAGE_SCHEMAS[stage]))))


def decoded_reply(text: Column) -> Column:
    """(ok, error, payload) of a tool's reply, fail-closed: what is no JSON, no object or has no boolean ``ok`` counts as ok = false."""
    v = F.try_parse_json(text)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    has_ok = F.schema_of_variant(F.try_variant_get(v, "$.ok", "variant")) == "BOOLEAN"
    error = F.when(v.isNull(), "invalid_json").when(~is_object, "not_an_object").when(~F.coalesce(has_ok, F.lit(False)), "ok_missing")
    ok = F.when(error.isNull(), F.try_variant_get(v, "$.ok", "boolean")).otherwise(False)
    return F.struct(ok.alias("ok"), error.alias("error"), F.when(F.coalesce(is_object, F.lit(False)), v).alias("payload"))
