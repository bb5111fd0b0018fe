"""Case stages over a batch of flat cases: routing, judging, auditing, projection, traces and the case store.

A flat case has one scalar column for every fact that a rule reads; ``flat_facts``
makes them from the stages' nested outputs. Rules are ordered tables of (name, condition)
whose conditions are plain SQL expressions over those columns, so a stage is one
projection that Catalyst compiles as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import schemas
from casewright.functions.taxonomy import TYPES_16, VERSION_16

#: Thresholds of review and the gray zone.
REVIEW_CLASS, REVIEW_MAPPING, GRAY_LOW, GRAY_HIGH = 0.65, 0.5, 0.4, 0.6
CATALOG_VERSION = "4.0"
#: The stages in their order.
STAGES = ("orchestrator", "final_standardizer", "final_detector", "final_classifier", "final_mitigator", "final_judge")

_TYPES = ", ".join(f"'{t}'" for t in TYPES_16)
_D = lambda x: f"CAST({x} AS DOUBLE)"
_MAL = "(NOT det_abstain AND coalesce(is_malicious, false))"
_CONF = "CASE WHEN cls_confidence BETWEEN 0 AND 1 THEN cls_confidence ELSE 0 END"  # an invalid confidence counts as none

#: Issue codes of the judge, in order, each with its condition.
JUDGE_ISSUES = (
    ("classification_threshold_missing", "cls_present AND cls_threshold IS NULL"),
    ("classification_threshold_invalid", "cls_present AND (cls_threshold < 0 OR cls_threshold > 1)"),
    ("classification_threshold_mismatch", f"cls_present AND cls_threshold BETWEEN 0 AND 1 AND abs(cls_threshold - {_D(REVIEW_CLASS)}) > {_D('1e-9')}"),
    ("classification_model_task_invalid", "cls_present AND cls_task <> 'attack_type'"),
    ("classification_attack_type_missing", "cls_present AND coalesce(cls_type, '') = ''"),
    ("classification_taxonomy_version_invalid", f"cls_present AND coalesce(cls_version, '') <> '{VERSION_16}'"),
    ("classification_attack_type_outside_taxonomy", f"cls_present AND coalesce(cls_type, '') <> '' AND cls_type NOT IN ({_TYPES})"),
    ("classification_confidence_invalid", "cls_present AND (cls_confidence IS NULL OR cls_confidence < 0 OR cls_confidence > 1)"),
    ("classification_top_scores_invalid", f"cls_present AND NOT (top_n = 3 AND NOT top_invalid AND coalesce(top_label = cls_type, false) AND coalesce(abs(top_score - {_CONF}) <= {_D('1e-6')}, false))"),
    ("pipeline_errors_present", "n_errors > 0"),
    ("standardizer_abstained", "ingest_abstain"),
    ("mapping_confidence_below_review_threshold", f"NOT ingest_abstain AND coalesce(mapping_confidence, 0) < {_D(REVIEW_MAPPING)}"),
    ("detection_missing", "NOT ingest_abstain AND NOT det_present"),
    ("detection_verdict_missing", "NOT ingest_abstain AND det_present AND is_malicious IS NULL"),
    ("detection_label_probability_mismatch", f"NOT ingest_abstain AND det_present AND is_malicious IS NOT NULL AND is_malicious <> (probability >= {_D(0.5)})"),
    ("detector_abstained", "det_abstain"),
    ("classification_confidence_below_review_threshold", f"{_MAL} AND cls_present AND {_CONF} < {_D(REVIEW_CLASS)}"),
    ("malicious_without_classification", f"{_MAL} AND NOT cls_present"),
    ("malicious_without_mitigation", f"{_MAL} AND NOT exp_present"),
    ("benign_with_classification", "NOT coalesce(is_malicious, true) AND cls_present"),
    ("mitigation_attack_type_mismatch", f"{_MAL} AND cls_task = 'attack_type' AND coalesce(cls_type, '') <> '' AND exp_present AND coalesce(exp_type, '') <> cls_type"),
    ("mitigation_taxonomy_version_mismatch", f"{_MAL} AND cls_task = 'attack_type' AND coalesce(cls_type, '') <> '' AND exp_present AND coalesce(exp_version, '') <> coalesce(cls_version, '')"),
    ("mitigation_catalog_taxonomy_version_mismatch", f"{_MAL} AND cls_task = 'attack_type' AND coalesce(cls_type, '') <> '' AND exp_present AND (coalesce(exp_catalog_taxonomy, '') <> '{VERSION_16}' OR NOT exp_compatible)"),
    ("mitigation_catalog_scope_invalid", f"{_MAL} AND cls_task = 'attack_type' AND coalesce(cls_type, '') <> '' AND exp_present AND coalesce(exp_scope, '') <> 'attack_type'"),
    ("mitigation_catalog_version_mismatch", f"{_MAL} AND cls_task = 'attack_type' AND coalesce(cls_type, '') <> '' AND exp_present AND coalesce(exp_catalog_version, '') <> '{CATALOG_VERSION}'"),
    ("mitigation_catalog_content", f"{_MAL} AND cls_task = 'attack_type' AND coalesce(cls_type, '') <> '' AND exp_present AND n_catalog_issues > 0"),
    ("mitigator_requested_human_review", "exp_present AND exp_review"),
)
FINAL_LABEL = "CASE WHEN ingest_abstain OR det_abstain THEN NULL WHEN is_malicious AND coalesce(cls_type, '') <> '' THEN cls_type WHEN is_malicious THEN 'malicious' WHEN NOT is_malicious THEN 'benign' END"
FINAL_CONFIDENCE = "CASE WHEN ingest_abstain OR det_abstain THEN 0 WHEN is_malicious AND coalesce(cls_type, '') <> '' THEN CASE WHEN cls_confidence BETWEEN 0 AND 1 THEN cls_confidence ELSE 0 END WHEN is_malicious THEN probability WHEN NOT is_malicious THEN 1 - probability ELSE 0 END"

_FLAGGED = "flagged"
_TYPED = "coalesce(is_malicious, false) AND cls_task = 'attack_type' AND cls_type IS NOT NULL"
_IN_TAXONOMY = f"coalesce(cls_version, '') = '{VERSION_16}' AND cls_type IN ({_TYPES})"
#: The auditor's checks (name, hard, where it applies, what must hold).
AUDIT_CHECKS = (
    ("consistencia_sin_estado_error", True, "true", "status <> 'error'"),
    ("consistencia_errores_derivados", True, "true", f"n_errors = 0 OR {_FLAGGED} OR status = 'error'"),
    ("consistencia_veredicto_deteccion_presente", True, "status = 'completed'", "is_malicious IS NOT NULL"),
    ("consistencia_benigno_sin_tipo_ataque", True, "NOT coalesce(is_malicious, true)", "cls_type IS NULL"),
    ("consistencia_abstencion_flaggeada", True, "det_abstain", _FLAGGED),
    ("consistencia_abstencion_estandarizador_flaggeada", True, "ingest_abstain", f"{_FLAGGED} AND ingest_review AND judge_action = 'human_interrupt'"),
    ("consistencia_malicioso_con_tipo_ataque", True, "status = 'completed' AND coalesce(is_malicious, false)", "cls_type IS NOT NULL"),
    ("consistencia_probabilidad_en_rango", True, "true", "probability BETWEEN 0 AND 1"),
    ("consistencia_etiqueta_vs_probabilidad", True, "is_malicious IS NOT NULL AND NOT det_abstain", f"is_malicious = (probability >= {_D(0.5)})"),
    ("consistencia_modelo_por_tipo", True, "coalesce(is_malicious, false)", "coalesce(cls_task, '') = 'attack_type'"),
    ("consistencia_tipo_ataque_presente", True, "coalesce(is_malicious, false)", "cls_type IS NOT NULL"),
    ("consistencia_version_taxonomia", True, "coalesce(is_malicious, false)", f"coalesce(cls_version, '') = '{VERSION_16}'"),
    ("consistencia_umbral_clasificacion_operativo", True, "coalesce(is_malicious, false)", f"coalesce(abs(cls_threshold - {_D(REVIEW_CLASS)}) <= {_D('1e-9')}, false)"),
    ("consistencia_top_scores_tipos", True, "coalesce(is_malicious, false)", f"top_n = 3 AND top_has_type AND NOT top_invalid AND coalesce(cls_version, '') = '{VERSION_16}'"),
    ("consistencia_tipo_ataque_en_taxonomia", True, "coalesce(is_malicious, false) AND cls_type IS NOT NULL", _IN_TAXONOMY),
    ("consistencia_tipo_ataque_vs_top_scores", True, f"coalesce(is_malicious, false) AND cls_type IS NOT NULL AND {_IN_TAXONOMY}", f"coalesce(top_label = cls_type AND abs(top_score - cls_confidence) <= {_D('1e-6')}, false)"),
    ("consistencia_mitigacion_tipo_ataque", True, _TYPED, "coalesce(exp_type, '') = cls_type"),
    ("consistencia_mitigacion_taxonomia", True, _TYPED, "coalesce(exp_version, '') = coalesce(cls_version, '')"),
    ("consistencia_mitigacion_catalogo_tipado", True, _TYPED, f"coalesce(exp_scope, '') = 'attack_type' AND coalesce(exp_catalog_version, '') = '{CATALOG_VERSION}' AND coalesce(exp_catalog_taxonomy, '') = '{VERSION_16}' AND coalesce(cls_version, '') = '{VERSION_16}' AND exp_compatible"),
    ("consistencia_contenido_catalogo_tipado", True, _TYPED, "n_catalog_issues = 0"),
    ("consistencia_veredicto_juez_tipo_ataque", True, _TYPED, f"coalesce(judge_label = cls_type AND abs(judge_confidence - cls_confidence) <= {_D('1e-6')}, false)"),
    ("consistencia_estado_vs_juez", True, "true", "status <> 'completed' OR (judge_approved AND NOT judge_review)"),
    ("consistencia_salida_catalogo_pura", True, "exp_source = 'catalog'", "exp_pure"),
    ("traza_no_vacia", True, "true", "trace_n > 0"),
    ("traza_entradas_cerradas", True, "true", "trace_open = 0"),
    ("traza_sin_duraciones_negativas", True, "true", "trace_negative = 0"),
    ("traza_orden_temporal", True, "true", "trace_time_ok"),
    ("traza_orden_de_agentes", True, "true", "trace_order_ok"),
    ("traza_juez_presente", True, "status <> 'error'", "has_judge"),
    ("traza_estandarizador_presente", True, "status <> 'error'", "has_standardizer"),
    ("traza_detector_presente", True, "status <> 'error' AND NOT ingest_abstain", "has_detector"),
    ("traza_clasificador_presente", True, "coalesce(is_malicious, false) AND NOT det_abstain AND status <> 'error'", "has_classifier"),
    ("traza_mitigador_presente", True, "coalesce(is_malicious, false) AND NOT det_abstain AND status <> 'error'", "has_mitigator"),
    ("traza_detector_antes_de_clasificar", True, "has_classifier", "has_detector"),
    ("traza_errores_derivados", True, "true", f"trace_errors = 0 OR {_FLAGGED} OR status = 'error'"),
    ("leakage_evento_canonico", True, "has_event", "n_event_leaks = 0"),
    ("leakage_features_modelos", True, "has_event", "n_feature_leaks = 0"),
    ("leakage_evento_canonico_presente", True, "NOT has_event", "status <> 'completed'"),
    ("umbral_mapping_confidence_derivado", True, f"mapping_confidence < {_D(REVIEW_MAPPING)}", _FLAGGED),
    ("umbral_zona_gris_abstiene", True, f"is_malicious IS NOT NULL AND probability BETWEEN {_D(GRAY_LOW)} AND {_D(GRAY_HIGH)}", "det_abstain"),
    ("umbral_confianza_clasificacion_derivada", False, f"cls_type IS NOT NULL AND cls_confidence < coalesce(cls_threshold, {_D(REVIEW_CLASS)})", _FLAGGED),
)
FLAGGED_RULE = "status = 'needs_human_review' OR judge_review OR judge_action IN ('human_interrupt', 'abstain')"


def judge(cases: DataFrame) -> DataFrame:
    """Adds ``issues`` (ordered), ``final_label``, ``final_confidence`` and ``action`` to flat cases."""
    issues = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(code)) for code, cond in JUDGE_ISSUES)))
    out = cases.withColumn("issues", issues).withColumn("final_label", F.expr(FINAL_LABEL)).withColumn("final_confidence", F.expr(f"least(greatest({FINAL_CONFIDENCE}, 0), 1)").cast("double"))
    return out.withColumn("action", F.when(F.size("issues") > 0, "human_interrupt").otherwise("approve"))


def status_of(action: Column, n_errors: Column) -> Column:
    """Status at closing: review before error before completed."""
    return F.when(action == "human_interrupt", "needs_human_review").when(n_errors > 0, "error").otherwise("completed")


def audit(cases: DataFrame) -> DataFrame:
    """(case_id, check_name, passed, hard): every check that applies to every flat case."""
    flagged = cases.withColumn("flagged", F.expr(FLAGGED_RULE))
    entries = F.array(*(F.when(F.expr(applies), F.struct(F.lit(name).alias("check_name"), F.coalesce(F.expr(holds), F.lit(False)).alias("passed"), F.lit(hard).alias("hard"))) for name, hard, applies, holds in AUDIT_CHECKS))
    return flagged.select("case_id", "flagged", F.explode(F.array_compact(entries)).alias("c")).select("case_id", "flagged", "c.*")


def with_verdict(cases: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``n_failed``, without exploding: failed checks are counted by projection."""
    flagged = cases.withColumn("flagged", F.expr(FLAGGED_RULE))
    fails = lambda hard: sum((F.expr(f"CASE WHEN ({a}) AND NOT coalesce(({h}), false) THEN 1 ELSE 0 END") for _, k, a, h in AUDIT_CHECKS if k is hard), F.lit(0))
    counted = flagged.withColumns({"n_hard": fails(True), "n_soft": fails(False)})
    verdict = F.when(F.col("n_hard") > 0, "reject").when(F.col("flagged") | (F.col("n_soft") > 0), "review").otherwise("approve")
    return counted.withColumns({"verdict": verdict, "n_failed": (F.col("n_hard") + F.col("n_soft")).cast("bigint")}).drop("flagged", "n_hard", "n_soft")


def verdicts(cases: DataFrame) -> DataFrame:
    """(case_id, verdict, n_failed) of every case."""
    return with_verdict(cases).select("case_id", "verdict", "n_failed")


def route(cases: DataFrame) -> DataFrame:
    """Stages that a case passes, from the guards between them."""
    to_detect = ~F.col("ingest_abstain") & (F.coalesce("mapping_confidence", F.lit(0.0)) >= REVIEW_MAPPING)
    to_classify = to_detect & ~F.col("det_abstain") & F.coalesce("is_malicious", F.lit(False))
    to_explain = to_classify & F.col("cls_present") & F.coalesce("cls_type", F.lit("")).isin(*TYPES_16)
    path = F.array_compact(F.array(F.lit("standardize"), F.when(to_detect, "detect"), F.when(to_classify, "classify"), F.when(to_explain, "explain"), F.lit("judge")))
    return cases.withColumn("path", F.array_join(path, ">"))


# Traces


def trace_sequence(trace: DataFrame, case: str, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """Adds ``seq``, from 1 in each case, after the greatest stored number if ``base`` (case, seq) is given."""
    numbered = trace.withColumn("seq", F.row_number().over(Window.partitionBy(case).orderBy(*order)).cast("bigint"))
    if base is None:
        return numbered
    last = base.groupBy(case).agg(F.max("seq").alias("_last"))
    return numbered.join(last, case, "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")


def trace_facts(trace: DataFrame, case: str = "case_id") -> DataFrame:
    """One row of the auditor's trace facts for each case of (case, seq, agent, status, started_us, finished_us)."""
    place = F.lit(None).cast("int")
    for k, name in enumerate(STAGES):
        place = F.when(F.col("agent") == name, k).otherwise(place)
    by = Window.partitionBy(case).orderBy("seq")
    known = F.last("place", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = trace.withColumn("place", place).withColumn("before", F.lag("started_us").over(by)).withColumn("behind", known)
    has = lambda agent: F.coalesce(F.bool_or(F.col("agent") == agent), F.lit(False))
    return marked.groupBy(case).agg(
        F.count(F.lit(1)).alias("trace_n"), F.count_if(F.col("finished_us").isNull()).alias("trace_open"), F.count_if(F.col("finished_us") < F.col("started_us")).alias("trace_negative"), F.bool_and(F.coalesce(F.col("before") <= F.col("started_us"), F.lit(True))).alias("trace_time_ok"),
        F.bool_and(F.coalesce(F.col("behind") <= F.col("place"), F.lit(True))).alias("trace_order_ok"), F.count_if(F.col("status") == "error").alias("trace_errors"), has("final_judge").alias("has_judge"), has("final_standardizer").alias("has_standardizer"),
        has("final_detector").alias("has_detector"), has("final_classifier").alias("has_classifier"), has("final_mitigator").alias("has_mitigator"),
    )


def score_facts(scores: Column, label: Column) -> dict[str, Column]:
    """top_n, top_label, top_score, top_has_type and top_invalid of a map of scores by type."""
    entries = F.map_entries(scores)
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    bad = F.exists(entries, lambda e: ~e["key"].isin(*TYPES_16) | e["value"].isNull() | ~e["value"].between(0, 1))
    return {"top_n": F.coalesce(F.size(scores), F.lit(0)), "top_label": best["k"], "top_score": best["v"], "top_has_type": F.coalesce(F.map_contains_key(scores, label), F.lit(False)), "top_invalid": F.coalesce(bad, F.lit(False))}


# Store


def list_cases(cases: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """Newest cases, ties by case_id; a limit is what is asked for here."""
    rows = cases if status is None else cases.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_us"), "case_id").limit(limit)


def similar_cases(queries: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """The k newest other cases of each query case's type and profile.

    Only the k + 1 newest cases of a (type, profile) can be an answer, so the
    store is cut to those before the join and no group meets itself.
    """
    keys = ["type", "profile"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_us"), "case_id")
    top = cases.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= k + 1).select(*keys, F.col("case_id").alias("other_id"), F.col("created_us").alias("other_us"))
    met = queries.select("case_id", *keys).join(top, keys).where("case_id <> other_id")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("other_us"), "other_id"))
    return met.withColumn("rn", place.cast("bigint")).where(F.col("rn") <= k).select("case_id", "other_id", "rn")


def upsert(stored: DataFrame, changes: DataFrame, key: str = "case_id") -> DataFrame:
    """The store with changed rows replaced and new rows added."""
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def conflicts(stored: DataFrame, new: DataFrame, key: str = "case_id") -> DataFrame:
    """New rows whose key exists already: creating them is an error."""
    return new.join(stored.select(key), key, "left_semi")


def migrate_legacy(cases: DataFrame) -> DataFrame:
    """Old rows in today's form: a blank type takes the subtype, the scope ``family`` becomes null, families go."""
    kind = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.nullif(F.trim("subtype"), F.lit("")))
    scope = F.when(F.col("scope") != "family", F.col("scope"))
    return cases.withColumn("type", kind).withColumn("scope", scope).withColumn("indexed_type", F.when(kind.isin(*TYPES_16), kind)).drop("subtype", "family")


def flat_facts(cases: DataFrame, n_catalog_issues: Column | int = 0) -> DataFrame:
    """The judge's facts of cases whose stage outputs are JSON texts (null where a stage gave none) and whose ``errors`` are a list.

    Columns read: ingest_output, detection_output, classification_output, explanation_output, errors.
    """
    read = lambda name, schema: F.from_json(name, schema)
    c = cases.withColumns({"_i": read("ingest_output", schemas.INGEST), "_d": read("detection_output", schemas.DETECTION), "_c": read("classification_output", schemas.CLASSIFICATION), "_e": read("explanation_output", schemas.EXPLANATION)})
    i, d, k, e = (F.col(n) for n in ("_i", "_d", "_c", "_e"))
    no = lambda x: F.coalesce(x, F.lit(False))
    facts = {
        "n_errors": F.coalesce(F.size("errors"), F.lit(0)), "ingest_abstain": no(i["abstain"]), "ingest_review": no(i["requires_human_review"]), "mapping_confidence": i["mapping_confidence"],
        "det_present": d.isNotNull(), "probability": F.coalesce(d["probability"], F.lit(0.0)), "is_malicious": d["is_malicious"], "det_abstain": no(d["abstain"]),
        "cls_present": k.isNotNull(), "cls_task": F.when(k.isNotNull(), F.coalesce(k["model_task"], F.lit("attack_type"))), "cls_type": k["attack_type"], "cls_version": k["taxonomy_version"], "cls_confidence": k["confidence"], "cls_threshold": k["decision_threshold"],
        **score_facts(k["top_scores"], k["attack_type"]),
        "exp_present": e.isNotNull(), "exp_type": e["attack_type"], "exp_version": e["taxonomy_version"], "exp_scope": e["catalog_scope"], "exp_catalog_version": e["catalog_version"], "exp_catalog_taxonomy": e["catalog_taxonomy_version"],
        "exp_compatible": no(F.array_contains(e["catalog_compatible_taxonomy_versions"], k["taxonomy_version"])), "exp_source": e["source"], "exp_review": no(e["requires_human_review"]), "n_catalog_issues": n_catalog_issues if isinstance(n_catalog_issues, Column) else F.lit(n_catalog_issues),
    }
    return c.select(*cases.columns, *(f.alias(name) for name, f in facts.items()))
