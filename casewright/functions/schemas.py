"""Schemas of what stages give and of what a case is made of."""

from __future__ import annotations

#: Fields of the stages' outputs and of traces.
INGEST = "abstain boolean, requires_human_review boolean, mapping_confidence double"
DETECTION = "is_malicious boolean, probability double, abstain boolean"
CLASSIFICATION = "model_task string, attack_type string, taxonomy_version string, confidence double, decision_threshold double, top_scores map<string,double>"
EXPLANATION = "attack_type string, taxonomy_version string, catalog_scope string, catalog_version string, catalog_taxonomy_version string, catalog_compatible_taxonomy_versions array<string>, source string, requires_human_review boolean"
JUDGEMENT = "approved boolean, final_label string, final_confidence double, issues array<string>, action string"
TRACE = "seq bigint, agent string, status string, started_us bigint, finished_us bigint"
CASE = f"case_id bigint, status string, errors array<string>, trace array<struct<{TRACE}>>, judgement struct<{JUDGEMENT}>"
