"""Queries over files, stores, nested payloads, whole case runs and training.

File queries first write the driver's tables out in the form that the source
reads, in the shared folder; their oracles read the Parquet originals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.functions import contracts, groups, hashing, leak, taxonomy, values
from casewright.operators import campaign as C
from casewright.operators import cases as K
from casewright.operators import catalog as G
from casewright.operators import boosting, learning, payloads, run, textmetrics, training, vectors
from casewright.session import bounded_batches, checkpoint_dir, spread, stored, table
from casewright.sources import files
from casewright.streaming import streams

from .cases import FLAT_SQL, VERDICT_SQL, flat_cases, judged_cases
from .views import SPLIT_SQL, TRACE_SQL, sql, split_of, v_attempt, v_case, v_cat, v_doc, v_manifest, v_trace

R = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1)).alias("n")


def _place(s, label: str) -> str:
    return f"{checkpoint_dir(s)}/{label}-{uuid.uuid4().hex}"


# Files


def _csv(s, d):
    """Events as one CSV file for each type, in order of their ids, read with the place of each row in its file."""
    path = _place(s, "events-csv")
    e = table(s, d, "events").select("event_id", "event_type", "user_id", "props")
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").write.partitionBy("event_type").option("header", True).option("escape", '"').csv(path)
    rows = files.scan_csv(s, f"{path}/*/*.csv", "event_id bigint, user_id bigint, props string")
    kind = F.regexp_extract("source_file", "event_type=([^/]+)/", 1)
    return rows.select("event_id", "row_id", F.concat_ws("::", F.lit("events"), kind, F.col("row_id").cast("string")).alias("manifest_id"), values.normalize_token(kind).alias("cls"), "props")


def _broken_csv(s, d):
    """Texts with quotes and line breaks inside CSV fields come back whole."""
    path = _place(s, "documents-csv")
    table(s, d, "documents").select("doc_id", "text").write.option("header", True).option("escape", '"').csv(path)
    rows = files.scan_csv(s, f"{path}/*.csv", "doc_id bigint, text string", id_column="doc_id", multi_line=True)
    return rows.select("row_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))


def _manifests(s, d):
    """Customers as manifest lines, some of them spoiled: torn, without a hash, with an unknown split, with a target in the row."""
    path, k = _place(s, "manifests"), F.col("manifest_id")
    m = v_manifest(s, d).select(
        F.when(k % 50 == 0, "m0").otherwise(F.concat(F.lit("m"), k.cast("string"))).alias("manifest_id"), F.lit("customers").alias("dataset"), F.lit("c.csv").alias("source_file"), k.cast("string").alias("row_id"),
        F.when(k % 23 != 0, F.sha2(k.cast("string"), 256)).alias("content_hash"), F.when(k % 29 == 0, "dev").otherwise(F.col("split")).alias("split"), F.array(F.lit("binary")).alias("tasks"), F.struct(F.col("class"), "is_attack").alias("target"),
        F.when(k % 31 == 0, F.create_map(F.lit("label"), F.col("class"))).otherwise(F.create_map(F.lit("detail"), F.col("detail"))).alias("row"), k.alias("k"),
    )
    line = F.to_json(F.struct(*(c for c in m.columns if c != "k")))
    m.select(F.when(F.col("k") % 41 == 0, F.left(line, F.lit(30))).otherwise(line).alias("value")).write.text(path)
    read = files.read_manifests(s, path)
    found = read.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(N())
    return found.unionByName(files.duplicate_manifests(read.where("manifest_id is not null")).where("field = 'manifest_id'").select(F.lit("duplicate_id").alias("violation"), "n"))


MANIFEST_SQL = "SELECT CASE WHEN k % 41 = 0 THEN 'unparsable' WHEN k % 23 = 0 THEN 'missing_field' WHEN k % 29 = 0 THEN 'bad_split' WHEN k % 31 = 0 THEN 'target_in_row' ELSE 'none' END AS violation, count(*) AS n FROM (SELECT manifest_id AS k FROM v_manifest) GROUP BY 1 UNION ALL SELECT 'duplicate_id', count(*) FROM v_manifest WHERE manifest_id % 50 = 0 AND manifest_id % 41 <> 0 HAVING count(*) > 1"


def _attempts(s, d):
    """Events as attempt lines in one file for each thousand of them: a byte order mark before some first lines, some torn in the middle, and the last of each file without its end."""
    path, k = _place(s, "attempts"), F.col("seq")
    a = v_attempt(s, d).withColumn("part", F.expr("seq div 1000"))
    # Places in a file, so that of rows with one number only the first line has the mark and only the last one the torn line behind it.
    # The torn line isn't a row of its own: Spark drops a repartition over a union whose sides are dealt by the same key
    # already, and then coalesces them apart, so that a file would be written in two.
    order = Window.partitionBy("part").orderBy("seq")
    a = a.withColumn("place", F.row_number().over(order)).withColumn("torn", F.lead("place").over(Window.partitionBy("part").orderBy("place")).isNull())
    line = F.to_json(F.struct(F.col("manifest_id").cast("string").alias("manifest_id"), "ok", F.col("llm").alias("parsed_by_llm"), "provider", F.col("confidence").alias("mapping_confidence")))
    mark, torn = F.when((F.col("place") == 1) & (F.col("part") % 2 == 0), "\ufeff").otherwise(""), F.when(F.col("torn"), '{"manifest_id":"9').otherwise("")
    lines = a.select("part", "place", F.concat(mark, F.when(k % 37 == 0, F.left(line, F.lit(20))).otherwise(line), F.lit("\n"), torn).alias("value"))
    # The writer's own separator is a blank, so that the last line of a file has no line feed.
    lines.repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").option("lineSep", " ").text(path)
    exact = F.sum(F.col("mapping_confidence").cast("decimal(38,18)")).cast("double")  # the same in any order
    status = F.when(F.col("state") != "parsed", F.col("state")).when(~F.col("ok"), "failed").when(F.col("parsed_by_llm"), "model").otherwise("fallback")
    return files.read_attempts(s, f"{path}/*/*.txt").groupBy(status.alias("status")).agg(N(), R(exact).alias("confidence"), F.sum("seq").alias("places"))


ATTEMPTS_SQL = ", l AS (SELECT seq // 1000 AS part, CAST(seq AS DOUBLE) AS k, CASE WHEN seq % 37 = 0 THEN 'corrupt' WHEN NOT ok THEN 'failed' WHEN llm THEN 'model' ELSE 'fallback' END AS status, confidence FROM v_attempt UNION ALL SELECT seq // 1000, max(seq) + 0.5, 'truncated', NULL FROM v_attempt GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY 'part=' || CAST(part AS VARCHAR) || '/', k) - 1 AS place FROM l) SELECT status, count(*) AS n, round(sum(CASE WHEN status <> 'corrupt' THEN confidence END), 6) AS confidence, CAST(sum(place) AS BIGINT) AS places FROM p GROUP BY 1"


def _lines(s, d):
    """Fifty lines from physical line 100 on over files in the order of their paths, blank ones not counted among the fifty."""
    path = _place(s, "lines")
    e = v_attempt(s, d).repartitionByRange("seq").sortWithinPartitions("seq")
    e.select(F.when(F.col("seq") % 7 == 0, "").otherwise(F.to_json(F.struct("seq", "state"))).alias("value")).write.text(path)
    return files.read_lines(s, path, 100, 50).select("line", F.get_json_object("value", "$.seq").cast("bigint").alias("seq"), F.get_json_object("value", "$.state").alias("state"))


def _sink(s, d):
    """Selected rows as JSON lines by class and split, targets apart from the rest, read back."""
    path = _place(s, "selected")
    files.write_selected(v_manifest(s, d).withColumnRenamed("class", "dataset"), path, targets=("is_attack",))
    back = s.read.json(path)
    return back.groupBy("dataset", "split").agg(N(), F.count_if("target.is_attack").alias("n_attack"), F.sum("row.manifest_id").alias("ids"))


def _inventory(s, d):
    """A file for each nation: bytes and hashes of what is in them, and one hash of all."""
    path = _place(s, "nations")
    table(s, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return files.inventory(s, path, recursive=True).select("n_bytes", "sha256")


# Nested payloads


def _nested(s, d):
    """Customers as canonical payloads: nested targets, values inside and outside of the containers, column names, assignments in texts."""
    c, k = table(s, d, "customer"), F.col("c_custkey").cast("string")
    label = F.when(F.col("c_custkey") % 3 == 0, "").otherwise("x")
    proto = F.when(F.col("c_custkey") % 7 == 0, "DDoS").otherwise(F.lower("c_mktsegment"))
    column = F.when(F.col("c_custkey") % 5 == 0, "attack_cat").otherwise(F.lower("c_name"))
    note = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("seen label="), F.lower("c_mktsegment"))).otherwise(F.lower("c_mktsegment"))
    js = F.concat(
        F.lit('{"id":'), k, F.lit(',"label":"'), label, F.lit('","ctx":{"dns":{"level":"A"},"threat":{"level":'), F.col("c_nationkey").cast("string"), F.lit('}},"service_context":{"dns":{"type":"AAAA"},"protocol_family":"x"},"items":[{"attack":"y","v":'), k,
        F.lit('},"DDoS"],"host":{"tags":["'), proto, F.lit('"]},"evidence_fields":["bytes","'), column, F.lit('"],"feature_groups":{"flow":["'), column, F.lit('"]},"semantic_text":"'), note, F.lit('"}'),
    )
    return spread(c, "c_custkey").select("c_custkey", js.alias("js"))


NESTED_SQL = "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'column:evidence_fields[1],column:feature_groups.flow[0]' END, 'field:ctx.threat,field:items[0].attack', CASE WHEN c_custkey % 3 <> 0 THEN 'field:label' END, CASE WHEN c_custkey % 4 = 0 THEN 'text:semantic_text' END, CASE WHEN c_custkey % 7 = 0 THEN 'value:host.tags[0]' END) AS paths FROM customer"
CLEAN_SQL = """SELECT c_custkey, '{"id":' || c_custkey || ',"ctx":{"dns":{"level":"A"}},"service_context":{"dns":{"type":"AAAA"},"protocol_family":"x"},"items":[{"v":' || c_custkey || '},"DDoS"],"host":{"tags":[' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '"' || lower(c_mktsegment) || '"' END || ']},"evidence_fields":["bytes"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',"' || lower(c_name) || '"' END || '],"feature_groups":{"flow":[' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '"' || lower(c_name) || '"' END || ']},"semantic_text":"' || CASE WHEN c_custkey % 4 = 0 THEN 'seen' ELSE lower(c_mktsegment) END || '"}' AS clean FROM customer"""
PLACES_SQL = "SELECT c_custkey, 'ctx.threat,items[0].attack,label,service_context.protocol_family' AS places FROM customer"
SCRUB_SQL = """SELECT c_custkey, '{"id":' || c_custkey || ',"ctx":{"dns":{"level":"A"}},"service_context":{"dns":{}},"items":[{"v":' || c_custkey || '},"DDoS"],"host":{"tags":["' || CASE WHEN c_custkey % 7 = 0 THEN 'DDoS' ELSE lower(c_mktsegment) END || '"]},"evidence_fields":["bytes","' || CASE WHEN c_custkey % 5 = 0 THEN 'attack_cat' ELSE lower(c_name) END || '"],"feature_groups":{"flow":["' || CASE WHEN c_custkey % 5 = 0 THEN 'attack_cat' ELSE lower(c_name) END || '"]},"semantic_text":"' || CASE WHEN c_custkey % 4 = 0 THEN 'seen' ELSE lower(c_mktsegment) END || '"}' AS clean FROM customer"""


# Stores and runs


def _evict(s, d):
    """Documents' hashes as cache keys; the asked ones go, requests that are no hashes do nothing."""
    cache = v_doc(s, d).select(F.col("fp").alias("content_hash"), F.sha2("dataset", 256).alias("pipeline_hash")).distinct()
    asked = v_doc(s, d).where("label is not null").select(F.when(F.col("label") == 0, F.col("fp")).otherwise(F.left("fp", F.lit(10))).alias("content_hash"), F.sha2("dataset", 256).alias("pipeline_hash"))
    left = C.evict(cache, asked)
    return left.select("content_hash", "pipeline_hash")


def _persist(s, d):
    trace = run.numbered(v_trace(s, d), ["place"]).select("case_id", "seq", F.when((F.col("flag") == "R") & (F.col("stage") == 3), "nobody").otherwise("final_judge").alias("agent"))
    results = v_case(s, d).select("case_id", F.when(F.col("status") == "P", "open").otherwise("completed").alias("status"))
    store = table(s, d, "supplier").select((F.col("s_suppkey") * 4).alias("case_id"))
    return run.persist(store, results, trace, K.STAGES)


PERSIST_SQL = f", sq AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {TRACE_SQL}) AS seq, flag = 'R' AND stage = 3 AS bad FROM v_trace), tn AS (SELECT case_id, count(*) AS n, min(CASE WHEN bad THEN seq END) AS first_bad FROM sq GROUP BY 1), st AS (SELECT c.case_id, CASE WHEN c.case_id IN (SELECT s_suppkey * 4 FROM supplier) THEN 'create_case' WHEN first_bad IS NOT NULL THEN 'append_trace' WHEN c.status = 'P' THEN 'update_case' END AS failed_step, n, first_bad FROM v_case c LEFT JOIN tn ON c.case_id = tn.case_id) SELECT case_id, failed_step, CASE failed_step WHEN 'create_case' THEN NULL WHEN 'append_trace' THEN 'open' WHEN 'update_case' THEN 'open' ELSE 'completed' END AS stored_status, CAST(CASE failed_step WHEN 'create_case' THEN 0 WHEN 'append_trace' THEN first_bad - 1 ELSE coalesce(n, 0) END AS BIGINT) AS n_stored FROM st"


def _upsert(s, d):
    """The store after an update: pending cases are closed, and the suppliers' numbers come as new cases."""
    c = v_case(s, d).select("case_id", "status")
    changed = c.where("status = 'P'").withColumn("status", F.lit("closed"))
    new = table(s, d, "supplier").select((F.col("s_suppkey") + 1000000000).alias("case_id"), F.lit("open").alias("status"))
    return K.upsert(c, changed.unionByName(new))


def _run(s, d):
    """Standardize to judge in a row, then the audit, with trace facts that come from the traces."""
    began = F.unix_micros(F.col("opened").cast("timestamp"))
    opened = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("opened"))
    # Written out after each leg, so that rules read plain columns and not the expressions behind them.
    cases = stored(run.traced(flat_cases(s, d).join(opened, "case_id"), began).drop("opened", "path"), "traced-cases")
    flat = stored(run.with_trace_facts(cases).drop("trace"), "flat-cases")
    out = K.with_verdict(stored(judged_cases(s, d, flat), "judged-cases"))
    return out.select("case_id", "trace_n", "has_judge", "has_classifier", "has_mitigator", "trace_errors", "status", "n_issues", "verdict", "n_failed")


_TYPES = ", ".join(f"'{t}'" for t in taxonomy.TYPES_16)
RUN_FLAT = FLAT_SQL.replace("flat AS (", "flat0 AS (", 1) + f", guards AS (SELECT *, NOT ingest_abstain AND coalesce(mapping_confidence, 0) >= CAST(0.5 AS DOUBLE) AS g1, NOT det_abstain AND coalesce(is_malicious, false) AS g2, cls_present AND coalesce(cls_type, '') IN ({_TYPES}) AS g3 FROM flat0), flat AS (SELECT * EXCLUDE (g1, g2, g3) REPLACE (CAST(3 + CAST(g1 AS INT) + CAST(g1 AND g2 AS INT) + CAST(g1 AND g2 AND g3 AS INT) AS BIGINT) AS trace_n, CAST(0 AS BIGINT) AS trace_open, CAST(0 AS BIGINT) AS trace_negative, true AS trace_time_ok, true AS trace_order_ok, CAST(n_errors > 0 AS BIGINT) AS trace_errors, true AS has_judge, true AS has_standardizer, g1 AS has_detector, g1 AND g2 AS has_classifier, g1 AND g2 AND g3 AS has_mitigator) FROM guards)"
RUN_SQL = VERDICT_SQL.replace(FLAT_SQL, RUN_FLAT, 1)


#: What the stages of a malicious case give when nothing is wrong, as JSON texts.
STAGE_OUTPUTS = {
    "ingest_output": '{"mapping_confidence": 0.9, "abstain": false}',
    "detection_output": '{"is_malicious": true, "probability": 0.97, "abstain": false}',
    "classification_output": '{"model_task": "attack_type", "attack_type": "XSS", "taxonomy_version": "VERSION", "confidence": 0.8, "decision_threshold": 0.65, "top_scores": {"XSS": 0.8, "MITM": 0.15, "DoS": 0.05}}'.replace("VERSION", taxonomy.VERSION_16),
    "explanation_output": '{"attack_type": "XSS", "taxonomy_version": "VERSION", "catalog_scope": "attack_type", "catalog_version": "4.0", "catalog_taxonomy_version": "VERSION", "catalog_compatible_taxonomy_versions": ["VERSION"], "source": "hybrid"}'.replace("VERSION", taxonomy.VERSION_16),
}
#: One deviation in each line: output, text in it, what stands there instead (None: no output at all), the issues that must come.
OUTPUT_DEVIATIONS = (
    ("classification_output", "0.8", "0.6", "classification_confidence_below_review_threshold"), ("classification_output", "decision_threshold", "other", "classification_threshold_missing"), ("classification_output", ', "DoS": 0.05', "", "classification_top_scores_invalid"),
    ("classification_output", "DoS", "Nothing", "classification_top_scores_invalid"), ("classification_output", '"attack_type": "XSS"', '"attack_type": ""', "classification_attack_type_missing,classification_top_scores_invalid"), ("classification_output", "0.65", "0.5", "classification_threshold_mismatch"),
    ("detection_output", '"abstain": false', '"abstain": true', "detector_abstained"), ("detection_output", "0.97", "0.1", "detection_label_probability_mismatch"), ("detection_output", None, None, "detection_missing"), ("explanation_output", None, None, "malicious_without_mitigation"),
    ("explanation_output", '"attack_type": "XSS"', '"attack_type": "MITM"', "mitigation_attack_type_mismatch"), ("explanation_output", f'["{taxonomy.VERSION_16}"]', "[]", "mitigation_catalog_taxonomy_version_mismatch"), ("explanation_output", '"4.0"', '"3.0"', "mitigation_catalog_version_mismatch"),
    ("explanation_output", '"source"', '"requires_human_review": true, "source"', "mitigator_requested_human_review"), ("ingest_output", "0.9", "0.4", "mapping_confidence_below_review_threshold"), ("ingest_output", "false", "true", "standardizer_abstained"), ("errors", "", "", "pipeline_errors_present"),
)


def _judged_outputs(s, d):
    """Every order as a case with nested stage outputs, one of them off: the judge's issues."""
    k = F.col("o_orderkey") % (len(OUTPUT_DEVIATIONS) + 1)
    columns = {name: F.lit(text) for name, text in STAGE_OUTPUTS.items()}
    columns["errors"] = F.array().cast("array<string>")
    for i, (name, old, new, _) in enumerate(OUTPUT_DEVIATIONS):
        bad = F.array(F.lit("stage failed")) if name == "errors" else F.lit(None if old is None else STAGE_OUTPUTS[name].replace(old, new)).cast("string")
        columns[name] = F.when(k == i, bad).otherwise(columns[name])
    cases = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), *(c.alias(n) for n, c in columns.items()))
    return K.judge(K.flat_facts(cases)).select("case_id", F.array_join("issues", ",").alias("issues"), "action")


OUTPUTS_SQL = f"SELECT case_id, issues, CASE WHEN issues = '' THEN 'approve' ELSE 'human_interrupt' END AS action FROM (SELECT o_orderkey AS case_id, CASE o_orderkey % {len(OUTPUT_DEVIATIONS) + 1} " + " ".join(f"WHEN {i} THEN '{issues}'" for i, (*_, issues) in enumerate(OUTPUT_DEVIATIONS)) + " ELSE '' END AS issues FROM orders)"


def _batch(s, d):
    return run.batch(flat_cases(s, d).join(v_case(s, d).select("case_id", "profile"), "case_id"), "profile")


def _review(s, d):
    part = table(s, d, "part")
    kept = part.select((F.col("p_partkey") + F.when(F.col("p_size") == 50, 1000000000).otherwise(0)).alias("item_id"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(F.lit(" ")).alias("reference"))
    twice = part.where("p_size = 7").select(F.col("p_partkey").alias("item_id"), F.lit("again").alias("reference"))
    return G.review(v_cat(s, d), kept.unionByName(twice))


# Training


def _training_rows(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fp = F.sha2(F.concat_ws("|", F.col("o_orderdate").cast("string"), "o_custkey"), 256)
    return o.select(
        F.col("o_orderkey").alias("doc_id"), fp.alias("fp"), (F.col("o_orderstatus") == "F").alias("label"), split_of(F.col("o_orderkey")).alias("split"), F.col("c_mktsegment").alias("origin"),
        "o_orderpriority", F.col("o_totalprice").alias("price"), F.datediff(F.col("o_orderdate"), F.lit("1992-01-01")).cast("double").alias("age"),
    )


def _detector(s, d):
    return training.train(_training_rows(s, d), learning.detector(["o_orderpriority", "price", "age"]))


def _artifact(s, d):
    """A fitted model, stored, read again: the same scores, and a hash of its files."""
    fitted, path = _detector(s, d), _place(s, "model")
    saved = training.save(fitted.model, path)
    ready = training.prepared(_training_rows(s, d), "42").withColumn("label", F.col("label").cast("double"))
    again = learning.scored(training.loaded(path), ready, ["doc_id"]).withColumnRenamed("probability", "again")
    same = fitted.scores.join(again, "doc_id").agg(F.bool_and(F.abs(F.col("probability") - F.col("again")) < 1e-12).alias("same"), N())
    return same.crossJoin(saved.select("n_files", (F.length("sha256") == 64).alias("hashed")))  # one row each


def _nfkd(s, d):
    bounded_batches(s)
    tokens = F.array_join(textmetrics.tokens_nfkd(F.col("text")), " ")
    return table(s, d, "documents").select("doc_id", tokens.alias("tokens")).select("doc_id", F.md5("tokens").alias("md5"))


def _letters(s, d):
    """Documents with their language and, as features, the share of each letter and the source."""
    docs = table(s, d, "documents").where("lang is not null").select("doc_id", "lang", "source", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    share = lambda c: F.struct(((F.length("t") - F.length(F.replace("t", F.lit(c)))) / F.greatest(F.length("t"), F.lit(1))).alias("num"), F.lit(None).cast("string").alias("str"))
    source = F.struct(F.lit(None).cast("double").alias("num"), F.col("source").alias("str"))
    features = F.create_map(F.lit("source"), source, *(x for c in "abcdefghijklmnopqrstuvwxyz" for x in (F.lit(f"letter.{c}"), share(c))))
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), split_of(F.col("doc_id")).alias("split"), features.alias("features"))


def _classes(s, d):
    """Languages by joint softmax boosting over sparse vectors: confusion of the test split."""
    rows = stored(_letters(s, d), "letters")  # the texts are read once
    names = vectors.vocabulary(rows.where("split = 'train'"))
    made = stored(rows.select("id", "label", "split").join(vectors.vectors(rows, "id", names), "id"), "letter-vectors")
    model = boosting.fit(made.where("split = 'train'"), names.count(), rounds=4, depth=3, rate=0.5)
    return boosting.score(made.where("split = 'test'"), model, ["label"]).groupBy("label", "prediction").agg(N())


def _sparse(s, d):
    """Orders as sparse vectors by a vocabulary of the training split; names that only others have are left out."""
    o = table(s, d, "orders")
    text, number = lambda c: F.struct(F.lit(None).cast("double").alias("num"), c.alias("str")), lambda c: F.struct(c.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))
    features = F.create_map(F.lit("prio"), text(F.col("o_orderpriority")), F.lit("price"), number(F.col("o_totalprice")), F.concat(F.lit("year."), F.year("o_orderdate").cast("string")), number(F.lit(1)))
    rows = o.select("o_orderkey", split_of(F.col("o_orderkey")).alias("split"), features.alias("features"))
    names = vectors.vocabulary(rows.where("split = 'train' and o_orderkey % 3 = 0"))
    found = vectors.vectors(rows, "o_orderkey", names)
    return found.select("o_orderkey", F.array_join(F.transform("vector", lambda e: F.concat_ws(":", e["index"], F.round(e["value"], 2).cast("decimal(18,2)"))), ",").alias("vector"))


SPARSE_SQL = f"WITH o AS (SELECT o_orderkey, {SPLIT_SQL} AS split, unnest(['prio=' || o_orderpriority, 'price', 'year.' || CAST(year(o_orderdate) AS VARCHAR)]) AS name, unnest([CAST(1 AS DOUBLE), CAST(o_totalprice AS DOUBLE), 1]) AS value FROM orders), v AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT name FROM o WHERE split = 'train' AND o_orderkey % 3 = 0)) SELECT k.o_orderkey, coalesce(string_agg(v.idx || ':' || CAST(CAST(o.value AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY v.idx), '') AS vector FROM orders k LEFT JOIN o ON k.o_orderkey = o.o_orderkey LEFT JOIN v ON o.name = v.name GROUP BY 1"


PREPARED_SQL = f", r AS (SELECT o_orderkey AS doc_id, o_orderdate, o_custkey, o_orderstatus = 'F' AS label, {SPLIT_SQL} AS split, c_mktsegment AS origin FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT min(doc_id) AS doc_id FROM r GROUP BY o_orderdate, o_custkey HAVING min(split) = max(split) AND min(label) = max(label)), q AS (SELECT split, origin, least(count(*) FILTER (label), count(*) FILTER (NOT label)) AS n FROM r JOIN g ON r.doc_id = g.doc_id GROUP BY 1, 2) SELECT split, origin, label, n FROM q CROSS JOIN (VALUES (true), (false)) v(label) WHERE n > 0"


def _fingerprints(s, d):
    """Fingerprints of feature maps, the keys in any order and numbers of any type."""
    o = table(s, d, "orders")
    number = lambda c: F.struct(c.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))
    text = lambda c: F.struct(F.lit(None).cast("double").alias("num"), c.alias("str"))
    features = F.create_map(F.lit("prio"), text(F.col("o_orderpriority")), F.lit("cust"), number(F.col("o_custkey") % 1000), F.lit("late"), number(F.col("o_orderstatus") == "F"))
    return o.select("o_orderkey", hashing.feature_fingerprint(features).alias("fp"))


def _breaker(s, d):
    """The open run of failures of each user as the stream leaves it, and whether three in a row ever tripped it.

    All files come in one batch: their order need not be that of the ids.
    """
    events = streams.event_stream(s, d, 1_000_000).select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    kept = streams.keep_runs(events, _place(s, "breaker"), "user_id", 3, seq="event_id").read()
    return kept.select("user_id", F.col("tail").alias("failures"), (F.col("most") >= 3).alias("tripped"))


BREAKER_SQL = "WITH i AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events), c AS (SELECT user_id, island, count(*) FILTER (NOT ok) AS run FROM i GROUP BY 1, 2) SELECT user_id, CAST(arg_max(run, island) AS BIGINT) AS failures, max(run) >= 3 AS tripped FROM c GROUP BY 1"


def _origin(s, d):
    c = table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    path = F.concat(F.lit("/data/Site "), F.col("c_nationkey").cast("string"), F.lit("/rows.csv"))
    return c.select("c_custkey", F.explode(groups.origin_features(name, F.when(F.col("c_custkey") % 2 == 0, path), F.lit("network_flow"))).alias("f")).select("c_custkey", "f.key", "f.value")


def _snapshot(s, d):
    e = table(s, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    event = F.create_map(F.lit("event_id"), F.col("event_id").cast("string"), F.lit("app_proto"), F.col("event_type"), F.lit("label"), F.lit("x"), F.lit("service_context"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k":'), k, F.lit("}"))).otherwise(F.lit("{}")), F.lit("src_ip"), F.when(F.col("user_id") % 3 == 0, F.lit("10.0.0.1")), F.lit("packet_count"), F.when(k.cast("int") > 50, k).otherwise(F.lit(" ")))
    snap = leak.evidence_snapshot(event)
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(snap)), ",").alias("fields"))


def _preflight(s, d):
    m = v_manifest(s, d).withColumn("manifest_id", F.col("manifest_id") + F.when(F.col("manifest_id") % 5 == 0, 100000000).otherwise(0))
    return C.preflight(m, v_attempt(s, d).withColumn("model", F.when(F.col("seq") % 3 == 0, "M1").otherwise("m2")), provider="Alpha", model="m1")


PREFLIGHT_SQL = ", m AS (SELECT manifest_id + CASE WHEN manifest_id % 5 = 0 THEN 100000000 ELSE 0 END AS manifest_id FROM v_manifest), b AS (SELECT manifest_id, arg_max(provider, seq) AS provider, arg_max(seq % 3 = 0, seq) AS m1, bool_or(llm) AS llm FROM v_attempt WHERE ok GROUP BY 1), j AS (SELECT m.manifest_id, provider, m1, llm FROM m LEFT JOIN b ON m.manifest_id = b.manifest_id) SELECT * FROM (SELECT 'orphan_results' AS failure, count(*) AS n FROM v_attempt WHERE manifest_id NOT IN (SELECT manifest_id FROM m) UNION ALL SELECT 'incomplete', count(*) FILTER (provider IS NULL) FROM j UNION ALL SELECT 'llm_required', count(*) FILTER (provider IS NOT NULL AND NOT llm) FROM j UNION ALL SELECT 'provider_mismatch', count(*) FILTER (provider <> 'alpha') FROM j UNION ALL SELECT 'model_mismatch', count(*) FILTER (NOT m1) FROM j) WHERE n > 0"


def _stage_outputs(s, d):
    """The five stages' outputs of every order, made of its columns, against their contracts."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    event, share = F.when(k % 17 != 0, k.cast("string")).alias("event_id"), (F.floor(F.col("o_totalprice")).cast("long") / 200000)
    flag = F.when(k % 13 != 0, F.col("o_orderstatus") == "F")
    route = F.when(F.col("o_orderstatus") == "F", "judge").when(F.col("o_orderstatus") == "O", "end").otherwise(F.lower("o_orderstatus"))
    made = {
        "ingest": F.struct(event, flag.alias("normalized"), share.alias("mapping_confidence"), F.lit("1.0").alias("schema_version"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("modality")),
        "detection": F.struct(event, flag.alias("is_malicious"), share.alias("probability"), F.when(k % 11 != 0, F.array("o_orderpriority")).alias("evidence"), F.lit("m").alias("model_name"), route.alias("next_route")),
        "classification": F.struct(event, share.alias("confidence"), F.when(k % 5 != 0, (k % 3) * 0.5 + 0.25).alias("decision_threshold"), F.when(k % 4 != 0, F.when(k % 19 == 0, "family").otherwise("attack_type")).alias("model_task"), route.alias("next_route")),
        "explanation": F.struct(event, F.col("o_orderpriority").alias("risk_summary"), F.when(k % 11 != 0, F.array("o_orderpriority")).alias("mitigations"), share.alias("confidence"), F.when(k % 3 == 0, "attack_type").when(k % 23 == 0, "family").alias("catalog_scope"), route.alias("next_route")),
        "judge": F.struct(event, flag.alias("approved"), share.alias("final_confidence"), F.when(F.col("o_orderstatus") == "P", "wait").otherwise("approve").alias("action")),
    }
    text = lambda r: F.when(k % 29 == 0, F.lit("[1]")).when(k % 31 == 0, F.left(F.to_json(r), F.lit(9))).otherwise(F.to_json(r))
    texts = o.select("o_orderkey", *(text(r).alias(stage) for stage, r in made.items()))
    return texts.select("o_orderkey", *(F.coalesce(contracts.stage_failure(stage, F.col(stage)), F.lit("good")).alias(stage) for stage in made))


def _stage_outputs_sql() -> str:
    shared = "WHEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN 'not_an_object' WHEN o_orderkey % 17 = 0 THEN 'event_id_missing'"
    share, flag, route = "floor(o_totalprice) > 200000", "o_orderkey % 13 = 0", "o_orderstatus = 'P'"
    rules = {
        "ingest": f"WHEN {flag} THEN 'normalized_missing' WHEN {share} THEN 'mapping_confidence_invalid' WHEN o_orderkey % 7 = 0 THEN 'modality_missing'",
        "detection": f"WHEN {flag} THEN 'is_malicious_missing' WHEN {share} THEN 'probability_invalid' WHEN o_orderkey % 11 = 0 THEN 'evidence_missing' WHEN {route} THEN 'next_route_invalid'",
        "classification": f"WHEN {share} THEN 'confidence_invalid' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 2 THEN 'decision_threshold_invalid' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 19 = 0 THEN 'model_task_invalid' WHEN {route} THEN 'next_route_invalid'",
        "explanation": f"WHEN o_orderkey % 11 = 0 THEN 'mitigations_missing' WHEN {share} THEN 'confidence_invalid' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 23 = 0 THEN 'catalog_scope_invalid' WHEN {route} THEN 'next_route_invalid'",
        "judge": f"WHEN {flag} THEN 'approved_missing' WHEN {share} THEN 'final_confidence_invalid' WHEN {route} THEN 'action_invalid'",
    }
    return "SELECT o_orderkey, " + ", ".join(f"CASE {shared} {r} ELSE 'good' END AS {stage}" for stage, r in rules.items()) + " FROM orders"


def _replies(s, d):
    """Tool replies made of the events' properties: whole objects, with and without a boolean ok, lists, torn texts."""
    k, e = F.col("event_id"), table(s, d, "events")
    rest = F.expr("substring(props, 2)")
    text = F.when(k % 6 == 0, F.concat(F.lit('{"ok":true,'), rest)).when(k % 6 == 1, F.concat(F.lit('{"ok":false,'), rest)).when(k % 6 == 2, F.concat(F.lit('{"ok":"true",'), rest)).when(k % 6 == 3, F.col("props")).when(k % 6 == 4, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.left("props", F.length("props") - 1))
    r = e.select("event_id", contracts.decoded_reply(text).alias("r"))
    return r.select("event_id", "r.ok", F.coalesce("r.error", F.lit("")).alias("error"), F.try_variant_get("r.payload", "$.k", "bigint").alias("k"))


REPLIES_SQL = "SELECT event_id, event_id % 6 = 0 AS ok, CASE event_id % 6 WHEN 2 THEN 'ok_missing' WHEN 3 THEN 'ok_missing' WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'invalid_json' ELSE '' END AS error, CASE WHEN event_id % 6 < 4 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events"


def _taxonomies(s, d):
    """Every version with its classes' hash, and how the labels of the events fare under it."""
    from .scalars import CONV

    fates = None
    for version, name in ((taxonomy.VERSION_16, "taxonomy_resolve"), (taxonomy.VERSION_14, "taxonomy_resolve_14")):
        one = CONV[name][0](s, d).agg(N(), F.count_if(F.col("attack_type").isNotNull()).alias("n_typed"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous")).withColumn("version", F.lit(version))
        fates = one if fates is None else fates.unionByName(one)
    return taxonomy.report(s).drop("n_rules").join(fates, "version")


_CLASS_TEXT = lambda names: "[" + ",".join(f'"{n}"' for n in names) + "]"


def _taxonomies_sql() -> str:
    from .scalars import CONV

    parts = [f"SELECT '{v}' AS version, CAST({len(names)} AS BIGINT) AS n_classes, sha256('{_CLASS_TEXT(names)}') AS sha256, count(*) AS n, count(attack_type) AS n_typed, count(*) FILTER (status = 'ambiguous') AS n_ambiguous FROM ({CONV[q][1]})" for v, names, q in ((taxonomy.VERSION_16, taxonomy.TYPES_16, "taxonomy_resolve"), (taxonomy.VERSION_14, taxonomy.TYPES_14, "taxonomy_resolve_14"))]
    return " UNION ALL ".join(parts)


TAXONOMIES_SQL = _taxonomies_sql()

ALL = {
    "scan_project_rowid": (_csv, "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_id, 'events::' || event_type || '::' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS manifest_id, event_type AS cls, props FROM events"),
    "scan_csv_multiline": (_broken_csv, "SELECT doc_id AS row_id, md5(coalesce(text, '')) AS md5 FROM documents"),
    "manifest_contract_violations": (_manifests, sql(MANIFEST_SQL)),
    "attempts_parse_status": (_attempts, sql(ATTEMPTS_SQL)),
    "jsonl_offset_limit": (_lines, sql("SELECT line, seq, state FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS line FROM v_attempt) WHERE line >= 100 AND seq % 7 <> 0 ORDER BY line LIMIT 50")),
    "sink_selected": (_sink, sql("SELECT class AS dataset, split, count(*) AS n, count(*) FILTER (is_attack) AS n_attack, CAST(sum(manifest_id) AS BIGINT) AS ids FROM v_manifest GROUP BY 1, 2")),
    "file_inventory": (_inventory, "SELECT CAST(length(n_name) + 1 AS BIGINT) AS n_bytes, sha256(n_name || chr(10)) AS sha256 FROM nation"),
    "nested_leak_paths": (lambda s, d: payloads.violations(_nested(s, d), "c_custkey", "js").select("c_custkey", F.array_join("violations", ",").alias("paths")), NESTED_SQL),
    "nested_target_places": (lambda s, d: payloads.target_places(_nested(s, d), "c_custkey", "js").select("c_custkey", F.array_join("places", ",").alias("places")), PLACES_SQL),
    "sanitize_nested": (lambda s, d: _nested(s, d).select("c_custkey", payloads.sanitized(F.col("js")).alias("clean")), CLEAN_SQL),
    "scrub_payload": (lambda s, d: _nested(s, d).select("c_custkey", payloads.sanitized(F.col("js"), payloads.KEYS_ONLY).alias("clean")), SCRUB_SQL),
    "cache_evict": (_evict, sql(", k AS (SELECT DISTINCT fp AS content_hash, sha256(dataset) AS pipeline_hash FROM v_doc), q AS (SELECT fp AS content_hash, sha256(dataset) AS pipeline_hash FROM v_doc WHERE label = 0) SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.content_hash = k.content_hash AND q.pipeline_hash = k.pipeline_hash)")),
    "persist_cases": (_persist, sql(PERSIST_SQL)),
    "case_run": (_run, sql(f", {RUN_SQL} SELECT fc.case_id, trace_n, has_judge, has_classifier, has_mitigator, trace_errors, status, CAST(CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END AS BIGINT) AS n_issues, verdict, n_failed FROM fc JOIN vc ON fc.case_id = vc.case_id")),
    "judge_nested_outputs": (_judged_outputs, OUTPUTS_SQL),
    "batch_stages": (_batch, sql(f", {FLAT_SQL} SELECT profile, count(*) AS n, count(*) FILTER (ingest_abstain) AS n_abstained, count(*) FILTER (NOT ingest_abstain AND det_present) AS n_detected, count(*) FILTER (NOT ingest_abstain AND det_present AND cls_present) AS n_classified FROM flat JOIN v_case ON flat.case_id = v_case.case_id GROUP BY 1")),
    "catalog_reads": (lambda s, d: G.reads(v_cat(s, d), "type", "brand"), sql("SELECT type, count(DISTINCT brand) AS n, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brand FROM v_cat GROUP BY 1")),
    "reference_review": (_review, sql(", l AS (SELECT p_partkey + CASE WHEN p_size = 50 THEN 1000000000 ELSE 0 END AS item_id, CASE WHEN p_size > 5 THEN p_name ELSE ' ' END AS reference FROM part UNION ALL SELECT p_partkey, 'again' FROM part WHERE p_size = 7), g AS (SELECT item_id, count(*) AS n, max(CASE WHEN trim(reference) <> '' THEN 1 END) AS filled FROM l GROUP BY 1) SELECT coalesce(c.item_id, g.item_id) AS item_id, CASE WHEN c.item_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN filled IS NULL THEN 'empty' ELSE 'approved' END AS state FROM v_cat c FULL JOIN g ON c.item_id = g.item_id")),
    "ordered_distinct": (lambda s, d: run.numbered(v_trace(s, d), ["place"]).groupBy("case_id").agg(F.array_join(values.ordered_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "flag"))), lambda x: x["flag"])), ",").alias("flags")), sql(f", sq AS (SELECT case_id, flag, row_number() OVER (PARTITION BY case_id ORDER BY {TRACE_SQL}) AS seq FROM v_trace) SELECT case_id, string_agg(flag, ',' ORDER BY first_seq) AS flags FROM (SELECT case_id, flag, min(seq) AS first_seq FROM sq GROUP BY 1, 2) GROUP BY 1")),
    "origin_features": (_origin, "SELECT c_custkey, key, value FROM (SELECT c_custkey, unnest(['origin.dataset', 'origin.source_dir', 'origin_schema.network_flow']) AS key, unnest([CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) ELSE 'unknown' END, CASE WHEN c_custkey % 2 = 0 THEN 'site_' || c_nationkey ELSE '' END, '1']) AS value FROM customer) WHERE value <> ''"),
    "evidence_snapshot": (_snapshot, "SELECT event_id, concat_ws(',', 'app_proto', 'event_id', CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) > 50 THEN 'packet_count' END, CASE WHEN event_id % 2 = 0 THEN 'service_context' END, CASE WHEN user_id % 3 = 0 THEN 'src_ip' END) AS fields FROM events"),
    "preflight": (_preflight, sql(PREFLIGHT_SQL)),
    "taxonomy_report": (_taxonomies, TAXONOMIES_SQL),
    "case_upsert": (_upsert, sql("SELECT case_id, CASE WHEN status = 'P' THEN 'closed' ELSE status END AS status FROM v_case UNION ALL SELECT s_suppkey + 1000000000, 'open' FROM supplier")),
    "case_conflicts": (lambda s, d: K.conflicts(v_case(s, d), table(s, d, "supplier").select((F.col("s_suppkey") * 4).alias("case_id"), "s_name")), sql("SELECT s_suppkey * 4 AS case_id, s_name FROM supplier WHERE s_suppkey * 4 IN (SELECT case_id FROM v_case)")),
    "fingerprint_features": (_fingerprints, "SELECT o_orderkey, sha256('cust=n' || CAST(CAST(o_custkey % 1000 AS DOUBLE) AS VARCHAR) || '|late=n' || CASE WHEN o_orderstatus = 'F' THEN '1.0' ELSE '0.0' END || '|prio=s' || o_orderpriority) AS fp FROM orders"),
    "stream_breaker": (_breaker, BREAKER_SQL),
    "text_tokens_nfkd": (_nfkd, "SELECT doc_id, md5(array_to_string(regexp_extract_all(strip_accents(lower(replace(coalesce(text, ''), 'ß', 'ss'))), '[a-z0-9]+'), ' ')) AS md5 FROM documents"),
    "train_preparation": (lambda s, d: training.prepared(_training_rows(s, d), "42").groupBy("split", "origin", "label").agg(N()), sql(PREPARED_SQL)),
    "train_metrics": (lambda s, d: training.report(_detector(s, d)), None),
    "model_artifact": (_artifact, None),
    "boosted_classes": (_classes, None),
    "sparse_vectors": (_sparse, SPARSE_SQL),
    "stage_output_contracts": (_stage_outputs, _stage_outputs_sql()),
    "decode_reply": (_replies, REPLIES_SQL),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: o for name, (_, o) in ALL.items() if o}
