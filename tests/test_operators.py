"""Unit tests of functions and operators on literal rows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.functions import contracts, groups, hashing, leak, taxonomy, values
from casewright.operators import audit, campaign, cases, catalog, metrics, payloads, run, sampling, textmetrics, training
from casewright.plans import registry
from casewright.plans.views import v_attempt, v_doc, v_manifest
from casewright.sources import files


def one(spark, column, **row):
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)) if row else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("1_000", 1000.0), ("1d", None), ("0x1p3", None), ("nan", None), (" 1.5 ", 1.5), ("1e13", None), ("true", None), (None, None)])
def test_coerce_number(spark, raw, want):
    assert one(spark, values.coerce_number(F.col("raw")), raw=raw) == want


@pytest.mark.parametrize("name,want", [("id.resp_p", "destination_port"), ("response", "destination_address"), ("admin", "flow_statistics"), ("frame.len", "bytes"), ("conn", "state_flags"), ("zzz", "other")])
def test_feature_group(spark, name, want):
    assert one(spark, groups.feature_group(F.col("name")), name=name) == want


def test_type_is_a_target_offline_only(spark):
    assert not one(spark, leak.is_target_field(F.col("n")), n="type")
    assert one(spark, leak.is_target_field(F.col("n"), offline=True), n="type")


def test_numbers_share_a_fingerprint(spark):
    rows = spark.sql("SELECT map('a', named_struct('num', cast(1 as double), 'str', cast(null as string))) AS f UNION ALL SELECT map('a', named_struct('num', cast(true as double), 'str', cast(null as string))) UNION ALL SELECT map('a', named_struct('num', cast(null as double), 'str', '1'))")
    assert rows.select(hashing.feature_fingerprint(F.col("f")).alias("h")).distinct().count() == 2


def test_forced_ddos_takes_the_service_first(spark):
    r = one(spark, taxonomy.resolve(F.lit("iot23"), F.lit("DDoS"), F.lit(None).cast("string"), F.lit("udp"), F.lit("http")))
    assert (r.status, r.attack_type, r.reason) == ("forced", "DDoS_HTTP", "iot23_ddos_raw_service_http")


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 200), min_size=1, max_size=8))
def test_rounded_matrix_meets_its_sums(counts):
    found = sampling.round_matrix(counts, "s")
    assert all(sum(found[n]) == counts[n] for n in counts)
    total = sum(counts.values())
    columns = [sum(v[j] for v in found.values()) for j in range(3)]
    assert sum(columns) == total and all(abs(columns[j] - total * u / 20) < 1 for j, u in enumerate((14, 3, 3)))
    assert all(abs(found[n][j] - counts[n] * u / 20) < 1 for n in counts for j, u in enumerate((14, 3, 3)))


def test_hamilton_sums_to_its_goal(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "k string, n long")
    rows = sampling.hamilton(counts, [], "k", F.lit(7), "s").collect()
    assert sum(r.quota for r in rows) == 7 and all(abs(r.quota - 7 * r.n / 11) < 1 for r in rows)


def test_balance_is_exact_and_ignores_row_order(spark, data):
    rows = v_manifest(spark, data)
    a = sampling.balance_binary(rows, "7").select("manifest_id")
    b = sampling.balance_binary(rows.repartition(13).orderBy(F.desc("manifest_id")), "7").select("manifest_id")
    assert sorted(a.collect()) == sorted(b.collect())
    assert sampling.balance_check(sampling.balance_binary(rows, "7")).where("not balanced").count() == 0


def test_exact_split_covers_every_row_once(spark, data):
    rows = v_manifest(spark, data)
    parts = sampling.exact_split(rows, "class", "origin", "1", "manifest_id")
    assert parts.count() == rows.count() == parts.select("manifest_id").distinct().count()


def test_dedup_is_idempotent(spark, data):
    docs = v_doc(spark, data)
    kept = campaign.dedup_labelled(docs)
    again = campaign.dedup_labelled(docs.join(kept, "doc_id", "left_semi"))
    assert sorted(kept.collect()) == sorted(again.collect())


def test_upsert_and_conflicts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "case_id int, v string")
    assert sorted(map(tuple, cases.upsert(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.case_id for r in cases.conflicts(old, new).collect()] == [2]


def test_trace_facts(spark):
    rows = [("c", 1, "orchestrator", "ok", 10, 11), ("c", 2, "final_detector", "ok", 12, 11), ("c", 3, "final_standardizer", "error", 9, None)]
    facts = cases.trace_facts(spark.createDataFrame(rows, "case_id string, seq int, agent string, status string, started_us long, finished_us long")).first()
    assert (facts.trace_n, facts.trace_open, facts.trace_negative, facts.trace_time_ok, facts.trace_order_ok, facts.trace_errors, facts.has_judge, facts.has_detector) == (3, 1, 1, False, False, 1, False, True)


def test_score_facts(spark):
    frame = spark.sql("SELECT map('XSS', 0.7D, 'DoS', 0.2D, 'MITM', 0.1D) AS s, 'XSS' AS t")
    facts = frame.select(*(c.alias(k) for k, c in cases.score_facts(F.col("s"), F.col("t")).items())).first()
    assert (facts.top_n, facts.top_label, facts.top_score, facts.top_has_type, facts.top_invalid) == (3, "XSS", 0.7, True, False)


def _anchor(spark, proposals, n_bases=6):
    bases = spark.createDataFrame([("T", k, f"base {k}", "containment") for k in range(1, n_bases + 1)], "type string, base_id long, base_text string, phase string")
    rows = [("c", "T", pos, base, f"text {pos}", False) for pos, base in enumerate(proposals)]
    items = catalog.anchor(spark.createDataFrame(rows, "case_id string, type string, pos long, base_id long, text string, smuggled boolean"), bases)
    ask = spark.createDataFrame([("c", True, False)], "case_id string, wants_review boolean, summary_smuggled boolean")
    return items, catalog.anchor_summary(items, ask).first(), bases


def test_first_five_anchored_sets_a_generic_request_aside(spark):
    items, summary, _ = _anchor(spark, [None, 5, 3, 1, 4, 2], n_bases=5)
    assert (summary.first_five, summary.n_suggested, summary.requires_review) == (True, 1, False)
    assert [r.base_id for r in items.orderBy("item").collect()] == [None, 5, 3, 1, 4, 2]


def test_a_gap_in_the_first_five_keeps_the_review(spark):
    items, summary, bases = _anchor(spark, [2, 3, 4, 5, 6])
    assert (summary.first_five, summary.review_reasons) == (False, "llm_requested_human_review")
    full = items.withColumns({"type": F.lit("T"), "base": F.when(F.col("source") == "llm", F.col("text")), "context_trusted": F.lit(False)})
    assert catalog.output_issues(full, bases).count() == 0
    assert [r.issue for r in catalog.output_issues(full.where("base_id <> 6"), bases).collect()] == ["catalog_mitigation_set_mismatch"]


def test_gray_zone_includes_both_ends(spark):
    rows = spark.createDataFrame([(0.4, True, False), (0.6, True, True), (0.61, True, True)], "prob double, truth boolean, pred boolean")
    m = metrics.selective_metrics(rows).first()
    assert (m.n_abstained, m.tp) == (2, 1)


def test_top_k_keeps_the_order_of_ties(spark):
    frame = spark.sql("SELECT array(named_struct('label', 'b', 'score', 0.5D), named_struct('label', 'a', 'score', 0.5D), named_struct('label', 'c', 'score', 0.9D)) AS s")
    assert [x.label for x in frame.select(metrics.top_k(F.col("s"), 2).alias("t")).first().t] == ["c", "b"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert textmetrics.lcs_length(a, b) == table[-1][-1]


@pytest.mark.parametrize(
    "raw,want",
    [("a=1 label=bad b=2", "a=1 b=2"), ('x label="u v" y', "x y"), ("k type={a:[1,2]} z=2", "k z=2"), ("?label=x&y2=1", "?y2=1"), ('{"label": "x", "n": {"attack": 1, "k": 2}}', '{"n":{"k":2}}'), ("xlabel=1", "xlabel=1"), ("", "")],
)
def test_scrub(raw, want):
    assert textmetrics.scrub(raw) == want


def test_flat_and_nested_sanitizers_agree(spark):
    m = {"label": "x", "v": "ddos", "keep": "1", "threat_x": "2"}
    flat = spark.createDataFrame([(m,)], "m map<string,string>").select(leak.sanitize_flat(F.col("m")).alias("m")).first().m
    assert flat == payloads.pruned(dict(m), payloads.targets(m, payloads.RAW, "row")) == {"keep": "1"}


def test_manifests_and_attempts(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"manifest_id":"a","dataset":"d","content_hash":"h","split":"train","target":{"class":"x","is_attack":true},"row":{"k":"1"}}\n{"manifest_id":"b","dataset":"d","content_hash":"h","split":"dev","target":{"class":"x","is_attack":true},"row":{}}\nnope\n{"manifest_id":"c","dataset":"d","content_hash":"g","split":"val","target":{"class":"x","is_attack":true},"row":{"label":"1"}}\n')
    m = files.read_manifests(spark, str(tmp_path / "m.jsonl"))
    assert sorted(r.violation or "" for r in m.collect()) == ["", "bad_split", "target_in_row", "unparsable"]
    assert files.duplicate_manifests(m.where("manifest_id is not null")).collect()[0].value == "h"


def test_only_an_open_last_line_may_be_torn(spark, tmp_path):
    good = '{"manifest_id":"%s","ok":true,"note":"é"}'
    texts = {"a": [good % 1, '{"manifest_id":"x","ok":tr'], "b": [good % 2, '{"manifest_id":', good % 3, ""], "c": ["\ufeff" + good % 4, "", "  ", good % 5], "d": [good % 6, '{"torn":1', ""], "e": [good % 7, "\ufeff" + good % 8, '{"v": NaN}', "{\r"], "f": ["{"], "g": [""]}
    for name, lines in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "h.jsonl").write_bytes((good % 9).encode() + b"\n" + (good % 10).encode()[:-3])  # ends inside of a letter
    (tmp_path / "i.jsonl").write_bytes(b"\xef\xbb\xbf" + (good % 11).encode() + b'\n{"open')
    found = files.read_attempts(spark, str(tmp_path / "*.jsonl"))
    got = {(r.source_file[-7], r.line): (r.state, r.manifest_id) for r in found.collect()}
    assert got == {
        ("a", 0): ("parsed", "1"), ("a", 1): ("truncated", None), ("b", 0): ("parsed", "2"), ("b", 1): ("corrupt", None), ("b", 2): ("parsed", "3"), ("c", 0): ("parsed", "4"), ("c", 3): ("parsed", "5"), ("d", 0): ("parsed", "6"), ("d", 1): ("corrupt", None),
        ("e", 0): ("parsed", "7"), ("e", 1): ("corrupt", None), ("e", 2): ("corrupt", None), ("e", 3): ("corrupt", None), ("f", 0): ("truncated", None), ("h", 0): ("parsed", "9"), ("h", 1): ("truncated", None), ("i", 0): ("parsed", "11"), ("i", 1): ("truncated", None),
    }
    assert [r.seq for r in found.orderBy("source_file", "line").collect()] == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
    with pytest.raises(ValueError, match="no JSON"):
        files.require_whole(found)
    assert files.require_whole(files.read_attempts(spark, str(tmp_path / "a.jsonl"))).count() == 1


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    lines = [f'{{"k":{k},"pad":"{"x" * (k % 90)}"}}' for k in range(3000)]
    for name, part in (("b", lines[:1700]), ("c", lines[1700:])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = files.read_lines(spark, str(tmp_path), 1500, 400)
        assert [(r.line, r.value) for r in found.orderBy("line").collect()] == [(k, lines[k]) for k in range(1500, 1900)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unverified_rows_are_fatal_where_asked(spark):
    rows = spark.createDataFrame([(1, "h", "A b", "s"), (2, "h", "a", "s"), (3, "h", "a", " "), (4, "h", "a", "s"), (4, "h", "a", "t")], "row_id int, content_hash string, cls string, sub string")
    asked = spark.createDataFrame([(1, "h", "a_B"), (2, "x", "a"), (3, "h", "a"), (4, "h", "a"), (5, "h", "a"), (2, "h", "b")], "row_id int, content_hash string, cls string")
    found = files.recover(asked, rows, label="cls", needed="sub")
    assert sorted((r.row_id, r.state, r["sub"]) for r in found.collect()) == [(1, "verified", "s"), (2, "class_mismatch", None), (2, "hash_mismatch", None), (3, "empty", None), (4, "repeated", None), (5, "missing", None)]
    with pytest.raises(ValueError, match="recovered"):
        files.require_verified(found)
    assert files.require_verified(found.where("row_id = 1")).count() == 1


def test_csv_row_ids_and_inventory(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{k},v{k}\n" for k in range(50)))
    rows = files.scan_csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()
    assert sorted((r.a, r.row_id) for r in rows) == [(k, k) for k in range(50)]
    assert files.inventory_hash(files.inventory(spark, str(tmp_path / "x.csv"))).first().n_files == 1


def test_plans_prune_and_push(spark, data):
    plan = v_attempt(spark, data).where("manifest_id = 3").select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "event_type" not in plan


@pytest.mark.parametrize("stage,text,want", [
    ("ingest", '{"event_id":"e","normalized":true,"mapping_confidence":0,"schema_version":"1","modality":"m"}', None), ("ingest", '{"event_id":"e","normalized":true,"mapping_confidence":1.01,"schema_version":"1","modality":"m"}', "mapping_confidence_invalid"), ("ingest", "7", "not_an_object"), ("ingest", None, "not_an_object"),
    ("detection", '{"event_id":"e","is_malicious":true,"probability":1,"evidence":[],"model_name":"m","next_route":"explain"}', "next_route_invalid"), ("detection", '{"event_id":"e","is_malicious":true,"probability":1,"model_name":"m","next_route":"end"}', "evidence_missing"),
    ("classification", '{"event_id":"e","confidence":0.5,"next_route":"explain"}', None), ("classification", '{"event_id":"e","confidence":0.5,"model_task":"family","next_route":"explain"}', "model_task_invalid"),
    ("explanation", '{"event_id":"e","risk_summary":"","mitigations":[],"confidence":0.5,"next_route":"classify"}', "next_route_invalid"), ("judge", '{"event_id":"e","approved":false,"final_confidence":0,"action":"reject"}', None), ("judge", '{"event_id":"e","approved":false,"final_confidence":0,"action":"stop"}', "action_invalid"),
])
def test_stage_contracts(spark, stage, text, want):
    assert one(spark, contracts.stage_failure(stage, F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [('{"ok":true,"k":1}', (True, None)), ('{"ok":false}', (False, None)), ('{"ok":1}', (False, "ok_missing")), ('{"ok":"true"}', (False, "ok_missing")), ('{"ok":null}', (False, "ok_missing")), ("{}", (False, "ok_missing")), ("[]", (False, "not_an_object")), ("true", (False, "not_an_object")), ("{", (False, "invalid_json")), ("", (False, "invalid_json")), (None, (False, "invalid_json"))])
def test_replies_are_decoded_fail_closed(spark, text, want):
    got = one(spark, contracts.decoded_reply(F.col("t")), t=text)
    assert (got.ok, got.error) == want


def test_blind_references(spark):
    items = spark.createDataFrame([(1, "X", 1, "llm", " base ", "prevention", "ctx"), (1, "X", 2, "llm", "b", None, " "), (2, "Y", 11, "llm", "b2", None, "c"), (3, "X", 1, "catalog", "b", "p", "c")], "case_id long, type string, item int, source string, base string, phase string, context string")
    blank = catalog.template(items)
    assert "context" not in blank.columns and sorted((r.reference_id, r.base, r.phase, r.reference_context, r.status) for r in blank.collect()) == [("1::mitigation::01", "base", "prevention", "", "pending_author_review"), ("2::mitigation::11", "b2", "unknown", "", "pending_author_review")]
    assert {r.problem for r in catalog.reference_problems(blank).collect()} == {"empty"}
    written = blank.withColumn("reference_context", F.lit("text"))
    assert catalog.reference_problems(written).count() == 0 and catalog.review_summary(written).first().status == "pending_author_review"
    twice = written.unionByName(written.limit(1)).unionByName(written.limit(1).withColumn("reference_id", F.lit(""))).unionByName(written.limit(1).withColumns({"reference_id": F.lit("z"), "status": F.lit("?")}))
    assert sorted(r.problem for r in catalog.reference_problems(twice).collect()) == ["duplicate", "missing_id", "unknown_status"]
    done = catalog.approve(written, " me ", "now")
    assert tuple(catalog.review_summary(done).first()) == (2, 2, 2, 2, "approved_by_author") and done.first().reviewer == "me"
    with pytest.raises(ValueError, match="reviewer"):
        catalog.approve(written, " ", "now")


def test_semaphores(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    checks = [("known", True, F.col("x").isNotNull(), 0.0), ("small", False, F.col("x") < 5, 0.4)]
    parts = [audit.assertions(n, r, checks) for n, r in (("fine", rows(1, 2, 9)), ("soft", rows(1, 9)), ("hard", rows(1, None)), ("none", rows()))]
    got = {(r.component, r.check_name): (r.n, r.n_failed, r.broken, r.semaphore) for r in audit.audited(*parts).collect()}
    assert got == {("fine", "known"): (3, 0, False, "green"), ("fine", "small"): (3, 1, False, "green"), ("soft", "known"): (2, 0, False, "amber"), ("soft", "small"): (2, 1, True, "amber"), ("hard", "known"): (2, 1, True, "red"), ("hard", "small"): (2, 1, True, "red"), ("none", "known"): (0, 0, True, "red"), ("none", "small"): (0, 0, False, "red")}


def test_only_full_matches_are_excluded(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    kept, report = campaign.exclude(rows, spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (9, "a"), (4, "d"), (4, "d")], "k int, v string"), "k", ["v"])
    assert {r.k: r.state for r in report.collect()} == {1: "matched", 2: "mismatch", 3: "matched", 9: "unknown", 4: "repeated"} and sorted(r.k for r in kept.collect()) == [2, 4]
    with pytest.raises(ValueError, match="doesn't fit"):
        campaign.require_matched(report)
    campaign.require_matched(report.where("k = 1"))


# The judge, the auditor and the taxonomy against outcomes written out by hand


V = "multidataset_attack_type_v1_2026-09-06"
GOOD = dict(
    n_errors=0, ingest_abstain=False, ingest_review=False, mapping_confidence=0.95, det_present=True, probability=0.97, is_malicious=True, det_abstain=False, cls_present=True, cls_task="attack_type", cls_type="DDoS_TCP", cls_version=V,
    cls_confidence=0.9, cls_threshold=0.65, top_n=3, top_label="DDoS_TCP", top_score=0.9, top_has_type=True, top_invalid=False, exp_present=True, exp_type="DDoS_TCP", exp_version=V, exp_scope="attack_type", exp_catalog_version="4.0",
    exp_catalog_taxonomy=V, exp_compatible=True, exp_source="hybrid", exp_pure=True, exp_review=False, n_catalog_issues=0, trace_n=6, trace_open=0, trace_negative=0, trace_time_ok=True, trace_order_ok=True, trace_errors=0,
    has_judge=True, has_standardizer=True, has_detector=True, has_classifier=True, has_mitigator=True, has_event=True, n_event_leaks=0, n_feature_leaks=0,
)
BENIGN = dict(probability=0.03, is_malicious=False, cls_present=False, cls_task=None, cls_type=None, cls_version=None, cls_confidence=None, cls_threshold=None, top_n=0, top_label=None, top_score=None, top_has_type=False, exp_present=False, exp_type=None, exp_version=None, exp_scope=None, exp_catalog_version=None, exp_catalog_taxonomy=None, exp_source=None, has_classifier=False, has_mitigator=False)
TYPES = {bool: "boolean", int: "int", float: "double", str: "string"}


def flat(spark, *changes):
    rows = [{**GOOD, **c, "case_id": k} for k, c in enumerate(changes)]
    names = ["case_id", *GOOD]
    kind = lambda n: "int" if n == "case_id" else TYPES[type(GOOD[n])]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kind(n)}" for n in names))


JUDGED = [
    ({}, [], "DDoS_TCP", 0.9),
    (BENIGN, [], "benign", 0.97),
    ({"cls_confidence": 0.6499, "top_score": 0.6499}, ["classification_confidence_below_review_threshold"], "DDoS_TCP", 0.6499),
    ({"cls_confidence": 0.65, "top_score": 0.65}, [], "DDoS_TCP", 0.65),
    ({"cls_confidence": 1.5}, ["classification_confidence_invalid", "classification_top_scores_invalid", "classification_confidence_below_review_threshold"], "DDoS_TCP", 0.0),
    ({"cls_confidence": None}, ["classification_confidence_invalid", "classification_top_scores_invalid", "classification_confidence_below_review_threshold"], "DDoS_TCP", 0.0),
    ({**BENIGN, "probability": 0.5, "is_malicious": True, "det_abstain": True}, ["detector_abstained"], None, 0.0),
    ({"n_errors": 1}, ["pipeline_errors_present"], "DDoS_TCP", 0.9),
    ({"cls_threshold": None}, ["classification_threshold_missing"], "DDoS_TCP", 0.9),
    ({"cls_threshold": 1.5}, ["classification_threshold_invalid"], "DDoS_TCP", 0.9),
    ({"cls_threshold": 0.5}, ["classification_threshold_mismatch"], "DDoS_TCP", 0.9),
    ({"cls_version": "v0", "exp_version": "v0", "exp_compatible": False}, ["classification_taxonomy_version_invalid", "mitigation_catalog_taxonomy_version_mismatch"], "DDoS_TCP", 0.9),
    ({"cls_type": "Nope", "top_label": "Nope", "top_invalid": True, "exp_type": "Nope"}, ["classification_attack_type_outside_taxonomy", "classification_top_scores_invalid"], "Nope", 0.9),
    ({"top_n": 2}, ["classification_top_scores_invalid"], "DDoS_TCP", 0.9),
    ({"mapping_confidence": 0.49}, ["mapping_confidence_below_review_threshold"], "DDoS_TCP", 0.9),
    ({"mapping_confidence": 0.5}, [], "DDoS_TCP", 0.9),
    ({"ingest_abstain": True, "mapping_confidence": 0.1}, ["standardizer_abstained"], None, 0.0),
    ({"probability": 0.2}, ["detection_label_probability_mismatch"], "DDoS_TCP", 0.9),
    ({"exp_present": False}, ["malicious_without_mitigation"], "DDoS_TCP", 0.9),
    ({**BENIGN, "cls_present": True, "cls_task": "attack_type", "cls_type": "XSS", "cls_version": V, "cls_confidence": 0.9, "cls_threshold": 0.65, "top_n": 3, "top_label": "XSS", "top_score": 0.9}, ["benign_with_classification"], "benign", 0.97),
    ({"exp_type": "XSS"}, ["mitigation_attack_type_mismatch"], "DDoS_TCP", 0.9),
    ({"exp_scope": "family"}, ["mitigation_catalog_scope_invalid"], "DDoS_TCP", 0.9),
    ({"exp_catalog_version": "3.0"}, ["mitigation_catalog_version_mismatch"], "DDoS_TCP", 0.9),
    ({"exp_review": True}, ["mitigator_requested_human_review"], "DDoS_TCP", 0.9),
]


def test_judge_outcomes(spark):
    got = {r.case_id: r for r in cases.judge(flat(spark, *(c for c, *_ in JUDGED))).collect()}
    for k, (_, issues, label, confidence) in enumerate(JUDGED):
        assert (got[k].issues, got[k].final_label, round(got[k].final_confidence, 6), got[k].action) == (issues, label, confidence, "human_interrupt" if issues else "approve"), JUDGED[k]


#: A change to a clean closed case, and the check that must then fail.
SPOILED = [
    ({"status": "error"}, "consistencia_sin_estado_error"), ({"is_malicious": None}, "consistencia_veredicto_deteccion_presente"), ({"probability": 1.5}, "consistencia_probabilidad_en_rango"), ({"cls_threshold": 0.1}, "consistencia_umbral_clasificacion_operativo"),
    ({"cls_version": "v0"}, "consistencia_version_taxonomia"), ({"cls_type": "Nope"}, "consistencia_tipo_ataque_en_taxonomia"), ({"top_n": 2}, "consistencia_top_scores_tipos"), ({"top_label": "XSS"}, "consistencia_tipo_ataque_vs_top_scores"),
    ({"exp_type": "XSS"}, "consistencia_mitigacion_tipo_ataque"), ({"exp_catalog_version": "0"}, "consistencia_mitigacion_catalogo_tipado"), ({"n_catalog_issues": 1}, "consistencia_contenido_catalogo_tipado"), ({"judge_label": "XSS"}, "consistencia_veredicto_juez_tipo_ataque"),
    ({"trace_n": 0}, "traza_no_vacia"), ({"trace_open": 1}, "traza_entradas_cerradas"), ({"trace_order_ok": False}, "traza_orden_de_agentes"), ({"n_event_leaks": 1}, "leakage_evento_canonico"), ({"n_feature_leaks": 1}, "leakage_features_modelos"), ({"has_judge": False}, "traza_juez_presente"),
]


def closed(spark, *changes):
    own = {"status", "judge_label"}
    frame = flat(spark, *({k: v for k, v in c.items() if k not in own} for c in changes))
    pick = lambda name, default: F.coalesce(*(F.when(F.col("case_id") == k, F.lit(c[name])) for k, c in enumerate(changes) if name in c), F.lit(default))
    return frame.withColumns({"status": pick("status", "completed"), "judge_action": F.lit("approve"), "judge_approved": F.lit(True), "judge_review": F.lit(False), "judge_label": pick("judge_label", "DDoS_TCP"), "judge_confidence": F.lit(0.9)})


def test_auditor_outcomes(spark):
    frame = closed(spark, {}, *(c for c, _ in SPOILED))
    failed = {}
    for r in cases.audit(frame).where("not passed").collect():
        failed.setdefault(r.case_id, set()).add(r.check_name)
    assert 0 not in failed
    assert all(check in failed[k + 1] for k, (_, check) in enumerate(SPOILED))
    verdicts = {r.case_id: r.verdict for r in cases.verdicts(frame).collect()}
    assert verdicts[0] == "approve" and all(verdicts[k + 1] == "reject" for k in range(len(SPOILED)))


#: (dataset, native class, subclass, protocol, service), then status and type in the wide and in the narrow taxonomy.
RESOLVED = [
    (("edge_iiotset", "DDoS_TCP", "", "", ""), ("exact", "DDoS_TCP"), ("exact", "DDoS_TCP")), (("edge_iiotset", "Normal", "", "", ""), ("benign", None), ("benign", None)),
    (("ton_iot", "xss", "", "", ""), ("exact", "XSS"), ("exact", "XSS")), (("ton_iot", "injection", "", "", ""), ("forced", "SQL_injection"), ("ambiguous", None)), (("ton_iot", "scanning", "", "", ""), ("forced", "Port_Scanning"), ("ambiguous", None)),
    (("ton_iot", "dos", "", "", ""), ("exact", "DoS"), ("out_of_taxonomy", None)), (("iot23", "C&C", "", "", ""), ("exact", "Command_and_Control"), ("out_of_taxonomy", None)), (("iot23", "DDoS", "", "udp", ""), ("forced", "DDoS_UDP"), ("ambiguous", None)),
    (("bot_iot", "Reconnaissance", "Service_Scan", "", ""), ("forced", "Port_Scanning"), None), (("bot_iot", "Theft", "", "", ""), ("out_of_taxonomy", None), ("out_of_taxonomy", None)), (("other", "ddos", "", "", ""), ("out_of_taxonomy", None), ("out_of_taxonomy", None)),
]


def test_taxonomy_outcomes(spark):
    frame = spark.createDataFrame([(k, *r[0]) for k, r in enumerate(RESOLVED)], "k int, dataset string, native string, sub string, proto string, service string")
    args = [F.col(c) for c in ("dataset", "native", "sub", "proto", "service")]
    got = {r.k: r for r in frame.select("k", taxonomy.resolve(*args, rules=taxonomy.RULES_16).alias("w"), taxonomy.resolve(*args, rules=taxonomy.RULES_14).alias("n")).collect()}
    for k, (row, wide, narrow) in enumerate(RESOLVED):
        assert (got[k].w.status, got[k].w.attack_type) == wide, row
        assert narrow is None or (got[k].n.status, got[k].n.attack_type) == narrow, row


# Texts, payloads, percentiles, runs


@pytest.mark.parametrize("raw,want", [("[1,2]", None), ("17", None), ('"x"', None), ('[{"k": 1}]', None), ('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('so: {"k": 3} and {"k": 4}', 3), ('so: {"a": "}", "k": 5} end', 5), ("so: {broken} {\"k\": 6}", None), ("{", None), ("", None), (None, None)])
def test_json_object(spark, raw, want):
    assert one(spark, F.try_variant_get(textmetrics.json_object(F.col("t")), "$.k", "int"), t=raw) == want


@pytest.mark.parametrize("raw", ["a=1 label=bad b=2", 'x label="u v" y', "k type={a:[1,2]} z=2", "?label=x&y2=1", '{"label": "x", "n": {"attack": 1, "k": 2}}', "xlabel=1", "", "  spaced   out | | x ;; y ,, z  ", "label=[1, {a: ']'}, 2] end", "a, label=x, , b", '{"t": "class: q rest"}', "{not json label=1}", "&&x?&y", "[1, 2]", "label='open end"])
def test_scrub_column_equals_the_plain_form(spark, raw):
    assert one(spark, textmetrics.scrub_text(F.col("t")), t=raw) == textmetrics.scrub(raw)


def test_payload_policies():
    tree = {"type": "a", "dns": {"type": "b"}, "service_context": {"dns": {"type": "c"}, "x": "ddos"}, "rows": [{"label": "", "v": "ddos"}, "XSS"], "evidence_fields": ["label", "n"]}
    dotted = lambda p: "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in p)[1:]
    found = lambda *a, **k: [dotted(p) for p in payloads.targets(tree, *a, **k)]
    assert found() == ["type", "dns.type", "service_context.x", "rows[0].label", "evidence_fields[0]"]
    assert found(offline=False) == ["service_context.x", "rows[0].label", "evidence_fields[0]"]
    assert found(payloads.KEYS_ONLY) == ["type", "dns.type", "service_context.dns.type", "rows[0].label"]
    assert found(payloads.RAW, "row") == ["type", "dns.type", "service_context.dns.type", "service_context.x", "rows[0].label", "rows[0].v", "rows[1]"]
    own = payloads.Policy(allowed=lambda p: p == "dns.type", values=lambda p: p.startswith("rows"))
    assert found(own) == ["type", "service_context.dns.type", "rows[0].label", "rows[0].v", "rows[1]"]
    assert payloads.pruned(tree, payloads.targets(tree, payloads.KEYS_ONLY)) == {"dns": {}, "service_context": {"dns": {}, "x": "ddos"}, "rows": [{"v": "ddos"}, "XSS"], "evidence_fields": ["label", "n"]}


@pytest.mark.parametrize("raw,want", [('["DDoS","x"]', '["DDoS","x"]'), ('{"app":{"name":"benign"}}', '{"app":{"name":"benign"}}'), ('{"service_context":{"dns":{"type":"A","x": 1}}}', '{"service_context":{"dns":{"x":1}}}'), ('{"t": "label=a b, c", "u": "[{\\"label\\": 1}]"}', '{"t":"c","u":"[{}]"}'), ('{ "a" : 1 }', '{ "a" : 1 }')])
def test_scrubbing_takes_names_only(raw, want):
    assert payloads.scrub(raw) == want


@pytest.mark.parametrize("raw,want", [('{"row":{"query_class":"A","note":"DDoS","type":"x"}}', '{"row":{"query_class":"A"}}'), ('{"service_context":{"dns":{"type":"xss"}},"text":"MITM"}', '{"service_context":{"dns":{}}}'), ('{"icmp_type":3,"other":"ddos"}', '{"icmp_type":3,"other":"ddos"}')])
def test_raw_inputs_keep_technical_fields(raw, want):
    assert payloads.cleaned(raw, payloads.RAW) == want


VIOLATIONS = [
    ('{"label":"x","n":{"threat":0,"class":null,"family":[],"y":""}}', ["field:label", "field:n.threat"]),
    ('{"attack_indicators":["a"],"service_context":{"protocol_family":"x"},"other":{"protocol_family":"x"}}', ["field:other.protocol_family"]),
    ('{"evidence_fields":["label","bytes"],"feature_groups":{"flow":["y",["attack"]],"n":"label"},"lists":["label"]}', ["column:evidence_fields[0]", "column:feature_groups.flow[0]", "column:feature_groups.flow[1][0]"]),
    ('{"host":"DDoS","telemetry":{"a":[{"b":"SQL injection"},7]},"items":["xss"],"app_proto":"benign","hosts":"ddos"}', ["value:app_proto", "value:host", "value:telemetry.a[0].b"]),
    ('{"semantic_text":"seen label=1","anomaly_summary":{"x":["type: dos"]},"note":"label=1"}', ["text:anomaly_summary.x[0]", "text:semantic_text"]),
    ('[{"label":1}]', ["field:[0].label"]), ('{"a.b":{"label":true}}', ["field:a.b.label"]), ("not json", []), ('"label=1"', []), ("{}", []), (None, []),
]


def test_scrub_text_query_reads_whole_texts(spark, tmp_path):
    texts = ["w " * 150 + "label=bad end", "w " * 3000 + 'attack="x y" end', "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.clean for r in registry.queries()["scrub_text"](spark, str(tmp_path)).collect()}
    assert got == {k: payloads.scrub(f'a=1 label="x y", {t} type={{a:[1,2]}} z=2') for k, t in enumerate(texts)}
    assert all("bad" not in c and "x y" not in c for c in got.values()) and all(c.count("w ") >= n for c, n in zip((got[0], got[1]), (149, 2999), strict=True))


def test_canonical_violations_in_the_jvm(spark):
    rows = spark.createDataFrame([(k, js) for k, (js, _) in enumerate(VIOLATIONS)], "k long, js string")
    found = payloads.violations(rows, "k", "js")
    assert {r.k: r.violations for r in found.collect()} == {k: want for k, (_, want) in enumerate(VIOLATIONS)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "UnionLoop" in plan
    loose = payloads.violations(rows, "k", "js", allowed=lambda p: F.lit(True), values=lambda p: F.lit(True))
    assert {r.k: r.violations for r in loose.collect()}[3] == ["value:app_proto", "value:host", "value:hosts", "value:items[0]", "value:telemetry.a[0].b"]
    deep = '{"a":' * 60 + '{"label":[1]}' + "}" * 60
    one_row = spark.createDataFrame([(1, deep)], "k long, js string")
    assert payloads.violations(one_row, "k", "js").first().violations == ["field:" + "a." * 60 + "label"]
    places = payloads.target_places(rows, "k", "js")
    assert {r.k: r.places for r in places.collect()}[0] == ["label", "n.class", "n.family", "n.threat", "n.y"]


def test_heavy_tails_are_no_one_bin(spark):
    rng = __import__("random").Random(3)
    values = [rng.random() for _ in range(3000)] + [1e12, -1e300, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    import numpy as np

    for most in (0, 65_536):
        assert np.allclose(metrics.percentiles(rows, [], "v", [0.0, 0.25, 0.5, 0.999, 1.0], most=most).first().q, np.quantile(values, [0.0, 0.25, 0.5, 0.999, 1.0]), rtol=1e-12)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.floats(-50, 50, allow_nan=False).map(lambda x: round(x, 1)))), min_size=1, max_size=60), st.sampled_from([0, 65_536]))
def test_percentiles_against_numpy(spark, rows, most):
    import numpy as np

    got = {r.g: r.q for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.05, 0.5, 0.95, 1.0], most=most).collect()}
    want = {g: np.quantile(v, [0.0, 0.05, 0.5, 0.95, 1.0]) for g in "ab" if (v := [x for k, x in rows if k == g and x is not None])}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)


def test_traces_grow_and_persistence_stops_at_the_first_failure(spark):
    frame = run.traced(flat(spark, {}, {"ingest_abstain": True}, {"n_errors": 1}), F.lit(1000))
    got = {r.case_id: [(t.seq, t.agent, t.status) for t in r.trace] for r in frame.collect()}
    assert [a for _, a, _ in got[0]] == list(cases.STAGES) and [n for n, _, _ in got[0]] == [1, 2, 3, 4, 5, 6]
    assert [a for _, a, _ in got[1]] == ["orchestrator", "final_standardizer", "final_judge"] and got[2][1][2] == "error"
    facts = run.with_trace_facts(frame).where("case_id = 0").first()
    assert (facts.trace_n, facts.trace_time_ok, facts.trace_order_ok, facts.has_mitigator) == (6, True, True, True)
    results = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "open"), (4, "error")], "case_id int, status string")
    traces = spark.createDataFrame([(1, 1, "final_judge"), (2, 1, "final_judge"), (2, 2, "nobody"), (2, 3, "final_judge"), (3, 1, "final_judge"), (9, 1, "x")], "case_id int, seq int, agent string")
    out = run.persist(spark.createDataFrame([(1,)], "case_id int"), results, traces, cases.STAGES).orderBy("case_id").collect()
    assert [tuple(r) for r in out] == [(1, "create_case", None, 0), (2, "append_trace", "open", 1), (3, "update_case", "open", 1), (4, None, "error", 0)]


def test_training_rejects_classes_that_training_lacks(spark):
    rows = spark.createDataFrame([(1, "a", True, "train"), (2, "b", False, "val"), (3, "b", False, "test")], "doc_id int, fp string, label boolean, split string")
    assert sorted((r.problem, r.value) for r in training.problems(rows).collect()) == [("split_overlap", "b"), ("unseen_class", "false")]


def test_csv_fields_with_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines, ""quoted"""\n2,plain\n')
    rows = files.scan_csv(spark, str(tmp_path / "x.csv"), "a int, b string", multi_line=True).collect()
    assert sorted((r.row_id, r.b) for r in rows) == [(0, 'two\nlines, "quoted"'), (1, "plain")]
