"""Queries over manifests, attempts and document records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.operators import campaign as C
from casewright.operators import metrics as M
from casewright.session import checkpoint_dir, table
from casewright.sources import files

from .views import sql, v_attempt, v_doc, v_manifest

R = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1)).alias("n")
LATEST_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY seq DESC) AS rn FROM v_attempt) WHERE rn = 1"


def _known(s, d):
    """Manifests of which every third has another id, so that some attempts are orphans."""
    return v_manifest(s, d).withColumn("manifest_id", F.col("manifest_id") + F.when(F.col("manifest_id") % 3 == 0, 100000000).otherwise(0))


def _quality(s, d):
    q = C.quality_report(v_manifest(s, d), v_attempt(s, d))
    return q.select("origin", *(c for c in q.columns if c.startswith("n_")), *(R(F.col(c)).alias(c) for c in ("mean_confidence", "min_confidence", "max_confidence", "coverage", "success_ratio")))


def _rounds(s, d):
    """New successes of each day and whether the day brought none."""
    a = v_attempt(s, d).where("ok and llm").groupBy("manifest_id").agg(F.min("ts").alias("first"))
    per = a.groupBy(F.date_format(F.date_trunc("day", "first"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_new"))
    days = v_attempt(s, d).select(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).distinct()
    return days.join(per, "day", "left").select("day", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.col("n_new").isNull().alias("no_progress"))


def _live(s, d):
    a = v_attempt(s, d)
    out = a.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok")).alias("n_ok"), F.count_if(F.col("ok") & F.col("llm")).alias("n_model"), F.avg("confidence").alias("mc"), F.min("latency").alias("lo"), F.max("latency").alias("hi"))
    out = out.join(M.percentiles(a, [], "latency", [0.5, 0.95]), F.lit(True), "left")  # one row each
    return out.select("n", "n_ok", "n_model", R(C.safe_ratio(F.col("n_model"), F.col("n"))).alias("micro_coverage"), R("mc").alias("mean_confidence"), R("lo").alias("latency_min"), R(F.col("q")[0]).alias("latency_median"), R(F.col("q")[1]).alias("latency_p95"), R("hi").alias("latency_max"))


def _lat(s, d):
    return M.confidence_summary(v_attempt(s, d), "provider", value="latency").select("provider", "n", *(R(F.col(c)).alias(c) for c in ("mean", "lo", "p05", "median", "p95", "hi")))


def _cache(s, d):
    return C.first_wins(v_attempt(s, d).where("ok"), ["manifest_id", "state"], "seq").select("manifest_id", "state", "seq", R("latency").alias("latency"))


def _cache_lookup(s, d):
    a = v_attempt(s, d)
    stored = C.first_wins(a.where("ok and seq % 2 = 0"), ["manifest_id", "state"], "seq").select("manifest_id", "state", F.col("seq").alias("hit"))
    return a.join(stored, ["manifest_id", "state"], "left").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNotNull()).alias("n_hit"), F.countDistinct("hit").alias("n_entries"))


def _label_rows(s, d):
    c = table(s, d, "customer").select(F.lit("customer").alias("dataset"), F.when(F.col("c_acctbal") < 0, "attack").when(F.col("c_acctbal") < 1000, None).otherwise("normal").alias("cls"))
    p = table(s, d, "supplier").select(F.lit("supplier").alias("dataset"), F.when(F.col("s_acctbal") < 0, "attack").otherwise("normal").alias("cls"))
    return c.unionByName(p, allowMissingColumns=True).where("cls is not null").groupBy("dataset", "cls").agg(N())


def _composition(s, d):
    parts = [table(s, d, t).select(F.lit(t).alias("source")) for t in ("customer", "supplier", "part")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(N())


def _recover(s, d):
    """The customers of all orders, by number, hash and class, against a scan of CSV files; some requests name another hash, another class or a number that isn't there."""
    path = f"{checkpoint_dir(s)}/customers-csv-{uuid.uuid4().hex}"
    table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 83 == 0, " ").otherwise(F.col("c_nationkey").cast("string")).alias("subclass")).write.option("header", True).option("escape", '"').csv(path)
    rows = files.scan_csv(s, f"{path}/*.csv", "c_custkey bigint, c_name string, cls string, subclass string", id_column="c_custkey")
    rows = rows.select("row_id", F.sha2("c_name", 256).alias("content_hash"), "cls", "subclass")
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    asked = o.join(c, o["o_custkey"] == c["c_custkey"]).select((F.col("o_custkey") + F.when(k % 97 == 0, 100000000).otherwise(0)).alias("row_id"), F.sha2(F.when(k % 89 == 0, "other").otherwise(name), 256).alias("content_hash"), F.when(k % 79 == 0, "none").otherwise(F.lower("c_mktsegment")).alias("cls"))
    return files.recover(asked, rows, label="cls", needed="subclass").groupBy("state", "subclass").agg(N())


RECOVER_SQL = "WITH r AS (SELECT o_orderkey AS k, c_custkey, c_name, c_nationkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey), q AS (SELECT CASE WHEN k % 97 = 0 THEN 'missing' WHEN c_custkey % 83 = 0 THEN 'empty' WHEN k % 89 = 0 OR c_name <> 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') THEN 'hash_mismatch' WHEN k % 79 = 0 THEN 'class_mismatch' ELSE 'verified' END AS state, CAST(c_nationkey AS VARCHAR) AS nation FROM r) SELECT state, CASE WHEN state = 'verified' THEN nation END AS subclass, count(*) AS n FROM q GROUP BY 1, 2"


def _protocol(s, d):
    """Protocol and service of every event from manifest lines, whatever the case of a row's names; some lines have another hash or dataset, no row, come twice or not at all."""
    path = f"{checkpoint_dir(s)}/context-{uuid.uuid4().hex}"
    e, k = table(s, d, "events"), F.col("event_id")
    row = F.map_filter(F.create_map(F.when(k % 2 == 0, "Proto").otherwise("PROTO"), F.when(k % 3 == 0, F.upper("event_type")).when(k % 3 == 1, F.lit(" ")), F.lit("Protocol"), F.when(k % 5 == 0, F.lit("tcp")), F.lit("SERVICE"), F.regexp_extract("props", "([0-9]+)", 1)), lambda n, v: v.isNotNull())
    line = F.to_json(F.struct(k.cast("string").alias("manifest_id"), F.when(k % 41 == 0, "other").otherwise("Events").alias("dataset"), F.sha2(F.when(k % 43 == 0, F.lit("x")).otherwise(k.cast("string")), 256).alias("content_hash"), F.when(k % 47 != 0, row).alias("row")))
    e.where(k % 37 != 0).select(F.explode(F.array_repeat(line, F.when(k % 53 == 0, 2).otherwise(1))).alias("value")).write.text(path)
    asked = e.select(k.cast("string").alias("manifest_id"), F.sha2(k.cast("string"), 256).alias("content_hash"), F.lit("events").alias("dataset"))
    found = files.recover_context(asked, files.read_manifests(s, path))
    return found.groupBy("state", F.coalesce(F.lower("proto"), F.lit("(none)")).alias("proto")).agg(N(), F.countDistinct("service").alias("n_services"))


PROTOCOL_SQL = "WITH q AS (SELECT CASE WHEN event_id % 37 = 0 THEN 'missing' WHEN event_id % 53 = 0 THEN 'repeated' WHEN event_id % 43 = 0 THEN 'hash_mismatch' WHEN event_id % 41 = 0 THEN 'dataset_mismatch' WHEN event_id % 47 = 0 THEN 'row_missing' ELSE 'verified' END AS state, CASE WHEN event_id % 3 = 0 THEN lower(event_type) WHEN event_id % 5 = 0 THEN 'tcp' END AS proto, regexp_extract(props, '([0-9]+)', 1) AS service FROM events) SELECT state, CASE WHEN state = 'verified' THEN coalesce(proto, '(none)') ELSE '(none)' END AS proto, count(*) AS n, count(DISTINCT CASE WHEN state = 'verified' THEN service END) AS n_services FROM q GROUP BY 1, 2"


def _candidates(s, d):
    from pyspark.sql import Window

    j = C.campaign_join(v_manifest(s, d), v_attempt(s, d)).where("confidence >= 0.2")
    w = Window.partitionBy("class").orderBy(F.desc("confidence"), "manifest_id")
    return j.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 5").select("class", "manifest_id", "confidence", "rn")


def _mapping(s, d):
    m = v_manifest(s, d).withColumn("status", F.when(F.col("class").isin("BUILDING", "MACHINERY"), "exact").when(F.col("class") == "FURNITURE", "forced").otherwise("ambiguous"))
    return m.groupingSets([["status"], ["origin", "class"], ["status", "class"]], "status", "origin", "class").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def _sidecar(s, d):
    docs = v_doc(s, d)
    gone = C.removed_groups(docs).select("fp", "reason")
    mapped = docs.withColumn("status", F.when(F.col("label").isNull(), "rejected").otherwise("mapped"))
    return mapped.join(gone, "fp", "left").groupBy("status", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(N())


def _universe(s, d):
    docs = v_doc(s, d)
    mapped, rejected = docs.where("label is not null"), docs.where("label is null")
    both = mapped.unionByName(rejected).withColumn("label", F.concat_ws(":", F.coalesce(F.col("label").cast("string"), F.lit("none")), "dataset"))
    return C.dedup_labelled(both)


def _cross_class(s, d):
    rank = F.when(F.col("dataset") == "en", 0).when(F.col("dataset") == "fr", 1).when(F.col("dataset") == "de", 2).otherwise(3)
    return C.first_class(v_doc(s, d).select("fp", "dataset", "doc_id"), "fp", rank, "doc_id").select("fp", "dataset", "doc_id")


def _exclusion(s, d):
    """Manifests without a curated list, whose entries name number and class; some entries name another class, a number that isn't there, or come twice."""
    n = F.col("s_suppkey")
    m = v_manifest(s, d)
    named = table(s, d, "supplier").select((n * 11).alias("manifest_id")).join(m.select("manifest_id", "class"), "manifest_id", "left")
    listed = named.select("manifest_id", F.when(F.col("manifest_id") % 3 == 0, "OTHER").otherwise(F.coalesce("class", F.lit("NONE"))).alias("class"))
    twice = listed.where("manifest_id % 5 = 0")
    kept, report = C.exclude(m, listed.unionByName(twice), "manifest_id", ["class"])
    return kept.groupBy(F.lit("kept").alias("part"), F.col("class").alias("name")).agg(N()).unionByName(report.groupBy(F.lit("entry").alias("part"), F.col("state").alias("name")).agg(N()))


EXCLUSION_SQL = ", l AS (SELECT s_suppkey * 11 AS id, class, manifest_id IS NOT NULL AS known FROM supplier LEFT JOIN v_manifest ON manifest_id = s_suppkey * 11), e AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'repeated' WHEN NOT known THEN 'unknown' WHEN id % 3 = 0 THEN 'mismatch' ELSE 'matched' END AS state FROM l) SELECT 'kept' AS part, class AS name, count(*) AS n FROM v_manifest WHERE manifest_id NOT IN (SELECT id FROM e WHERE state = 'matched') GROUP BY 2 UNION ALL SELECT 'entry', state, count(*) FROM e GROUP BY 2"


DOC_GROUPS = "g AS (SELECT fp, count(*) AS n, min(doc_id) AS keeper, min(split) <> max(split) AS cross_split, coalesce(min(label) <> max(label), false) AS conflict FROM v_doc GROUP BY fp)"

ALL = {
    "orphan_attempts": (lambda s, d: C.orphans(v_attempt(s, d), _known(s, d)).groupBy("manifest_id").agg(N()), sql("SELECT manifest_id, count(*) AS n FROM v_attempt WHERE manifest_id NOT IN (SELECT manifest_id + CASE WHEN manifest_id % 3 = 0 THEN 100000000 ELSE 0 END FROM v_manifest) GROUP BY 1")),
    "latest_attempt": (lambda s, d: C.latest(v_attempt(s, d), ["manifest_id"]).select("manifest_id", "seq", "state", R("latency").alias("latency")), sql(f"SELECT manifest_id, seq, state, round(latency, 6) AS latency FROM ({LATEST_SQL})")),
    "latest_valid_by_backend": (lambda s, d: C.latest(v_attempt(s, d), ["manifest_id", "provider"], where=F.col("ok") & F.col("llm")).select("manifest_id", "provider", "seq"), sql("SELECT manifest_id, provider, max(seq) AS seq FROM v_attempt WHERE ok AND llm GROUP BY 1, 2")),
    "campaign_status": (lambda s, d: C.terminal_state(v_attempt(s, d)).groupBy("state").agg(N(), F.sum("n_attempts").alias("n_attempts")), sql("SELECT state, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_attempts FROM (SELECT manifest_id, CASE WHEN bool_or(ok AND llm) THEN 'success' ELSE arg_max(state, seq) END AS state, count(*) AS k FROM v_attempt GROUP BY 1) GROUP BY 1")),
    "cache_insert_first_wins": (_cache, sql("SELECT manifest_id, state, seq, round(latency, 6) AS latency FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, state ORDER BY seq) AS rn FROM v_attempt WHERE ok) WHERE rn = 1")),
    "cache_lookup": (_cache_lookup, sql("SELECT a.state, count(*) AS n, count(c.hit) AS n_hit, count(DISTINCT c.hit) AS n_entries FROM v_attempt a LEFT JOIN (SELECT manifest_id, state, min(seq) AS hit FROM v_attempt WHERE ok AND seq % 2 = 0 GROUP BY 1, 2) c ON a.manifest_id = c.manifest_id AND a.state = c.state GROUP BY 1")),
    "distinct_misses": (lambda s, d: v_attempt(s, d).where("not ok or not llm").select("manifest_id", "provider").dropDuplicates(), sql("SELECT DISTINCT manifest_id, provider FROM v_attempt WHERE NOT (ok AND llm)")),
    "failure_runs": (lambda s, d: C.failure_runs(v_attempt(s, d), "manifest_id"), sql("SELECT manifest_id, max(len) AS longest, count(*) AS n_runs FROM (SELECT manifest_id, island, count(*) AS len FROM (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY manifest_id ORDER BY seq) AS island FROM v_attempt) WHERE NOT ok GROUP BY 1, 2) GROUP BY 1")),
    "progress_rounds": (_rounds, sql("SELECT day, coalesce(n_new, 0) AS n_new, n_new IS NULL AS no_progress FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM v_attempt) LEFT JOIN (SELECT strftime(first, '%Y-%m-%d') AS day, count(*) AS n_new FROM (SELECT manifest_id, min(ts) AS first FROM v_attempt WHERE ok AND llm GROUP BY 1) GROUP BY 1) USING (day)")),
    "latency_percentiles": (_lat, sql("SELECT provider, count(*) AS n, round(avg(latency), 6) AS mean, round(min(latency), 6) AS lo, round(quantile_cont(latency, 0.05), 6) AS p05, round(quantile_cont(latency, 0.5), 6) AS median, round(quantile_cont(latency, 0.95), 6) AS p95, round(max(latency), 6) AS hi FROM v_attempt GROUP BY 1")),
    "live_run_summary": (_live, sql("SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (ok AND llm) AS n_model, round(count(*) FILTER (ok AND llm) / count(*), 6) AS micro_coverage, round(avg(confidence), 6) AS mean_confidence, round(min(latency), 6) AS latency_min, round(quantile_cont(latency, 0.5), 6) AS latency_median, round(quantile_cont(latency, 0.95), 6) AS latency_p95, round(max(latency), 6) AS latency_max FROM v_attempt")),
    "campaign_join": (lambda s, d: C.campaign_join(v_manifest(s, d), v_attempt(s, d), "Alpha").select("manifest_id", "class", "origin", "split", "seq", "confidence"), sql("SELECT m.manifest_id, class, origin, split, seq, confidence FROM v_manifest m JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY seq DESC) AS rn FROM v_attempt WHERE ok AND llm AND provider = 'alpha') WHERE rn = 1) a ON m.manifest_id = a.manifest_id")),
    "unmatched_reason": (lambda s, d: C.unmatched_reason(v_manifest(s, d), v_attempt(s, d).withColumn("manifest_id", F.col("manifest_id") + F.when(F.col("seq") % 3 != 0, 100000000).otherwise(0)), "alpha").groupBy("reason").agg(N()), sql("SELECT CASE WHEN mine = 1 THEN 'usable' WHEN mine = 0 THEN 'provider_mismatch' ELSE 'missing' END AS reason, count(*) AS n FROM v_manifest m LEFT JOIN (SELECT manifest_id, max(CAST(provider = 'alpha' AS INT)) AS mine FROM (SELECT * REPLACE (manifest_id + CASE WHEN seq % 3 <> 0 THEN 100000000 ELSE 0 END AS manifest_id) FROM v_attempt) WHERE ok AND llm GROUP BY 1) a ON m.manifest_id = a.manifest_id GROUP BY 1")),
    "pending_work": (lambda s, d: C.pending(v_manifest(s, d), v_attempt(s, d), retry_failures=True).select("manifest_id"), sql("SELECT manifest_id FROM v_manifest WHERE manifest_id NOT IN (SELECT manifest_id FROM v_attempt WHERE ok AND llm)")),
    "quality_report": (_quality, sql(f", j AS (SELECT m.*, a.seq, a.ok, a.llm, a.confidence FROM v_manifest m LEFT JOIN ({LATEST_SQL}) a ON m.manifest_id = a.manifest_id) SELECT coalesce(origin, '(all)') AS origin, count(*) AS n_manifests, count(seq) AS n_attempted, count(*) FILTER (ok AND llm) AS n_model_ok, count(*) FILTER (seq IS NOT NULL AND NOT ok) AS n_failed, count(*) FILTER (is_attack) AS n_attack, count(DISTINCT class) AS n_classes, round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence, round(count(seq) / count(*), 6) AS coverage, round(coalesce(count(*) FILTER (ok AND llm) / nullif(count(seq), 0), 0), 6) AS success_ratio FROM j GROUP BY ROLLUP (origin)")),
    "corpus_composition": (_composition, "SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part"),
    "records_for": (lambda s, d: v_manifest(s, d).where("origin = 'ASIA' and split = 'test'").select("manifest_id", "class", "detail"), sql("SELECT manifest_id, class, detail FROM v_manifest WHERE origin = 'ASIA' AND split = 'test'")),
    "label_rows": (_label_rows, "SELECT * FROM (SELECT 'customer' AS dataset, CASE WHEN c_acctbal < 0 THEN 'attack' WHEN c_acctbal < 1000 THEN NULL ELSE 'normal' END AS cls, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', CASE WHEN s_acctbal < 0 THEN 'attack' ELSE 'normal' END, count(*) FROM supplier GROUP BY 2) WHERE cls IS NOT NULL"),
    "recover_subclass_join": (_recover, RECOVER_SQL),
    "recover_protocol_context": (_protocol, PROTOCOL_SQL),
    "candidate_selection": (_candidates, sql(", j AS (SELECT m.class, m.manifest_id, a.confidence FROM v_manifest m JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY seq DESC) AS k FROM v_attempt WHERE ok AND llm) WHERE k = 1) a ON m.manifest_id = a.manifest_id WHERE a.confidence >= CAST(0.2 AS DOUBLE)) SELECT class, manifest_id, confidence, rn FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY confidence DESC, manifest_id) AS rn FROM j) WHERE rn <= 5")),
    "support_report": (lambda s, d: C.support_report(v_manifest(s, d)).select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("origin", F.lit("*")).alias("origin"), "n", "n_attack", "level", "balanced"), sql("SELECT coalesce(split, '*') AS split, coalesce(origin, '*') AS origin, count(*) AS n, count(*) FILTER (is_attack) AS n_attack, CAST(GROUPING(split, origin) AS BIGINT) AS level, count(*) FILTER (is_attack) * 2 = count(*) AS balanced FROM v_manifest GROUP BY CUBE (split, origin)")),
    "class_availability": (lambda s, d: v_doc(s, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fp").alias("n_distinct")), sql("SELECT dataset, count(*) AS n, count(DISTINCT fp) AS n_distinct FROM v_doc GROUP BY 1")),
    "mapping_report": (_mapping, sql(", m AS (SELECT *, CASE WHEN class IN ('BUILDING', 'MACHINERY') THEN 'exact' WHEN class = 'FURNITURE' THEN 'forced' ELSE 'ambiguous' END AS status FROM v_manifest) SELECT status, origin, class, count(*) AS n, CAST(GROUPING(status, origin, class) AS BIGINT) AS level FROM m GROUP BY GROUPING SETS ((status), (origin, class), (status, class))")),
    "mapping_sidecar": (_sidecar, sql(f", {DOC_GROUPS} SELECT CASE WHEN label IS NULL THEN 'rejected' ELSE 'mapped' END AS status, CASE WHEN conflict THEN 'conflicting_labels' WHEN cross_split THEN 'cross_split' WHEN g.n > 1 THEN 'same_split_duplicate' ELSE 'kept' END AS outcome, count(*) AS n FROM v_doc JOIN g USING (fp) GROUP BY 1, 2")),
    "rejected_support": (lambda s, d: v_doc(s, d).where("label is null").groupBy("dataset", "source", "split", F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("size")).agg(N()), sql("SELECT dataset, source, split, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size, count(*) AS n FROM v_doc WHERE label IS NULL GROUP BY ALL")),
    "holdout_overlap": (lambda s, d: v_doc(s, d).where("split = 'train'").select("fp").distinct().join(v_doc(s, d).where("split = 'test'").select("fp").distinct(), "fp", "left_semi").agg(F.count(F.lit(1)).alias("n_overlap")), sql("SELECT count(*) AS n_overlap FROM (SELECT fp FROM v_doc WHERE split = 'train' INTERSECT SELECT fp FROM v_doc WHERE split = 'test')")),
    "curated_exclusion": (_exclusion, sql(EXCLUSION_SQL)),
    "unused_records": (lambda s, d: v_manifest(s, d).select("manifest_id").exceptAll(v_attempt(s, d).select("manifest_id").distinct()), sql("SELECT manifest_id FROM v_manifest EXCEPT SELECT manifest_id FROM v_attempt")),
    "dedup_strict": (lambda s, d: C.dedup_strict(v_doc(s, d)), sql("SELECT dataset, fp, outcome, CASE WHEN outcome = 'kept' THEN keeper END AS keeper FROM (SELECT dataset, fp, min(doc_id) AS keeper, CASE WHEN coalesce(min(label) <> max(label), false) THEN 'violation' WHEN min(split) <> max(split) THEN 'dropped' ELSE 'kept' END AS outcome FROM v_doc GROUP BY 1, 2)")),
    "dedup_labelled": (lambda s, d: C.dedup_labelled(v_doc(s, d)), sql(f", {DOC_GROUPS} SELECT keeper AS doc_id FROM g WHERE NOT cross_split AND NOT conflict")),
    "dedup_universe": (_universe, sql("SELECT min(doc_id) AS doc_id FROM (SELECT *, coalesce(CAST(label AS VARCHAR), 'none') || ':' || dataset AS sup FROM v_doc) GROUP BY fp HAVING min(split) = max(split) AND min(sup) = max(sup)")),
    "dedup_removed_groups": (lambda s, d: C.removed_groups(v_doc(s, d)), sql(f", {DOC_GROUPS} SELECT fp, n, CASE WHEN conflict THEN 'conflicting_labels' WHEN cross_split THEN 'cross_split' ELSE 'same_split_duplicate' END AS reason FROM g WHERE conflict OR cross_split OR n > 1")),
    "cross_class_dedup": (_cross_class, sql("SELECT fp, dataset, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY CASE dataset WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, doc_id) AS rn FROM v_doc) WHERE rn = 1")),
    "cross_split_overlap": (lambda s, d: C.cross_split_overlap(v_doc(s, d)), sql(f", {DOC_GROUPS} SELECT count(*) FILTER (cross_split) AS n_overlap, count(*) AS n_fingerprints FROM g")),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: o for name, (_, o) in ALL.items()}
