"""Queries over seeded selections and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import metrics as M
from casewright.operators import sampling as S

from .views import CLASSES, sql, v_doc, v_manifest, v_multi, v_score

R = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1)).alias("n")
SEED = "42"
H = lambda key, seed=SEED: f"sha256('{seed}|' || {key})"


def hamilton_sql(source: str, by: str, name: str, goal: str) -> str:
    """Largest remainder over ``source`` (by, name, n, goal)."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"SELECT {lead}{name}, n, CAST(base + CASE WHEN row_number() OVER ({part} ORDER BY rem DESC, {H(name)}, {name}) <= goal - sum(base) OVER ({part}) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT *, {goal} * n - base * total AS rem FROM (SELECT *, CAST({goal} * n // total AS BIGINT) AS base, {goal} AS goal FROM (SELECT *, sum(n) OVER ({part}) AS total FROM {source})))"


def _hamilton(s, d):
    counts = v_manifest(s, d).groupBy("origin", "class").agg(N())
    return S.hamilton(counts, ["origin"], "class", F.lit(100), SEED)


def _sweep(s, d):
    return M.threshold_sweep(v_multi(s, d)).select("k", "n_decided", "n_wrong", R("coverage").alias("coverage"), R("risk").alias("risk"))


def _choice(s, d):
    return M.threshold_choice(M.threshold_sweep(v_multi(s, d)), 0.05, 0.5).select("k", "n_decided", R("coverage").alias("coverage"), R("risk").alias("risk"), "feasible")


def _scores(s, d):
    """Score vectors over the five classes, three of which tie for some rows."""
    m = v_multi(s, d)
    score = lambda k: F.when(F.col("pred") == CLASSES[k], F.col("conf")).otherwise(F.lit((k % 2) * 0.05))
    return m.withColumn("scores", F.array(*(F.struct(F.lit(c).alias("label"), score(k).alias("score")) for k, c in enumerate(CLASSES))))


def _topk(s, d):
    top = _scores(s, d).withColumn("top", M.top_k(F.col("scores"), 3))
    return top.select("id", F.col("top")[0]["label"].alias("first"), F.col("top")[1]["label"].alias("second"), F.col("top")[2]["label"].alias("third"))


def _topk_accuracy(s, d):
    top = _scores(s, d).withColumn("labels", F.transform(M.top_k(F.col("scores"), 3), lambda x: x["label"]))
    return top.agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.array_contains("labels", F.col("truth")).cast("double"))).alias("top3"), R(F.avg((F.col("labels")[0] == F.col("truth")).cast("double"))).alias("top1"))


def _rejected(s, d):
    m = v_multi(s, d).where("truth in ('error', 'view')").withColumn("accepted", F.col("conf") >= 0.65)
    out = m.groupBy("origin", "truth").agg(N(), F.count_if(F.col("accepted")).alias("n_accepted"), F.avg("conf").alias("c")).join(M.percentiles(m, ["origin", "truth"], "conf", [0.5]).withColumnsRenamed({"origin": "o2", "truth": "t2"}), (F.col("origin") == F.col("o2")) & (F.col("truth") == F.col("t2"))).withColumn("med", F.col("q")[0])
    best = m.groupBy("origin", "truth", "pred").agg(F.count(F.lit(1)).alias("k")).groupBy("origin", "truth").agg(F.min_by("pred", F.struct(-F.col("k"), F.col("pred"))).alias("top_pred"))
    return out.join(best, ["origin", "truth"]).select("origin", "truth", "n", "n_accepted", R(F.col("n_accepted") / F.col("n")).alias("rate"), R("c").alias("mean_conf"), R("med").alias("median_conf"), "top_pred")


def _baseline(s, d):
    m = v_multi(s, d)
    out = M.majority_baseline(m.where("id % 4 <> 0 and origin <> 2"), m.where("id % 4 = 0"), "origin", "truth")
    return out.groupBy("origin", "pred").agg(N(), F.count_if(F.col("truth") == F.col("pred")).alias("n_right"))


def _gate(s, d):
    b = M.binary_metrics(v_score(s, d))
    return b.select((F.col("accuracy") >= 0.8).alias("accuracy_ok"), (F.col("recall") >= 0.5).alias("recall_ok"), (F.col("f1") >= 0.8).alias("f1_ok"), (F.col("specificity") >= 0.5).alias("specificity_ok"), ((F.col("accuracy") >= 0.8) & (F.col("recall") >= 0.5) & (F.col("f1") >= 0.8)).alias("deployable"))


def _detect(s, d):
    p = v_score(s, d)
    abstain = F.col("prob").between(0.4, 0.6)
    route = F.when(abstain, "judge").when(F.col("pred"), "classify").otherwise("judge")
    return p.select("id", F.col("pred").alias("is_malicious"), abstain.alias("abstain"), route.alias("route"), R(F.when(F.col("pred"), F.col("prob")).otherwise(1 - F.col("prob"))).alias("confidence"))


def _classify(s, d):
    m = v_multi(s, d)
    route = F.when(F.col("conf") < 0.65, "judge").when(~F.col("pred").isin("view", "click", "purchase"), "judge").otherwise("explain")
    issue = F.when(~F.col("pred").isin("view", "click", "purchase"), "attack_type_outside_taxonomy").when(F.col("conf") < 0.65, "confidence_below_review_threshold").otherwise("none")
    return m.groupBy(route.alias("route"), issue.alias("issue")).agg(N())


def _bin(df, *by):
    return df.select(*by, "tp", "tn", "fp", "fn", *(R(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")))


def _selection_sha(s, d):
    return S.selection_hash(S.balance_binary(v_manifest(s, d), SEED), "manifest_id")


def _exact(s, d):
    m = v_manifest(s, d)
    return S.exact_split(m, "class", "origin", SEED, "manifest_id").groupBy("class", "origin", "part").agg(N())


def _view(s, d):
    return S.balanced_view(v_manifest(s, d), "origin", "class", 20, SEED, "manifest_id").select("origin", "class", "manifest_id")


BALANCE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, origin, is_attack ORDER BY {H('manifest_id')}, manifest_id) AS rn FROM v_manifest) JOIN (SELECT split, origin, least(count(*) FILTER (is_attack), count(*) FILTER (NOT is_attack)) AS quota FROM v_manifest GROUP BY 1, 2) USING (split, origin) WHERE rn <= quota"
BIN = "count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND NOT pred) AS tn, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn"
BIN2 = "round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
CLASS_SQL = ", l(label) AS (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + "), t AS (SELECT label, (SELECT count(*) FROM v_multi WHERE truth = label) AS support, (SELECT count(*) FROM v_multi WHERE pred = label) AS predicted, (SELECT count(*) FROM v_multi WHERE pred = label AND truth = label) AS hit FROM l), m AS (SELECT label, support, coalesce(hit / nullif(predicted, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(predicted + support, 0), 0) AS f1 FROM t)"
SWEEP_SQL = "SELECT k, n_decided, n_wrong, n_decided / n AS coverage, n_wrong / nullif(n_decided, 0) AS risk FROM (SELECT k, (SELECT count(*) FROM v_multi WHERE least(floor(conf * 100 + 1e-9), 99) >= k) AS n_decided, (SELECT count(*) FROM v_multi WHERE least(floor(conf * 100 + 1e-9), 99) >= k AND truth <> pred) AS n_wrong, (SELECT count(*) FROM v_multi) AS n FROM range(100) r(k))"
TOP_SQL = ", c(place, label) AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CLASSES)) + "), q AS (SELECT id, truth, label, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN pred = label THEN conf ELSE (place % 2) * CAST(0.05 AS DOUBLE) END DESC, place) AS rn FROM v_multi CROSS JOIN c)"

ALL = {
    "balance_binary": (lambda s, d: S.balance_binary(v_manifest(s, d), SEED).select("manifest_id", "split", "origin", "is_attack", "rn"), sql(f"SELECT manifest_id, split, origin, is_attack, rn FROM ({BALANCE})")),
    "balance_check": (lambda s, d: S.balance_check(S.balance_binary(v_manifest(s, d), SEED)).select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("origin", F.lit("*")).alias("origin"), "balanced", "n"), sql(f"SELECT coalesce(split, '*') AS split, coalesce(origin, '*') AS origin, count(*) FILTER (is_attack) * 2 = count(*) AS balanced, count(*) AS n FROM ({BALANCE}) GROUP BY CUBE (split, origin)")),
    "hamilton_quotas": (_hamilton, sql(", h AS (SELECT origin, class, count(*) AS n FROM v_manifest GROUP BY 1, 2) " + hamilton_sql("h", "origin", "class", "100"))),
    "proportional_sample": (lambda s, d: S.proportional_sample(v_manifest(s, d), 300, ("origin", "detail"), SEED, "manifest_id").select("origin", "detail", "manifest_id"), sql(", h AS (SELECT origin, count(*) AS n FROM v_manifest GROUP BY 1), q1 AS (" + hamilton_sql("h", "", "origin", "300") + "), g AS (SELECT v.origin, detail, count(*) AS n, min(quota) AS above FROM v_manifest v JOIN q1 ON v.origin = q1.origin GROUP BY 1, 2), q2 AS (" + hamilton_sql("g", "origin", "detail", "above") + f") SELECT origin, detail, manifest_id FROM (SELECT v.*, row_number() OVER (PARTITION BY origin, detail ORDER BY {H('manifest_id')}, manifest_id) AS rn FROM v_manifest v) JOIN q2 USING (origin, detail) WHERE rn <= quota")),
    "split_matrix": (lambda s, d: S.split_matrix(v_manifest(s, d).groupBy("class", "origin").agg(N()), "class", "origin", SEED), None),
    "exact_split": (_exact, None),
    "stratified_split": (lambda s, d: S.stratified_split(v_manifest(s, d), "class", SEED, "manifest_id"), sql(f"SELECT class, manifest_id, CASE WHEN rn <= floor(n * 70 / 100) THEN 'train' WHEN rn <= floor(n * 70 / 100) + floor(n * 15 / 100) THEN 'val' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {H('manifest_id')}, manifest_id) AS rn, count(*) OVER (PARTITION BY class) AS n FROM v_manifest)")),
    "round_robin_fill": (lambda s, d: S.round_robin(v_manifest(s, d), "class", 123, SEED, "manifest_id"), sql(f"SELECT class, manifest_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {H('manifest_id')}, manifest_id) AS rn FROM v_manifest) ORDER BY rn, class LIMIT 123")),
    "balanced_origin_view": (_view, sql(f"SELECT origin, class, manifest_id FROM (SELECT *, row_number() OVER (PARTITION BY origin, class ORDER BY {H('manifest_id')}, manifest_id) AS rn FROM v_manifest) JOIN (SELECT origin, class, min(n) OVER (PARTITION BY origin) AS quota FROM (SELECT origin, class, count(*) AS n FROM v_manifest GROUP BY 1, 2) WHERE n >= 20) USING (origin, class) WHERE rn <= quota")),
    "distinct_class_sample": (lambda s, d: S.distinct_class_sample(v_doc(s, d), "dataset", "fp", 40, SEED, "doc_id").select("dataset", "doc_id", "rn"), sql(f"SELECT dataset, doc_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {H('fp')}, fp) AS rn FROM (SELECT dataset, fp, min(doc_id) AS doc_id FROM v_doc GROUP BY 1, 2)) WHERE rn <= 40")),
    "seeded_order": (lambda s, d: S.ranked(v_manifest(s, d).withColumn("one", F.lit(1)), ["one"], S.seeded(SEED, F.col("manifest_id")), "manifest_id").select("manifest_id", "rn"), sql(f"SELECT manifest_id, row_number() OVER (ORDER BY {H('manifest_id')}, manifest_id) AS rn FROM v_manifest")),
    "selection_sha256": (_selection_sha, sql(f", b AS (SELECT left(sha256(CAST(manifest_id AS VARCHAR)), 4) AS b, count(*) AS n, sha256(string_agg(CAST(manifest_id AS VARCHAR), ',' ORDER BY manifest_id)) AS h FROM ({BALANCE}) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(b || ':' || h, ',' ORDER BY b)) AS sha FROM b")),
    "stage_detect": (_detect, sql("SELECT id, pred AS is_malicious, prob BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE) AS abstain, CASE WHEN prob BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE) THEN 'judge' WHEN pred THEN 'classify' ELSE 'judge' END AS route, round(CASE WHEN pred THEN prob ELSE 1 - prob END, 6) AS confidence FROM v_score")),
    "selective_metrics": (lambda s, d: M.selective_metrics(v_score(s, d), "origin").select("origin", "n", "n_abstained", "n_abstained_attack", R("coverage").alias("coverage"), "tp", "tn", "fp", "fn", R("f1").alias("f1")), sql(f"SELECT origin, n, n_abstained, n_abstained_attack, round((n - n_abstained) / n, 6) AS coverage, tp, tn, fp, fn, f1 FROM (SELECT origin, count(*) AS n, count(*) FILTER (prob BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE)) AS n_abstained, count(*) FILTER (truth AND prob BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE)) AS n_abstained_attack FROM v_score GROUP BY 1) JOIN (SELECT *, {BIN2} FROM (SELECT origin, {BIN} FROM v_score WHERE prob NOT BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE) GROUP BY 1)) USING (origin)")),
    "binary_metrics": (lambda s, d: _bin(M.binary_metrics(v_score(s, d))), sql(f"SELECT *, {BIN2} FROM (SELECT {BIN} FROM v_score)")),
    "binary_metrics_by_origin": (lambda s, d: _bin(M.binary_metrics(v_score(s, d), "origin"), "origin"), sql(f"SELECT *, {BIN2} FROM (SELECT origin, {BIN} FROM v_score GROUP BY 1)")),
    "deployment_gate": (_gate, sql(f"SELECT accuracy >= CAST(0.8 AS DOUBLE) AS accuracy_ok, recall >= CAST(0.5 AS DOUBLE) AS recall_ok, f1 >= CAST(0.8 AS DOUBLE) AS f1_ok, specificity >= CAST(0.5 AS DOUBLE) AS specificity_ok, accuracy >= CAST(0.8 AS DOUBLE) AND recall >= CAST(0.5 AS DOUBLE) AND f1 >= CAST(0.8 AS DOUBLE) AS deployable FROM (SELECT {BIN2} FROM (SELECT {BIN} FROM v_score))")),
    "confusion_matrix": (lambda s, d: M.confusion(v_multi(s, d)), sql("SELECT truth, pred, count(*) AS n FROM v_multi GROUP BY 1, 2")),
    "class_metrics": (lambda s, d: M.class_metrics(v_multi(s, d), CLASSES).select("label", "support", *(R(F.col(c)).alias(c) for c in ("precision", "recall", "f1"))), sql(CLASS_SQL + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")),
    "macro_metrics": (lambda s, d: M.macro_metrics(v_multi(s, d), CLASSES).select(*(R(F.col(c)).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1", "accuracy"))), sql(CLASS_SQL + " SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, (SELECT round(avg(CAST(truth = pred AS INT)), 6) FROM v_multi) AS accuracy FROM m")),
    "topk_accuracy": (_topk_accuracy, sql(TOP_SQL + " SELECT count(*) AS n, round(avg(top3), 6) AS top3, round(avg(top1), 6) AS top1 FROM (SELECT id, max(CAST(label = truth AND rn <= 3 AS INT)) AS top3, max(CAST(label = truth AND rn = 1 AS INT)) AS top1 FROM q GROUP BY id)")),
    "topk_scores": (_topk, sql(TOP_SQL + " SELECT id, max(CASE WHEN rn = 1 THEN label END) AS first, max(CASE WHEN rn = 2 THEN label END) AS second, max(CASE WHEN rn = 3 THEN label END) AS third FROM q GROUP BY id")),
    "risk_coverage": (lambda s, d: M.risk_coverage(v_multi(s, d), 0.65, "origin").select("origin", "n", "n_decided", "n_wrong", R("coverage").alias("coverage"), R("risk").alias("risk")), sql("SELECT origin, count(*) AS n, count(*) FILTER (conf >= CAST(0.65 AS DOUBLE)) AS n_decided, count(*) FILTER (conf >= CAST(0.65 AS DOUBLE) AND truth <> pred) AS n_wrong, round(count(*) FILTER (conf >= CAST(0.65 AS DOUBLE)) / count(*), 6) AS coverage, round(count(*) FILTER (conf >= CAST(0.65 AS DOUBLE) AND truth <> pred) / nullif(count(*) FILTER (conf >= CAST(0.65 AS DOUBLE)), 0), 6) AS risk FROM v_multi GROUP BY 1")),
    "threshold_sweep": (_sweep, sql(f"SELECT k, n_decided, n_wrong, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM ({SWEEP_SQL})")),
    "threshold_choice": (_choice, sql(f"SELECT k, n_decided, round(coverage, 6) AS coverage, round(risk, 6) AS risk, fit AS feasible FROM (SELECT *, coalesce(risk <= CAST(0.05 AS DOUBLE), false) AS fit FROM ({SWEEP_SQL}) WHERE coverage >= CAST(0.5 AS DOUBLE) AND risk IS NOT NULL) ORDER BY fit DESC, CASE WHEN fit THEN -coverage ELSE risk END, CASE WHEN fit THEN risk ELSE -coverage END, k LIMIT 1")),
    "confidence_summary": (lambda s, d: M.confidence_summary(v_multi(s, d), "truth").select("truth", "n", *(R(F.col(c)).alias(c) for c in ("mean", "lo", "p05", "median", "p95", "hi"))), sql("SELECT truth, count(*) AS n, round(avg(conf), 6) AS mean, round(min(conf), 6) AS lo, round(quantile_cont(conf, 0.05), 6) AS p05, round(quantile_cont(conf, 0.5), 6) AS median, round(quantile_cont(conf, 0.95), 6) AS p95, round(max(conf), 6) AS hi FROM v_multi GROUP BY 1")),
    "rejected_acceptance": (_rejected, sql("SELECT origin, truth, n, n_accepted, round(n_accepted / n, 6) AS rate, mean_conf, median_conf, top_pred FROM (SELECT origin, truth, count(*) AS n, count(*) FILTER (conf >= CAST(0.65 AS DOUBLE)) AS n_accepted, round(avg(conf), 6) AS mean_conf, round(quantile_cont(conf, 0.5), 6) AS median_conf FROM v_multi WHERE truth IN ('error', 'view') GROUP BY 1, 2) JOIN (SELECT origin, truth, pred AS top_pred FROM (SELECT origin, truth, pred, row_number() OVER (PARTITION BY origin, truth ORDER BY count(*) DESC, pred) AS rn FROM v_multi WHERE truth IN ('error', 'view') GROUP BY 1, 2, 3) WHERE rn = 1) USING (origin, truth)")),
    "origin_majority_baseline": (_baseline, sql(", t AS (SELECT * FROM v_multi WHERE id % 4 <> 0 AND origin <> 2), g AS (SELECT origin, truth AS guess FROM (SELECT origin, truth, row_number() OVER (PARTITION BY origin ORDER BY count(*) DESC, truth) AS rn FROM t GROUP BY 1, 2) WHERE rn = 1), f AS (SELECT truth AS fallback FROM t GROUP BY 1 ORDER BY count(*) DESC, truth LIMIT 1) SELECT v.origin, coalesce(guess, fallback) AS pred, count(*) AS n, count(*) FILTER (truth = coalesce(guess, fallback)) AS n_right FROM v_multi v LEFT JOIN g ON v.origin = g.origin CROSS JOIN f WHERE id % 4 = 0 GROUP BY 1, 2")),
    "topk_per_class": (lambda s, d: v_multi(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("pred").orderBy(F.desc("conf"), S.seeded(SEED, F.col("id")))).cast("bigint")).where("rn <= 10").select("pred", "id", "conf", "rn"), sql(f"SELECT pred, id, conf, rn FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, {H('id')}) AS rn FROM v_multi) WHERE rn <= 10")),
    "stage_classify": (_classify, sql("SELECT CASE WHEN conf < CAST(0.65 AS DOUBLE) OR pred NOT IN ('view', 'click', 'purchase') THEN 'judge' ELSE 'explain' END AS route, CASE WHEN pred NOT IN ('view', 'click', 'purchase') THEN 'attack_type_outside_taxonomy' WHEN conf < CAST(0.65 AS DOUBLE) THEN 'confidence_below_review_threshold' ELSE 'none' END AS issue, count(*) AS n FROM v_multi GROUP BY 1, 2")),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: o for name, (_, o) in ALL.items() if o}
