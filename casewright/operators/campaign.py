"""Campaign relations: latest attempts, joins with manifests, preflight, reports and fingerprint dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(attempts: DataFrame, keys: list[str], order: str = "seq", where: Column | None = None) -> DataFrame:
    """The row with the greatest ``order`` of each key, by one mergeable aggregate: no sort, no hot task."""
    rows = attempts if where is None else attempts.where(where)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def campaign_join(manifests: DataFrame, attempts: DataFrame, provider: str | None = None) -> DataFrame:
    """Manifests with their preferred attempt: the latest valid model attempt, of one provider if named."""
    usable = F.col("ok") & F.col("llm")
    if provider is not None:
        usable = usable & (F.lower("provider") == provider.lower())
    return manifests.join(latest(attempts, ["manifest_id"], where=usable), "manifest_id")


def orphans(attempts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Attempts whose manifest doesn't exist."""
    return attempts.join(manifests.select("manifest_id"), "manifest_id", "left_anti")


def unmatched_reason(manifests: DataFrame, attempts: DataFrame, provider: str) -> DataFrame:
    """manifest_id and ``reason``: usable, provider_mismatch (only others have succeeded) or missing."""
    seen = attempts.where(F.col("ok") & F.col("llm")).groupBy("manifest_id").agg(F.max((F.lower("provider") == provider.lower()).cast("int")).alias("mine"))
    reason = F.when(F.col("mine") == 1, "usable").when(F.col("mine") == 0, "provider_mismatch").otherwise("missing")
    return manifests.join(seen, "manifest_id", "left").select("manifest_id", reason.alias("reason"))


def pending(manifests: DataFrame, attempts: DataFrame, retry_failures: bool = False) -> DataFrame:
    """Manifests that no attempt has settled; failures settle nothing when they are retried."""
    done = attempts.where(F.col("ok") & F.col("llm")) if retry_failures else attempts
    return manifests.join(done.select("manifest_id").distinct(), "manifest_id", "left_anti")


def terminal_state(attempts: DataFrame) -> DataFrame:
    """manifest_id and its campaign state: a model success is terminal, else the last attempt counts."""
    won = F.max((F.col("ok") & F.col("llm")).cast("int"))
    last = F.max_by("state", "seq")
    return attempts.groupBy("manifest_id").agg(F.when(won == 1, "success").otherwise(last).alias("state"), F.count(F.lit(1)).alias("n_attempts"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def quality_report(manifests: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each origin and one for all: counts, ratios and confidence figures of the joined campaign."""
    joined = manifests.join(latest(attempts, ["manifest_id"]), "manifest_id", "left")
    has = F.col("seq").isNotNull()
    good = F.coalesce(F.col("ok") & F.col("llm"), F.lit(False))
    report = joined.rollup("origin").agg(
        F.count(F.lit(1)).alias("n_manifests"), F.count_if(has).alias("n_attempted"), F.count_if(good).alias("n_model_ok"), F.count_if(has & ~F.coalesce("ok", F.lit(False))).alias("n_failed"),
        F.count_if(F.col("is_attack")).alias("n_attack"), F.countDistinct("class").alias("n_classes"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
    )
    return report.withColumn("coverage", safe_ratio(F.col("n_attempted"), F.col("n_manifests"))).withColumn("success_ratio", safe_ratio(F.col("n_model_ok"), F.col("n_attempted"))).withColumn("origin", F.coalesce("origin", F.lit("(all)")))


def support_report(rows: DataFrame, split: str = "split", origin: str = "origin", label: str = "is_attack") -> DataFrame:
    """Counts at every level of split and origin, with ``balanced`` where both labels are equally frequent."""
    out = rows.cube(split, origin).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("n_attack"), F.grouping_id().cast("bigint").alias("level"))
    return out.withColumn("balanced", F.col("n_attack") * 2 == F.col("n"))


def _supervision(rows: DataFrame, key: list[str], label: str, split: str) -> DataFrame:
    """One row a group: size, smallest id, distinct splits and labels; every column merges."""
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("keeper"), (F.min(split) != F.max(split)).alias("cross_split"), F.coalesce(F.min(label) != F.max(label), F.lit(False)).alias("conflict"), F.count(label).alias("n_labelled"),
    )


def dedup_strict(rows: DataFrame, namespace: str = "dataset", label: str = "label", split: str = "split") -> DataFrame:
    """namespace, fp, outcome and keeper: conflicting labels are violations, groups over splits are dropped whole."""
    groups = _supervision(rows, [namespace, "fp"], label, split)
    outcome = F.when(F.col("conflict"), "violation").when(F.col("cross_split"), "dropped").otherwise("kept")
    return groups.select(namespace, "fp", outcome.alias("outcome"), F.when(outcome == "kept", F.col("keeper")).alias("keeper"))


def dedup_labelled(rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Ids that stay: the smallest of each fingerprint whose group has one split and no conflicting labels."""
    return _supervision(rows, ["fp"], label, split).where("not cross_split and not conflict").select(F.col("keeper").alias("doc_id"))


def removed_groups(rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """fp, size and reason of every group that loses rows."""
    reason = F.when(F.col("conflict"), "conflicting_labels").when(F.col("cross_split"), "cross_split").when(F.col("size") > 1, "same_split_duplicate")
    return _supervision(rows, ["fp"], label, split).where(reason.isNotNull()).select("fp", F.col("size").alias("n"), reason.alias("reason"))


def cross_split_overlap(rows: DataFrame, split: str = "split") -> DataFrame:
    """How many fingerprints are in more than one split."""
    return rows.groupBy("fp").agg((F.min(split) != F.max(split)).alias("x")).agg(F.count_if("x").alias("n_overlap"), F.count(F.lit(1)).alias("n_fingerprints"))


def first_class(rows: DataFrame, key: str, rank: Column, order: str) -> DataFrame:
    """The row of each key whose class comes first, then by ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.withColumn("_rank", rank).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_rank", order)).alias("_r")).select(key, "_r.*")


def first_wins(rows: DataFrame, keys: list[str], order: str, existing: DataFrame | None = None) -> DataFrame:
    """First row of each key by ``order``, without keys that are stored already."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return first if existing is None else first.join(existing.select(*keys).distinct(), keys, "left_anti")


def evict(cache: DataFrame, asked: DataFrame, keys: tuple[str, str] = ("content_hash", "pipeline_hash")) -> DataFrame:
    """Cache rows that stay: those that no well-formed request (two SHA-256 in hexadecimal) names."""
    return cache.join(asked.where(well_formed(*keys)).select(*keys), list(keys), "left_anti")


def well_formed(*keys: str) -> Column:
    """Whether every key is a SHA-256 in hexadecimal."""
    good = F.lit(True)
    for k in keys:
        good = good & F.coalesce(F.col(k).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    return good


def exclude(rows: DataFrame, listed: DataFrame, key: str, matched: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` without those that a curated list names in full, and the list's entries with their ``state``.

    An entry excludes a row only if it agrees with it in ``key`` and all ``matched`` columns: matched. Else it is
    mismatch (the key is there with other values), unknown, or repeated (listed more than once), and excludes nothing.
    """
    entries = listed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*matched)).alias("_want"))
    found = rows.select(key, F.struct(*matched).alias("_have"))
    met = entries.join(found, key, "left")
    state = F.when(F.col("_n") > 1, "repeated").when(F.col("_have").isNull(), "unknown").when(F.col("_have").eqNullSafe(F.col("_want")), "matched").otherwise("mismatch")
    report = met.select(key, state.alias("state"))
    return rows.join(report.where("state = 'matched'").select(key), key, "left_anti"), report


def require_matched(report: DataFrame) -> None:
    """An error that names entries which don't match in full."""
    bad = report.where("state <> 'matched'").limit(5).collect()
    if bad:
        raise ValueError(f"the list doesn't fit the rows: {[tuple(r) for r in bad]}")


def preflight(manifests: DataFrame, attempts: DataFrame, require_complete: bool = True, require_llm: bool = True, provider: str | None = None, reject_orphans: bool = True, model: str | None = None) -> DataFrame:
    """(failure, n) of what keeps a campaign from evaluation, in the order of the policy; empty if it is ready.

    orphan_results: attempts without a manifest; incomplete: manifests without a
    success; llm_required: successes none of which a model parsed;
    provider_mismatch, model_mismatch: the latest success comes from another provider or model.
    """
    named = F.lower("model") if model is not None else F.lit(None).cast("string")
    best = latest(attempts, ["manifest_id"], where=F.col("ok")).select("manifest_id", F.lower("provider").alias("_provider"), named.alias("_model"))
    parsed = attempts.where("ok and llm").select("manifest_id").distinct().withColumn("_llm", F.lit(True))
    seen = manifests.select("manifest_id").join(best, "manifest_id", "left").join(parsed, "manifest_id", "left")
    done = F.col("_provider").isNotNull()
    counts = seen.agg(F.count_if(~done).alias("incomplete"), F.count_if(done & F.col("_llm").isNull()).alias("llm_required"), F.count_if(done & (F.col("_provider") != F.lower(F.lit(provider)))).alias("provider_mismatch"), F.count_if(done & ~F.col("_model").eqNullSafe(F.lower(F.lit(model)))).alias("model_mismatch"))
    lost = orphans(attempts, manifests).agg(F.count(F.lit(1)).alias("orphan_results"))
    policy = (("orphan_results", reject_orphans), ("incomplete", require_complete), ("llm_required", require_llm), ("provider_mismatch", provider is not None), ("model_mismatch", model is not None))
    entries = F.array(*(F.struct(F.lit(name).alias("failure"), F.col(name).alias("n")) for name, wanted in policy if wanted))
    return counts.crossJoin(lost).select(F.explode(entries).alias("e")).select("e.*").where("n > 0")  # one row each


def failure_runs(attempts: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Longest run of failures of each key in ``order`` (gaps and islands)."""
    by = Window.partitionBy(key).orderBy(order)
    marked = attempts.withColumn("island", F.sum(F.col("ok").cast("int")).over(by))
    runs = marked.where(~F.col("ok")).groupBy(key, "island").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(key).agg(F.max("len").alias("longest"), F.count(F.lit(1)).alias("n_runs"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with side and surplus."""
    keys = left.columns
    both = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    net = both.groupBy(*keys).agg(F.sum("_s").alias("net")).where("net <> 0")
    return net.select(*keys, F.when(F.col("net") > 0, "left").otherwise("right").alias("side"), F.abs("net").cast("bigint").alias("surplus"))
