"""The standardize stage: guard, look up, score each missing content once, check, store, and give every record its own event and route.

Answers are kept by (content_hash, pipeline_hash) in a keyed store. A hit that no longer
fulfils the contract is evicted and scored again; a new answer is stored only if it
does, and where another writer was faster the stored one wins. A store that can't be
read or written never stops the stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import contracts, hashing, leak
from casewright.session import stored
from casewright.sources.keyed import KeyedStore

#: What is kept of an answer, and what a scorer gives for each content.
KEPT = "content_hash string, pipeline_hash string, event map<string,string>, selected array<string>, model string, confidence double"
ANSWER = "content_hash string, ok boolean, abstain boolean, failure string, provider string, model string, selected array<string>, notes array<string>, confidence double, event map<string,string>"
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: What an event may hold besides its identity.
EVENT_FIELDS = (*leak.EVIDENCE_FIELDS, "mapping_confidence", "schema_version", "notes", "telemetry", "evidence_fields", "feature_groups", "uncertainty", "timestamp", "raw_ref")


def answers(spark: SparkSession, root: str, buckets: int = 16) -> KeyedStore:
    """The store of answers under ``root``."""
    return KeyedStore(spark, root, ["content_hash", "pipeline_hash"], KEPT, buckets)


def content(row: Column, text: Column) -> Column:
    """SHA-256 of what is standardized: the row in canonical form, else the text."""
    return F.when(F.size(row) > 0, hashing.content_hash(hashing.canonical_json(row))).otherwise(hashing.content_hash(text))


def _checked(cached: bool) -> Column:
    """Code of the first rule of the contract that an answer breaks for its record; null if it is good."""
    a = F.col("answer")
    given = {
        "ok": a["ok"], "abstain": a["abstain"], "review": F.lit(False), "failure": a["failure"], "fallback": F.lit(False), "cache_key": F.lit(None).cast("string"), "from_cache": F.lit(cached), "given": F.lit(False), "source": F.lit("llm"),
        "provider": a["provider"], "model": a["model"], "selected": a["selected"], "row_keys": F.map_keys("row"), "notes": a["notes"], "content_hash": F.col("content_hash"), "pipeline_hash": F.col("pipeline_hash"), "input_hash": F.col("content_hash"),
        "n_unknown": F.size(F.filter(F.map_keys(a["event"]), lambda k: ~k.isin(*EVENT_FIELDS) & ~leak.is_target_field(k))), "n_leaks": F.size(leak.flat_violations(a["event"])), "event_id": F.col("event_id"), "dataset": F.col("dataset"), "source_file": F.col("source_file"),
        "row_id": F.col("row_id"), "split": F.col("split"), "origin_dataset": F.col("dataset"), "origin_file": F.coalesce("source_file", F.lit("inline")), "origin_row": F.col("row_id"), "event_split": F.col("split"), "confidence": a["confidence"],
        "event_confidence": F.coalesce(a["event"]["mapping_confidence"].try_cast("double"), a["confidence"]),
    }
    facts = F.struct(*(c.alias(n) for n, c in given.items()))
    return contracts.first_failure(contracts.standardization_rules(facts))


def standardize(records: DataFrame, store: KeyedStore, scorer: Scorer, pipeline_hash: str, label: str = "standardize") -> DataFrame:
    """record_id, content_hash, lookup, store, failure, route, confidence, event_id and event of every record.

    ``records``: record_id (unique), dataset, split, source_file, row_id (text), row
    (map<string,string>) and text. ``scorer`` takes frames of content_hash, row and text, one row for each
    content that has no good answer, and gives ``ANSWER``. lookup: refused (by the
    input guard), hit, invalidated or miss; store: none, inserted, already_exists, not_attempted or failed.
    """
    none = F.lit(None)
    named = records.withColumn("content_hash", content(F.col("row"), F.col("text"))).withColumn("pipeline_hash", F.lit(pipeline_hash))
    guard = contracts.input_guard(F.col("split"), F.col("dataset"), F.col("row"), F.col("text"), none.cast("string"), F.lit(True))
    event_id = F.concat_ws("::", F.lit("llm"), "dataset", F.coalesce("source_file", F.lit("inline")), "row_id")
    named = stored(named.withColumn("refused", guard).withColumn("event_id", event_id), f"{label}-records")
    asked = named.where("refused is null")

    # Hits are judged by the contract like answers; what a record's identity adds can't break it.
    marks = F.array(F.lit(contracts.PARSED), F.lit(contracts.CACHED))
    kept = store.read().select("content_hash", "pipeline_hash", F.struct(F.lit(True).alias("ok"), F.lit(False).alias("abstain"), none.cast("string").alias("failure"), F.lit(contracts.PROVIDER).alias("provider"), "model", "selected", marks.alias("notes"), "confidence", "event").alias("answer"))
    one = asked.groupBy("content_hash", "pipeline_hash").agg(F.min_by(F.struct(*(c for c in asked.columns if c not in ("content_hash", "pipeline_hash"))), "record_id").alias("r")).select("content_hash", "pipeline_hash", "r.*")
    met = one.join(kept, ["content_hash", "pipeline_hash"], "left")
    met = stored(met.withColumn("broken", F.when(F.col("answer").isNotNull(), _checked(True))), f"{label}-met")
    bad = met.where("broken is not null").select("content_hash", "pipeline_hash")
    if not bad.isEmpty():
        _open(lambda: store.evict(bad))

    missing = met.where("answer is null or broken is not null")
    found = missing.select("content_hash", "row", "text").mapInPandas(scorer, ANSWER)
    fields = [c.split()[0] for c in ANSWER.split(", ")][1:]
    live = missing.drop("answer").join(found.select("content_hash", F.struct(*fields).alias("answer")), "content_hash", "left")
    silent = F.when(F.col("answer").isNull(), F.lit("no_answer"))
    live = live.withColumn("failure", F.coalesce(silent, F.when(~F.coalesce(F.col("answer.ok"), F.lit(False)), F.coalesce("answer.failure", F.lit("standardization_failed"))), _checked(False)))
    live = stored(live.select("content_hash", "pipeline_hash", "answer", "failure", F.when(F.col("broken").isNotNull(), "invalidated").otherwise("miss").alias("lookup")), f"{label}-live")  # the scorer runs here, once

    good = live.where("failure is null").select("content_hash", "pipeline_hash", "answer.event", "answer.selected", "answer.model", "answer.confidence")
    written = _open(lambda: store.insert_first(good)) is not None
    now = store.read().select("content_hash", "pipeline_hash", F.struct("event", "selected", "model", "confidence").alias("winner")) if written else None
    own = F.struct(*(F.col(f"answer.{c}").alias(c) for c in ("event", "selected", "model", "confidence")))
    if now is None:
        settled = live.withColumn("kept", own).withColumn("store", F.when(F.col("failure").isNull(), "failed").otherwise("not_attempted"))
    else:
        settled = live.join(now, ["content_hash", "pipeline_hash"], "left")
        differs = F.to_json("winner") != F.to_json(own)
        settled = settled.withColumn("kept", F.coalesce("winner", own)).withColumn("store", F.when(F.col("failure").isNotNull(), "not_attempted").when(F.coalesce(differs, F.lit(False)), "already_exists").otherwise("inserted"))
    hits = met.where("answer is not null and broken is null").select("content_hash", "pipeline_hash", F.struct("answer.event", "answer.selected", "answer.model", "answer.confidence").alias("kept"), none.cast("string").alias("failure"), F.lit("hit").alias("lookup"), F.lit("none").alias("store"))
    outcome = stored(hits.unionByName(settled.select("content_hash", "pipeline_hash", "kept", "failure", "lookup", "store")), f"{label}-outcomes")

    out = named.join(outcome, ["content_hash", "pipeline_hash"], "left")
    failure = F.coalesce("refused", "failure")
    fine = failure.isNull()
    return out.select(
        "record_id", "content_hash", F.when(F.col("refused").isNotNull(), "refused").otherwise(F.col("lookup")).alias("lookup"), F.when(F.col("refused").isNotNull(), "none").otherwise(F.col("store")).alias("store"), failure.alias("failure"),
        F.when(fine, "final_detector").otherwise("final_judge").alias("route"), F.when(fine, F.col("kept.confidence")).otherwise(0.0).alias("confidence"),
        F.when(fine, F.col("event_id")).otherwise(F.concat_ws("::", F.lit("unstandardized"), "dataset", F.coalesce("source_file", F.lit("api")), "row_id")).alias("event_id"), F.when(fine, F.col("kept.event")).alias("event"),
    )


def _open(step: Callable[[], int]) -> int | None:
    """A step on the store; a failure of the store counts as nothing done."""
    try:
        return step()
    except Exception:  # noqa: BLE001  the stage goes on without its store
        return None
