"""The standardize stage with a scorer that counts what it is asked."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewright.operators import standardize

P = "ab" * 32
RECORDS = "record_id long, dataset string, split string, source_file string, row_id string, row map<string,string>, text string"


@pytest.fixture()
def counted(spark):
    def answer(key, **other):  # inside, since workers can't import this file
        good = {"content_hash": key, "ok": True, "abstain": False, "failure": None, "provider": "mistral", "model": "m", "selected": ["a"], "notes": ["parsed_by_llm", "source:mistral_live"], "confidence": 0.8, "event": {"app_proto": "tcp"}}
        return good | other

    calls = spark.sparkContext.accumulator(0)
    deviations = {"low": {"confidence": None}, "leak": {"event": {"label": "x"}}, "down": {"ok": False, "failure": "timeout"}, "fallback": {"notes": ["parsed_by_llm", "source:mistral_live", "used fallback"]}, "odd": {"selected": ["zz"]}}

    def scorer(frames):
        for frame in frames:
            calls.add(len(frame))
            rows = [answer(k, **deviations.get(dict(r).get("a") if r is not None else None, {})) for k, r in zip(frame["content_hash"], frame["row"], strict=True) if r is None or dict(r).get("a") != "mute"]
            yield pd.DataFrame(rows, columns=list(answer("")))

    return calls, scorer


def records(spark, rows):
    return spark.createDataFrame([(k, d, s, "f", str(k), r, t) for k, (d, s, r, t) in enumerate(rows)], RECORDS)


def outcome(frame):
    return {r.record_id: (r.lookup, r.store, r.failure, r.route) for r in frame.collect()}


def test_each_content_is_asked_once_and_every_record_is_routed(spark, tmp_path, counted):
    calls, scorer = counted
    store = standardize.answers(spark, str(tmp_path), 3)
    kinds = ["x", "x", "low", "leak", "down", "fallback", "odd", "mute", "x"]
    rows = records(spark, [("d", "test", {"a": a, "b": "1"}, None) for a in kinds] + [("d", "nowhere", {"a": "x"}, None), ("d", "val", None, " "), ("d", "val", {"a": "x"}, "both"), ("d", "train", None, "free text"), (" ", "val", {"a": "x"}, None)])
    found = standardize.standardize(rows, store, scorer, P)
    fine, judge = ("miss", "inserted", None, "final_detector"), "final_judge"
    assert outcome(found) == {
        0: fine, 1: fine, 8: fine, 2: ("miss", "not_attempted", "confidence_missing", judge), 3: ("miss", "not_attempted", "event_leaks", judge), 4: ("miss", "not_attempted", "timeout", judge), 5: ("miss", "not_attempted", "notes_forbidden", judge),
        6: ("miss", "not_attempted", "columns_unknown", judge), 7: ("miss", "not_attempted", "no_answer", judge), 9: ("refused", "none", "standardization_input_invalid", judge), 10: ("refused", "none", "standardization_input_missing", judge),
        11: ("refused", "none", "standardization_input_ambiguous", judge), 12: fine, 13: ("refused", "none", "standardization_input_invalid", judge),
    }
    assert calls.value == 8  # seven kinds of row and one text
    ids = {r.record_id: (r.event_id, r.confidence) for r in found.collect()}
    assert ids[1] == ("llm::d::f::1", 0.8) and ids[4] == ("unstandardized::d::f::4", 0.0)
    again = standardize.standardize(rows, store, scorer, P)
    assert {k: v[0] for k, v in outcome(again).items() if k in (0, 1, 8, 12)} == dict.fromkeys((0, 1, 8, 12), "hit")
    assert calls.value == 8 + 6  # only what has no good answer is asked again
    assert standardize.standardize(rows, store, scorer, "cd" * 32).where("lookup = 'hit'").count() == 0


def test_hits_that_break_the_contract_are_evicted(spark, tmp_path, counted):
    calls, scorer = counted
    store = standardize.answers(spark, str(tmp_path), 3)
    rows = records(spark, [("d", "test", {"a": "x"}, None), ("d", "test", {"a": "down"}, None), ("d", "test", {"a": "y"}, None)])
    old = rows.select(standardize.content(F.col("row"), F.col("text")).alias("content_hash"), F.lit(P).alias("pipeline_hash"), F.create_map(F.lit("app_proto"), F.lit("udp"), F.when(F.col("record_id") < 2, "label").otherwise("host"), F.lit("v")).alias("event"), F.array(F.lit("a")).alias("selected"), F.lit("m").alias("model"), F.lit(0.5).alias("confidence"))
    store.insert_first(old)
    found = standardize.standardize(rows, store, scorer, P)
    assert outcome(found) == {0: ("invalidated", "inserted", None, "final_detector"), 1: ("invalidated", "not_attempted", "timeout", "final_judge"), 2: ("hit", "none", None, "final_detector")}
    assert {r.event["app_proto"] for r in store.read().collect()} == {"tcp", "udp"} and store.read().count() == 2 and calls.value == 2


def test_a_faster_writer_wins_and_a_broken_store_does_not_stop(spark, tmp_path, counted, monkeypatch):
    _, scorer = counted
    store = standardize.answers(spark, str(tmp_path / "a"), 2)
    rows = records(spark, [("d", "test", {"a": "x"}, None)])
    whole = store.insert_first

    def late(good):
        whole(good.withColumn("confidence", F.lit(0.6)))
        return whole(good)

    monkeypatch.setattr(store, "insert_first", late)
    found = standardize.standardize(rows, store, scorer, P)
    assert outcome(found) == {0: ("miss", "already_exists", None, "final_detector")} and found.first().confidence == 0.6
    broken = standardize.answers(spark, str(tmp_path / "b"), 2)
    monkeypatch.setattr(broken, "insert_first", lambda good: 1 / 0)
    found = standardize.standardize(rows, broken, scorer, P)
    assert outcome(found) == {0: ("miss", "failed", None, "final_detector")} and found.first().confidence == 0.8
